"""Repeated passages across documents, by content-defined chunks and extension to their true ends.

A gear hash rolls over the bytes of a text: every byte adds a random number to the hash shifted by two
bits, so it depends on the last ``MEMORY`` bytes only. Of any ``window(passage)`` successive places the
one with the smallest hash is a boundary, at which a chunk begins. Boundaries follow the content alone:
an insertion moves them, but changes only those near it. A chunk reaches to the next boundary, or
``LEAST`` bytes where that comes earlier, so chunks have bounded sizes, and a passage of ``passage``
bytes or more has a whole chunk in it, the same one wherever it occurs. One aggregate over digests finds
the chunks that occur in two documents or more, and a join gives them back to their places. Shared
chunks that touch or overlap form a chain.

Neither end of a passage is farther from its chain than a window and the hash's memory. The bytes on
either side of the chunks at the ends of chains are collected for all occurrences, and equal ones are
counted once. How far each goes on as in another document is found in sorted order, for blocks of chunks
at a time: the bytes that neighbours have in common say all. A chunk with more than ``HOT`` different
sides is not sorted in one task; its prefixes are aggregated instead. Extended chains shorter than
``passage`` bytes are left alone.

The document with the smallest id keeps a chunk, in all others it is a repeat; a chain is split where
that changes. A repeat of less than ``passage`` bytes beside a part that is kept stays with it.
Repetition inside one document is no repeat across documents. The parts and ends of a chain may be
shared with different documents.

Defined cases: null and empty texts have no chunks; rows with one id are one document; a null id is
smaller than all others and all such rows are one document; spans begin and end between characters;
extra columns are not read by ``repeated_spans`` and kept by ``drop_repeats``, whatever their names; a
``passage`` below 48 counts as 48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from arborinfo.functions.rng import mix64
from arborinfo.lineage import materialize, ship_package
from arborinfo.llm import text as tx

PASSAGE = 144
#: Bytes that the rolling hash remembers.
MEMORY = 16
#: Bytes of a chunk at least, as far as the window allows.
LEAST = 48
#: Different sides of a chunk that are sorted in one task, and sides in a block of chunks.
HOT, BLOCK = 5_000, 20_000
GEAR = (mix64(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def window(passage: int) -> int:
    """Successive places of which one is a boundary; a chunk has so many bytes at most."""
    return min((max(passage, 48) - MEMORY) // 2, 1 << 10)


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, its bits mixed; hashing begins anew with each text.

    The hash of the last 2k bytes is that of the last k plus 4 to the k times that of the k before.
    """
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    total = GEAR[data]
    for power in (1, 2, 4, 8):
        total[power:] += np.where(place[power:] >= power, total[:-power] << np.uint32(2 * power), np.uint32(0))
    return total * np.uint32(0x9E3779B1)


def chunk_ends(
    data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and begins of the chunks in all texts, and the number of the text of each."""
    width, n = window(passage), len(data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.roll(gear_hashes(data, offsets), 1)  # of the bytes before a place
    value[offsets[:-1][offsets[:-1] < n]] = 0xFFFFFFFF
    inner = (data & 0xC0) == 0x80
    key = (value.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # of equals the leftmost
    key[inner] = NONE  # no chunk begins inside a character
    least, size = key, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    count = n - width + 1
    least = np.minimum(least[:count], least[width - size :][:count])
    whole = np.zeros(count + 1, np.int64)  # windows that lie in one text
    begins, stops = offsets[:-1], offsets[1:] - (width - 1)
    fits = stops > begins
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, stops[fits], -1)
    least = least[(np.cumsum(whole)[:-1] > 0) & (least != NONE)]
    at = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(offsets, at, "right") - 1
    at, owner = thinned(at, owner, value[at], width)
    if not len(at):
        return at, at, owner
    # The next character's place, for chunks that go on to LEAST bytes.
    begin_of_next = np.append(np.where(inner, n, np.arange(n)), n)
    begin_of_next = np.minimum.accumulate(begin_of_next[::-1])[::-1]
    end = np.maximum(np.append(at[1:], 0), begin_of_next[np.minimum(at + min(LEAST, width), n)])
    whole_chunk = np.append(owner[1:] == owner[:-1], False) & (end <= offsets[owner + 1])
    return end[whole_chunk], at[whole_chunk], owner[whole_chunk]


def thinned(at: np.ndarray, owner: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries without those that monotonous text has more than one of in a window."""
    keep = np.ones(len(at), bool)
    like = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    for k in (np.flatnonzero(like[1:] & like[:-1]) + 1).tolist():
        last = k - 1 if keep[k - 1] else last  # before the first of a run all are kept
        keep[k] = at[k + 1] - at[last] > width
    return at[keep], owner[keep]


def chunks(docs: DataFrame, id_col: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """(doc_id, begin, end, digest) of every chunk: its place in bytes of the text, its hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for part in tx.row_slices(batch):
                data, offsets = tx.buffers(tx.column(part, "text"))
                ends, begins, owner = chunk_ends(data, offsets, passage)
                if not len(ends):
                    continue
                raw = data.tobytes()
                digests = np.array([
                    xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())
                ], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    tx.column(part, "doc_id").take(pa.array(owner)), pa.array((begins - offsets[owner]).astype(np.int32)),
                    pa.array((ends - offsets[owner]).astype(np.int32)), pa.array(digests.view(np.int64)),
                ], names=["doc_id", "begin", "end", "digest"])

    return rows.mapInArrow(cut, f"doc_id {kind}, begin int, end int, digest long")


def contexts(docs: DataFrame, asked: DataFrame, id_col: str, passage: int) -> DataFrame:
    """(digest, side, doc_id, begin, end, own, beside) of the asked places (doc_id, places).

    ``beside`` has the bytes before the chunk, the nearest first (side 0), or after it (side 1).
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(asked, F.col("_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "places")
    ship_package(docs.sparkSession)
    kind, reach = docs.schema[id_col].dataType.simpleString(), window(passage) + MEMORY + 1

    def read(batches):
        for batch in batches:
            for part in tx.row_slices(batch):
                out, source = [[] for _ in range(6)], []
                for k, (text, places) in enumerate(zip(tx.column(part, "text").to_pylist(), tx.column(part, "places").to_pylist())):
                    raw = (text or "").encode()
                    for p in places:
                        begin, end, digest = p["begin"], p["end"], p["digest"]
                        if xxhash.xxh3_64_intdigest(raw[begin:end]) != digest & 0xFFFFFFFFFFFFFFFF:
                            continue  # a place in another row with the same id
                        for side in (0, 1):
                            if not p["asks"][side]:
                                continue
                            beside = raw[max(begin - reach, 0) : begin][::-1] if side == 0 else raw[end : end + reach]
                            source.append(k)
                            for o, x in zip(out, (digest, side, begin, end, p["own"][side], beside)):
                                o.append(x)
                if not source:
                    continue
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [tx.column(part, "doc_id").take(pa.array(source)), *[pa.array(o, t) for o, t in zip(out, types)]],
                    names=["doc_id", "digest", "side", "begin", "end", "own", "beside"],
                )

    return rows.mapInArrow(read, f"doc_id {kind}, digest long, side int, begin int, end int, own boolean, beside binary")


def in_common(sides: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of sorted byte strings, and how many bytes each has in common with the one before.

    The first one, and the first of each group (a column of numbers for each string), have -1.
    """
    size = np.fromiter(map(len, sides), np.int64, len(sides))
    width = int(size.max(initial=0)) + 1
    cells = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sides), np.uint8).reshape(-1, width)
    differ = cells[1:] != cells[:-1]
    differ[:, -1] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    return size, np.concatenate([[-1], np.where((group[:, 1:] == group[:, :-1]).all(axis=0), common, -1)])[: len(size)]


def steps_of(size: np.ndarray, common: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string, low, size): for each string the longest prefix, for each smallest id of its documents.

    Only prefixes that occur in two documents count. Neighbours that have ``t`` bytes in common
    make the strings with one prefix of ``t`` bytes.
    """
    last = np.full(len(size), -1)
    out = []
    for t in range(int(size.max(initial=0)), 0, -1):
        some = np.flatnonzero(size >= t)
        # A string shorter than t lies between no two that have t bytes in common.
        first = np.flatnonzero(common[some] < t)
        lowest, highest = np.minimum.reduceat(low[some], first), np.maximum.reduceat(high[some], first)
        spread = np.diff(np.append(first, len(some)))
        lowest, highest = np.repeat(lowest, spread), np.repeat(highest, spread)
        new = np.flatnonzero((lowest != highest) & (last[some] != lowest))
        last[some[new]] = lowest[new]
        out.append((some[new], lowest[new], np.full(len(new), t)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def sorted_reach(kinds: DataFrame, id_type: str) -> DataFrame:
    """(kind, low, size) of kinds (digest, side, beside, kind, low, high), sorted in blocks of digests."""
    ship_package(kinds.sparkSession)
    blocks = 1 + kinds.count() // BLOCK

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        strings = list(zip(*(table.column(c).to_pylist() for c in ("digest", "side", "beside"))))
        order = sorted(range(len(strings)), key=strings.__getitem__)
        digest, side, beside = zip(*[strings[k] for k in order])
        group = np.stack([np.array(digest, np.int64), np.array(side, np.int64)])
        ids = [table.column(c).to_pylist() for c in ("low", "high")]
        known = sorted(set(ids[0]).union(ids[1]), key=lambda x: (x is not None, x if x is not None else 0))
        rank = {x: k for k, x in enumerate(known)}
        low, high = (np.array([rank[x[k]] for k in order], np.int64) for x in ids)
        size, common = in_common(list(beside), group)
        string, lowest, t = steps_of(size, common, low, high)
        kind = table.column("kind").to_numpy()[order][string]
        firsts = pa.array([known[k] for k in lowest.tolist()], table.schema.field("low").type)
        yield pa.RecordBatch.from_arrays([pa.array(kind), firsts, pa.array(t.astype(np.int32))], names=["kind", "low", "size"])

    keyed = kinds.withColumn("block", F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(block, f"kind long, low {id_type}, size int")


def prefix_reach(kinds: DataFrame, low: Column, high: Column) -> DataFrame:
    """The same by one aggregate over all prefixes, however many sides a digest has."""
    grown = kinds.select("*", F.expr("explode(sequence(1, length(beside)))").alias("size")).select(
        "kind", "size", "low", "high", F.expr("xxhash64(digest, side, substring(beside, 1, size))").alias("start")
    )
    shared = grown.groupBy("start").agg(low.alias("low"), high.alias("high"))
    shared = shared.filter(~F.col("low").eqNullSafe(F.col("high"))).select("start", "low")
    return grown.select("kind", "size", "start").join(shared, "start").groupBy("kind", "low").agg(F.max("size").alias("size"))


def between_characters(reach: Column, side: int) -> Column:
    """The most of the first ``reach`` bytes of ``beside`` that end between characters."""
    # The byte that must not lie inside a character: the last one taken before, the next one after a chunk.
    inner = lambda t: F.hex(F.substring(F.col("beside"), t + side, F.lit(1))).rlike("^[89AB]") & (t > 0)
    return F.when(~inner(reach), reach).when(~inner(reach - 1), reach - 1).when(~inner(reach - 2), reach - 2).otherwise(reach - 3)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """(id, begin, end, first_id, n_copies, removed) of spans that occur in two documents or more.

    ``first_id`` is the smallest id with a chunk of the span, ``n_copies`` the most documents' rows
    of one of its chunks; ``removed`` is false in the document that keeps the span.
    """
    pieces = materialize(chunks(docs, id_col, passage), "chunks")
    low, high = F.min("doc_id"), F.max("doc_id")
    low_of, high_of = F.min("low"), F.max("high")
    if not pieces.filter("doc_id is null").isEmpty():  # plain min and max pass over nulls
        known = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("id"))
        low, high = F.min(known("doc_id"))["id"], F.max(known("doc_id"))["id"]
        low_of, high_of = F.min(known("low"))["id"], F.max(known("high"))["id"]
    often = pieces.groupBy("digest").agg(low.alias("low"), high.alias("high"), F.count("*").alias("copies"))
    often = often.filter(~F.col("low").eqNullSafe(F.col("high")))
    often = materialize(often.select("digest", "low", "copies"), "repeats")
    hits = pieces.join(often, ["digest"]).select(
        "doc_id", "begin", "end", "digest", "low", "copies", (~F.col("doc_id").eqNullSafe(F.col("low"))).alias("removed")
    ).distinct()
    along = Window.partitionBy("doc_id").orderBy("begin", "end", "digest")
    gap = lambda a, b: F.coalesce(a > b, F.lit(True))
    marks = hits.select(
        "*", gap(F.col("begin"), F.lag("end").over(along)).alias("first"),
        gap(F.lead("begin").over(along), F.col("end")).alias("last"),
        F.coalesce(F.col("removed") != F.lag("removed").over(along), F.lit(True)).alias("turn"),
    )
    marks = marks.select(
        "*", F.sum(F.col("first").cast("long")).over(along).alias("chain"),
        F.sum((F.col("first") | F.col("turn")).cast("long")).over(along).alias("run"),
    )
    # Any chunk this near to the end of its chain may go on beyond it with other documents.
    chain, near_end = Window.partitionBy("doc_id", "chain"), window(passage) + MEMORY + 1
    marks = marks.select(
        "*", (F.col("begin") - F.min("begin").over(chain)).alias("before"),
        (F.max("end").over(chain) - F.col("end")).alias("behind"),
    )
    marks = materialize(marks.select(
        "*", (F.col("before") < near_end).alias("left"), (F.col("behind") < near_end).alias("right")
    ), "marks")

    ends = marks.filter("left or right").groupBy("digest").agg(F.max("left").alias("before"), F.max("right").alias("behind"))
    place = F.struct(
        "begin", "end", "digest", F.array(ends["before"], ends["behind"]).alias("asks"), F.array("left", "right").alias("own")
    )
    asked = marks.join(ends, "digest").groupBy("doc_id").agg(F.collect_list(place).alias("places"))
    beside = materialize(contexts(docs, asked, id_col, passage), "beside")
    beside = beside.withColumn("kind", F.xxhash64("digest", "side", "beside"))
    kinds = beside.filter("length(beside) > 0").groupBy("digest", "side", "beside", "kind")
    kinds = materialize(kinds.agg(low.alias("low"), high.alias("high")), "kinds")
    hot = kinds.groupBy("digest", "side").count().filter(F.col("count") > HOT)
    hot = materialize(hot.select("digest", "side"), "hot")
    reach = sorted_reach(kinds.join(hot, ["digest", "side"], "left_anti"), docs.schema[id_col].dataType.simpleString())
    if not hot.isEmpty():
        reach = reach.unionByName(prefix_reach(kinds.join(hot, ["digest", "side"]), low_of, high_of))
    reach = reach.groupBy("kind").agg(F.collect_list(F.struct("low", "size")).alias("steps"))
    # A part that is removed goes on only as far as in a document that stays before it.
    longest = lambda keep: F.expr(
        f"coalesce(array_max(transform(filter(steps, s -> {keep}), s -> s.size)), 0)"
    )
    own_sides = beside.filter("own").join(reach, "kind", "left").select(
        "doc_id", "side", "begin", "end", "beside", longest("true").alias("far"), longest("not (s.low <=> doc_id)").alias("near")
    )
    grown_by = own_sides.groupBy("doc_id", "begin", "end").agg(*[
        F.max(F.when(F.col("side") == side, between_characters(F.col(c), side))).alias(f"{c}{side}")
        for side in (0, 1) for c in ("far", "near")
    ])

    edges = marks.filter("left or right").select("doc_id", "begin", "end", "chain", "before", "behind")
    edges = edges.withColumnsRenamed({"doc_id": "_id", "begin": "_begin", "end": "_end"}).join(
        grown_by, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_begin") == F.col("begin")) & (F.col("_end") == F.col("end"))
    )
    beyond = lambda c, side: F.greatest(F.col(f"{c}{side}") - F.col(("before", "behind")[side]), F.lit(0))
    edges = edges.groupBy("_id", F.col("chain").alias("_chain")).agg(
        *[F.max(beyond(c, side)).alias(f"{c}{side}") for side in (0, 1) for c in ("far", "near")]
    )
    runs = marks.groupBy("doc_id", "chain", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("low").alias("first_id"),
        F.max("copies").alias("n_copies"), F.first("removed").alias("removed"), F.max("first").alias("first"),
        F.max("last").alias("last"),
    ).join(edges, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("chain") == F.col("_chain")))
    spans = runs.select(
        "*", (F.max("end").over(chain) + F.max("far1").over(chain) - F.min("begin").over(chain) + F.max("far0").over(chain)).alias("size"),
        F.lead("begin").over(chain.orderBy("run")).alias("next"),
    ).filter(F.col("size") >= passage)
    # What is shared with later documents only, beside a part that is removed, is kept here.
    reached = lambda side, c: F.when(F.col(("first", "last")[side]), F.col(f"{c}{side}")).otherwise(0)
    near = lambda side: F.when(F.col("removed"), reached(side, "near")).otherwise(reached(side, "far"))
    stop = lambda by: F.when(F.col("last"), F.col("end") + by).otherwise(F.col("next"))
    piece = lambda a, b, removed, first: F.struct(
        a.alias("from"), b.alias("to"), removed.alias("removed"), first.alias("first_id")
    )
    begin, own = F.col("begin"), F.col("doc_id")
    spans = spans.select("doc_id", "chain", "n_copies", F.explode(F.array(
        piece(begin - reached(0, "far"), begin - near(0), F.lit(False), own),
        piece(begin - near(0), stop(near(1)), F.col("removed"), F.col("first_id")),
        piece(stop(near(1)), stop(reached(1, "far")), F.lit(False), own),
    )).alias("piece")).select("doc_id", "chain", "n_copies", "piece.*").filter(F.col("from") < F.col("to"))
    # Short repeats beside a part that is kept stay with it.
    kept = F.max((~F.col("removed")).cast("int")).over(chain) == 1
    spans = spans.withColumn("removed", F.col("removed") & ~(kept & (F.col("to") - F.col("from") < passage)))
    order = chain.orderBy("from", "to")
    turn = F.coalesce(F.col("removed") != F.lag("removed").over(order), F.lit(True)).cast("long")
    spans = spans.withColumn("turn", turn).withColumn("part", F.sum("turn").over(order))
    return spans.groupBy("doc_id", "chain", "part").agg(
        F.min("from").cast("long").alias("begin"), F.max("to").cast("long").alias("end"),
        F.min("first_id").alias("first_id"), F.max("n_copies").alias("n_copies"), F.first("removed").alias("removed"),
    ).select(F.col("doc_id").alias(id_col), "begin", "end", "first_id", "n_copies", "removed")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """``docs`` without the spans that an earlier document keeps."""
    pair = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    mine = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    cut_col, key_col = mine + "cut", mine + "id"
    spans = materialize(
        repeated_spans(docs, id_col, passage).filter("removed").groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).cast(ArrayType(pair)).alias(cut_col)), "cuts",
    )
    marked = docs.join(spans.withColumnRenamed(id_col, key_col), F.col(id_col).eqNullSafe(F.col(key_col)), "left")

    def without(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = tx.column(batch, "text").to_pylist()
        for k, cut in enumerate(tx.column(batch, cut_col).to_pylist()):
            if cut and texts[k]:
                raw, at, parts = texts[k].encode(), 0, []
                for s in cut:
                    parts.append(raw[at : s["begin"]])
                    at = max(at, s["end"])
                texts[k] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
        return [pa.array(texts, pa.string())]

    return tx.map_rows(marked, [docs.schema["text"]], without).select(*docs.columns)
