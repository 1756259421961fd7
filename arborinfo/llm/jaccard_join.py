"""Jaccard join of documents on word shingles, exact, by prefixes of token combinations.

A document is the set of its five-word shingles (64-bit hashes). Two documents link when 100 times
their common shingles are at least 75 times the united ones.

1. *Sets.* A map over the texts gives size and a 128-bit digest of each set (equal sets are one
   class from here on) and finds the frequent shingles, those in about one document of ``SHARE``
   or more. There are at most ``SHARE`` times the mean set size of them, whatever the corpus, and
   they are broadcast.
2. *Frequencies.* Each slice of documents sends its other shingles, packed as 32-bit rests with
   16-bit document numbers, to shards by range of hash. A shard keeps those that occur in two or
   more documents and sends them back to their slice with the count. Frequent shingles do not
   travel to shards, so no shard grows with a passage that many documents share.
3. *Prefixes.* A document's shingles are ordered: unique ones, then rare ones by frequency, then
   frequent ones. A linked pair's first common shingle is among the first n/4 + 1 of both, so a
   document whose unique shingles fill that prefix links with nothing; most documents end here.
   Rare shingles of the prefix are indexed one by one. When the prefix reaches the frequent class,
   it is extended to n/2 - 2r + 2 frequent shingles (r: the ones before) and pairs of neighbours
   in it are indexed: a pair of documents without a common rare shingle has more common frequent
   shingles there than its differences can keep apart, so some two of them are neighbours in both.
4. *Verification.* Under each key all documents are compared with one, the document with the fewest
   unique shingles, which connects groups of copies with one comparison per document and key.
   Then every pair that shares a key, is in two components and passes the size and position
   filters is compared. So no link between components is missed, and no group's pairs are all
   written out. Comparisons intersect the shared shingles, whose number is exact.

Defined cases: a null text, or one without words, has the empty set and is a component of its own;
fewer than five words are one shingle; rows of equal sets are one class whatever their ids; the id
of a component is its smallest id that is not null; extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.rng import mix64
from arborinfo.lineage import broadcast, materialize, ship_package
from arborinfo.llm import text as tx
from arborinfo.llm.components import components

SHINGLE = 5
#: Anything but a blank and tab to carriage return.
WORD = ~tx.byte_class((0x20, 0x20), (0x09, 0x0D))
WEIGHTS = mix64(np.arange(100, 100 + SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
SHARE = 100
#: Rare shingles of one shard.
SHARD_TOKENS = 500_000
LINK_SLICE = 2 << 20


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = tx.buffers(texts)
    data = tx.LOWER[data]
    starts, ends, cuts = tx.find_words(data, offsets, WORD)
    words = tx.hash_spans(data, starts, ends)
    sums = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        if len(words) > k:
            sums[: len(words) - k] += words[k:] * WEIGHTS[k]
    hashes = mix64(sums)
    out = []
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if end - begin >= SHINGLE:
            out.append(np.unique(hashes[begin : end - SHINGLE + 1]))
        elif end > begin:
            n = end - begin
            parts = np.append(words[begin:end], np.uint64(n)) * np.append(WEIGHTS[:n], WEIGHTS[SHINGLE])
            out.append(mix64(parts.sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(tokens: np.ndarray) -> bytes | None:
    """128 bits of a set, None of the empty one."""
    if not len(tokens):
        return None
    one, two = mix64(tokens).sum(keepdims=True), mix64(tokens ^ WEIGHTS[0]).sum(keepdims=True)
    return np.concatenate([one, two ^ np.uint64(len(tokens))]).tobytes()


def describe_sets(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every row, and (tok, cnt) of shingles that are frequent in a slice."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches):
        for batch in batches:
            for part in tx.row_slices(batch, LINK_SLICE):
                sets = shingle_sets(tx.column(part, "text"))
                n = len(sets)
                found = {}
                for s in sets:  # equal sets of a slice count once here
                    found.setdefault(digest(s), s)
                found.pop(None, None)
                tokens, count = np.unique(
                    np.concatenate([np.zeros(0, np.uint64), *found.values()]), return_counts=True
                )
                often = count >= max(4, len(found) // (2 * SHARE))
                more = int(often.sum())
                ids = tx.column(part, "doc_id")
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([ids, pa.nulls(more, ids.type)]),
                    pa.array([len(s) for s in sets] + [None] * more, pa.int64()),
                    pa.array([digest(s) for s in sets] + [None] * more, pa.binary()),
                    pa.array([None] * n + tokens[often].astype(np.int64).tolist(), pa.int64()),
                    pa.array([None] * n + count[often].tolist(), pa.int64()),
                ], names=["doc_id", "n", "cls", "tok", "cnt"])

    schema = f"doc_id {kind.simpleString()}, n long, cls binary, tok long, cnt long"
    made = materialize(rows.mapInArrow(describe, schema), "sets")
    return (
        made.filter("n is not null").select("doc_id", "n", "cls"),
        made.filter("tok is not null").select("tok", "cnt"),
    )


def shared_shingles(docs: DataFrame, frequent: np.ndarray, shards: int) -> DataFrame:
    """(id, cls, n, unique, rare, tokens) of the sets that may link: their shingles that occur in
    other documents, in order (rare by frequency, then frequent), as 48-bit numbers."""
    heavy = broadcast(docs.sparkSession, frequent)
    wide = np.uint64(shards)

    def spread(batches):
        place, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in tx.row_slices(batch, LINK_SLICE):
                found = {}
                for s in shingle_sets(tx.column(part, "text")):
                    found.setdefault(digest(s), s)
                found.pop(None, None)
                if not found:
                    continue
                slice_id, seq = (place << 24) + seq, seq + 1
                sizes = np.array([len(s) for s in found.values()], np.int32)
                tokens = np.concatenate(list(found.values()))
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
                known = heavy.value
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                often = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                tokens >>= np.uint64(16)
                rows = [
                    (slice_id % shards, 2, sizes.tobytes(), b"".join(found), b""),
                    (slice_id % shards, 1, tokens[often].tobytes(), owner[often].tobytes(), b""),
                ]
                order = np.argsort(tokens)
                order = order[~often[order]]
                tokens, owner = tokens[order], owner[order]
                shard = (tokens * wide) >> np.uint64(48)
                cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                low, high = tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.int64)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    piece = slice(cut[k], cut[k + 1])
                    tops = np.bincount(high[piece] - first_top(k, shards)).astype(np.uint32)
                    rows.append((k, 0, low[piece].tobytes(), owner[piece].tobytes(), tops.tobytes()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int32()), pa.array([slice_id] * len(rows), pa.int64()),
                    pa.array(columns[1], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[2:]],
                ], names=["shard", "slice", "kind", "a", "b", "c"])

    def counted(table: pa.Table) -> pa.Table:
        mine = table.filter(pa.compute.equal(table.column("kind"), 0))
        rest = table.filter(pa.compute.not_equal(table.column("kind"), 0)).drop_columns("shard")
        if not mine.num_rows:
            return rest
        base = first_top(mine.column("shard")[0].as_py(), shards)
        lows = [np.frombuffer(x, np.uint32) for x in mine.column("a").to_pylist()]
        owners = [np.frombuffer(x, np.uint16) for x in mine.column("b").to_pylist()]
        tops = [np.frombuffer(x, np.uint32) for x in mine.column("c").to_pylist()]
        tokens = np.concatenate([
            low.astype(np.uint64) | (np.repeat(np.arange(len(top)) + base, top).astype(np.uint64) << np.uint64(32))
            for low, top in zip(lows, tops)
        ])
        row = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        owner = np.concatenate(owners)
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        times = np.diff(np.append(first, len(ordered)))
        count = np.empty(len(tokens), np.uint32)
        count[order] = np.repeat(times, times)
        keep = count > 1
        cut = np.searchsorted(row[keep], np.arange(len(lows) + 1))
        back = [x[keep] for x in (tokens, owner, count)]
        some = np.flatnonzero(np.diff(cut)).tolist()
        pack = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary())
        sent = pa.table({
            "slice": mine.column("slice").combine_chunks().take(pa.array(some, pa.int64())),
            "kind": pa.array([0] * len(some), pa.int32()), "a": pack(back[0]), "b": pack(back[1]), "c": pack(back[2]),
        })
        return pa.concat_tables([sent, rest.cast(sent.schema)])

    def gathered(table: pa.Table) -> pa.Table:
        tokens, owner, weight = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for kind, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c"))):
            if kind == 2:
                sizes = np.frombuffer(a, np.int32)
                classes = [b[16 * k : 16 * k + 16] for k in range(len(sizes))]
            else:
                tokens.append(np.frombuffer(a, np.uint64))
                owner.append(np.frombuffer(b, np.uint16))
                weight.append(
                    np.frombuffer(c, np.uint32).astype(np.int64) if kind == 0
                    else np.full(len(owner[-1]), 1 << 40, np.int64)
                )
        tokens, owner, weight = (np.concatenate(x) for x in (tokens, owner, weight))
        shared = np.bincount(owner, minlength=len(sizes))
        good = sizes - shared <= sizes // 4
        mine = good[owner]
        tokens, owner, weight = tokens[mine], owner[mine], weight[mine]
        order = np.lexsort((tokens, weight, owner))
        tokens, owner, weight = tokens[order], owner[order], weight[order]
        which = np.flatnonzero(good)
        begin, end = np.searchsorted(owner, which), np.searchsorted(owner, which, "right")
        rare = [int((weight[b:e] < 1 << 40).sum()) for b, e in zip(begin, end)]
        return pa.table({
            "cls": pa.array([classes[k] for k in which], pa.binary()),
            "n": pa.array(sizes[which], pa.int32()),
            "unique": pa.array((sizes - shared)[which].astype(np.int32)),
            "rare": pa.array(rare, pa.int32()),
            "tokens": tx.ragged(np.append(0, end), pa.array(tokens.astype(np.int64))),
        })

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        spread, "shard int, slice long, kind int, a binary, b binary, c binary"
    )
    back = packed.groupBy("shard").applyInArrow(counted, "slice long, kind int, a binary, b binary, c binary")
    sets = back.groupBy("slice").applyInArrow(
        gathered, "cls binary, n int, unique int, rare int, tokens array<bigint>"
    )
    # Equal sets of several slices hold the same shingles: one of them stays.
    first = F.first(F.struct("n", "unique", "rare", "tokens")).alias("s")
    # Written once, so the numbers stay.
    number = F.monotonically_increasing_id().alias("id")
    return materialize(sets.groupBy("cls").agg(first).select(number, "cls", "s.*"), "shared")


def first_top(shard: int, shards: int) -> int:
    """Upper 16 bits of the smallest 48-bit number of a shard."""
    return ((shard << 48) // shards) >> 32


def index_keys(sets: DataFrame) -> DataFrame:
    """(key, id, n, pos, odd): the keys of each set's prefix.

    ``pos`` shingles of the set are not common to a pair that has this key as its first; ``odd`` is
    the set's share of unique shingles.
    """

    def keys(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            lists = batch.column(4)
            flat_tokens = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            for number, n, unique, rare, end in zip(*(c.to_pylist() for c in batch.columns[:4]), ends.tolist()):
                tokens = flat_tokens[end - (n - unique) : end]
                singles = tokens[: max(0, min(rare, n // 4 + 1 - unique))]
                key = [mix64(singles)]
                pos = [np.arange(len(singles)) + unique]
                before = unique + rare
                if before <= n // 4:
                    often = tokens[rare : rare + max(2, n // 2 - 2 * before + 2)]
                    if len(often) > 1:
                        key.append(mix64(often[:-1] * WEIGHTS[0] + often[1:] * WEIGHTS[1]))
                        # Pairs with a common rare shingle have that as their first key.
                        pos.append(np.full(len(often) - 1, before))
                key, pos = np.concatenate(key), np.concatenate(pos)
                for x, values in zip(out, (
                    key.astype(np.int64), np.full(len(key), number), np.full(len(key), n), pos,
                    np.full(len(key), 1000 * unique // n),
                )):
                    x.append(values)
            if out[0]:
                flat = [np.concatenate(x) for x in out]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(flat, kinds)], names=["key", "id", "n", "pos", "odd"]
                )

    rows = sets.select("id", "n", "unique", "rare", "tokens")
    return rows.mapInArrow(keys, "key long, id long, n int, pos int, odd int")


def may_link(a: str, b: str):
    """Whether two index rows with one key can be those of a linked pair.

    Sizes are within a quarter; the shingles that are not common are at most a seventh of both
    sizes, and the common ones, at least three sevenths, are after ``pos`` in either set.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    small, large = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    after = F.least(col(a, "n") - col(a, "pos"), col(b, "n") - col(b, "pos"))
    return (
        (4 * small >= 3 * large) & (7 * (col(a, "pos") + col(b, "pos")) <= small + large)
        & (7 * after >= 3 * (small + large))
    )


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar enough."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    same = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(100 * same >= 75 * (F.col("na") + F.col("nb") - same)).select("a", "b")


def links_of_sets(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all components of the sets' link graph."""
    index = materialize(index_keys(sets), "index")
    centre = F.min(F.struct("odd", "id", "n", "pos")).alias("h")
    hubs = materialize(
        index.groupBy("key").agg(centre, F.count("*").alias("rows")).filter("rows > 1").select("key", "h.*"), "hubs"
    )
    ordered = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    near = index.alias("x").join(hubs.alias("y"), "key").filter((F.col("x.id") != F.col("y.id")) & may_link("x", "y"))
    compared = materialize(near.select(*ordered).distinct(), "pairs")
    links = materialize(linked(compared, sets), "links")

    roots = materialize(components(links), "roots")
    of = index.join(roots, index["id"] == roots["node"], "left").select(
        "key", "id", "n", "pos", F.coalesce("root", "id").alias("root")
    )
    of = materialize(of, "index")
    open_keys = materialize(
        of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key"),
        "open",
    )
    rest = materialize(of.join(open_keys, "key", "left_semi"), "open")
    apart = rest.alias("x").join(rest.alias("y"), "key").filter(
        (F.col("x.root") < F.col("y.root")) & may_link("x", "y")
    )
    more = materialize(apart.select(*ordered).distinct(), "pairs")
    more = linked(more.join(compared, ["a", "b"], "left_anti"), sets)
    return materialize(links.union(more), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    facts, counts = describe_sets(docs, id_col)
    rows, shingles = facts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = counts.groupBy("tok").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") * SHARE >= rows)
    frequent = np.sort(often.select("tok").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    shards = int(min(max(64, -(-shingles // SHARD_TOKENS)), 1 << 16))
    sets = shared_shingles(docs, frequent, shards)
    roots = components(links_of_sets(sets))
    of = sets.select("id", "cls")
    named_roots = roots.join(of.withColumnsRenamed({"id": "node", "cls": "c"}), "node").join(
        of.withColumnsRenamed({"id": "root", "cls": "r"}), "root"
    )
    roots = materialize(named_roots.select(F.col("c").alias("node"), F.col("r").alias("root")), "roots")

    classes = facts.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    both = roots.select("node").union(roots.select("root")).distinct().withColumn("linked", F.lit(True))
    classes = classes.join(both, classes["cls"] == both["node"], "left").filter("rows > 1 or linked")
    placed = classes.drop("node").join(roots, F.col("cls") == F.col("node"), "left")
    placed = materialize(placed.select("cls", "low", F.coalesce("root", "cls").alias("root")), "classes")
    lowest = materialize(placed.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = materialize(placed.select("cls", "root").join(lowest, "root").select("cls", "component_id"), "named")
    return facts.join(named, "cls", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


#: Ids to drop up to this number are broadcast (a few bytes each), more are joined.
BROADCAST_IDS = 2_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component: the one whose id is the component's.

    Rows with a null id stay; of several rows with that id, all stay.
    """
    found = near_duplicates(docs, id_col)
    dropped = found.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    dropped = materialize(dropped, "dropped")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, id_col, "left_anti").select(*docs.columns)
