"""Benchmark passages in documents, found with a generalised suffix automaton over words.

A window is ``WINDOW`` consecutive words of an item, or the whole item when it is shorter. The
automaton of all items is built once per block of items and broadcast; a block holds at most
``block_bytes`` of item text, so the size of what is broadcast is bounded, and further blocks
are further passes over the same rows. Documents are streamed through it word by word; the
longest matching length tells which words a window covers. Stretches of text whose word pairs
do not occur in any item cannot hold a match and are passed over with array code first.

Defined cases: a null text has no words; items without words have no window; an item id is
counted once however many rows carry it, and items with a null id are counted under the empty
string; no items at all means no hits. Rows are independent, so ties, repeated rows and extra
columns change nothing; a column named like an output is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
)

from arborinfo.lineage import broadcast
from arborinfo.llm import text as tx

WINDOW = 13
#: Digits, a-z (after lower-casing) and everything beyond ASCII.
WORD = tx.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


class ItemAutomaton:
    """Suffix automaton of many word sequences, with the items of each window at its state."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        self.vocabulary = known
        coded = [(item, np.searchsorted(known, h).tolist()) for item, h in items if len(h)]
        pairs = {a * len(known) + b for _, seq in coded for a, b in zip(seq, seq[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        for _, seq in coded:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        #: Items by the state that holds a window; (length, item) of whole short items.
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        self.shortest = min([window, *(len(seq) for _, seq in coded)])
        for item, seq in coded:
            state = 0
            for k, word in enumerate(seq, 1):
                state = self.next[state][word]
                if k >= window:
                    self.windows.setdefault(self._holding(state, window), set()).add(item)
            if len(seq) < window:
                at = self._holding(state, len(seq))
                self.short.setdefault(at, set()).add((len(seq), item))

    def _new(self, length: int, copied: int = -1) -> int:
        self.length.append(length)
        self.link.append(self.link[copied] if copied >= 0 else 0)
        self.next.append(dict(self.next[copied]) if copied >= 0 else {})
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the word after ``state``, apart from longer strings of ``target``."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, target)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        state = self._new(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        self.link[state] = 0 if at < 0 else self._split(at, word, self.next[at][word])
        return state

    def _holding(self, state: int, length: int) -> int:
        """The state on the suffix path of ``state`` whose strings include that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered ranges of a word sequence (words outside the items are -1), and the items."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.next[state]:
                continue
            state, matched = self.next[state][word], matched + 1
            reach = 0
            if matched >= self.window:
                reach = self.window
                items |= self.windows[self._holding(state, self.window)]
            if self.short:
                at = state
                while at > 0:
                    for size, item in self.short.get(at, ()):
                        if size <= matched:
                            reach = max(reach, size)
                            items.add(item)
                    at = self.link[at]
            if reach:
                begin = k + 1 - reach
                while ranges and ranges[-1][1] >= begin:
                    begin = min(begin, ranges.pop()[0])
                ranges.append((begin, k + 1))
        return ranges, items

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, codes: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words in which every neighbouring pair occurs in some item."""
        known = codes >= 0
        joined = np.zeros(len(codes), bool)  # with the word before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both) and len(self.pairs):
            key = codes[both - 1] * len(self.vocabulary) + codes[both]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            joined[both] = self.pairs[at] == key
        joined[cuts[cuts < len(codes)]] = False
        starts = np.flatnonzero(known & ~joined)
        goes_on = np.append(joined[1:], False)
        ends = np.flatnonzero(known & ~goes_on) + 1
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))


def word_hashes(texts: pa.Array):
    data, offsets = tx.buffers(texts)
    data = tx.LOWER[data]
    starts, ends, cuts = tx.find_words(data, offsets, WORD)
    return tx.hash_spans(data, starts, ends), starts, ends, cuts, offsets, data


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (item id, word hashes), each of at most ``block_bytes`` of text or one item."""
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        table = part.distinct().orderBy("item", "text").toArrow().combine_chunks()
        texts = table.column("text")
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        hashes, _, _, cuts, _, _ = word_hashes(texts)
        names = table.column("item").to_pylist()
        yield [(name, hashes[cuts[k] : cuts[k + 1]]) for k, name in enumerate(names)]


def mark_benchmark(
    docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = 16 << 20, cut: bool = False,
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted ids), hit_spans (in words) and
    hit_bytes (the same spans in bytes of the text, end exclusive).

    ``cut`` leaves the spans out of the text in the same pass.
    """
    fields = [
        StructField("n_words", LongType()), StructField("n_hit", LongType()),
        StructField("hit_items", ArrayType(StringType())), StructField("hit_spans", SPANS),
        StructField("hit_bytes", SPANS),
    ]
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    spark = docs.sparkSession
    marked = docs
    blocks = list(item_blocks(benchmark, item_col, item_text, block_bytes))
    for k, items in enumerate(blocks):
        automaton = broadcast(spark, ItemAutomaton(items, window))
        last = cut and k == len(blocks) - 1

        def mark(batch: pa.RecordBatch, automaton=automaton, again=k > 0, last=last) -> list[pa.Array]:
            auto: ItemAutomaton = automaton.value
            hashes, starts, ends, cuts, offsets, _ = word_hashes(tx.column(batch, "text"))
            codes = auto.codes(hashes)
            spans: dict[int, list[tuple[int, int]]] = {}
            found: dict[int, set[str]] = {}
            if again:
                for d, (old, names) in enumerate(zip(
                    tx.column(batch, "hit_spans").to_pylist(), tx.column(batch, "hit_items").to_pylist()
                )):
                    if old:
                        spans[d], found[d] = [(s["start"], s["end"]) for s in old], set(names)
            for begin, end in auto.stretches(codes, cuts[:-1]):
                ranges, items_ = auto.stream(codes[begin:end].tolist())
                if ranges:
                    d = int(np.searchsorted(cuts, begin, "right")) - 1
                    spans.setdefault(d, []).extend(
                        (a + begin - int(cuts[d]), b + begin - int(cuts[d])) for a, b in ranges
                    )
                    found.setdefault(d, set()).update(items_)
            n = batch.num_rows
            joined = [join_ranges(spans.get(d, [])) for d in range(n)]
            in_bytes = [
                [(int(starts[cuts[d] + a] - offsets[d]), int(ends[cuts[d] + b - 1] - offsets[d])) for a, b in r]
                for d, r in enumerate(joined)
            ]
            as_list = lambda rows: pa.array(
                [[{"start": a, "end": b} for a, b in r] for r in rows], pa.list_(pair)
            )
            return [
                pa.array(np.diff(cuts), pa.int64()),
                pa.array([sum(b - a for a, b in r) for r in joined], pa.int64()),
                pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                as_list(joined), as_list(in_bytes), *([without(tx.column(batch, "text"), in_bytes)] if last else []),
            ]

        marked = tx.map_rows(marked, fields + ([docs.schema["text"]] if last else []), mark)
    return marked


def without(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """Texts without the given spans of bytes."""
    if not any(spans):
        return texts
    out = texts.to_pylist()
    for k, cuts in enumerate(spans):
        if cuts:
            raw, at, parts = out[k].encode(), 0, []
            for begin, end in cuts:
                parts.append(raw[at:begin])
                at = end
            out[k] = b"".join([*parts, raw[at:]]).decode()
    return pa.array(out, texts.type)


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def contamination(marked: DataFrame, share: int = 20) -> DataFrame:
    """n_items, items_sha256 and contaminated (one word in ``share`` or more is hit)."""
    return marked.withColumns({
        "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")),
    })


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Drop contaminated documents and cut the remaining covered spans out of the others."""
    marked = contamination(mark_benchmark(docs, benchmark, cut=True, **options))
    return marked.filter(~F.col("contaminated")).select(*docs.columns)
