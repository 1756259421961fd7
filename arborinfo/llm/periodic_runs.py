"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least max(``LEAST``, 3 q) long, that no
neighbouring word extends. Words of a batch of texts are one array of residues modulo a prime. At
the scale B (8, 16, 32, ...) aligned blocks are looked for in the words that follow them: for each
block and each distance d from B to 2 B the sum of squared differences

    sum p_j^2 + sum t_{j+d}^2 - 2 sum p_j t_{j+d}

is taken exactly modulo the prime, its last term as a product of number-theoretic transforms. A
run of period q >= 8 holds an aligned block of B <= q < 2 B words and the same block q words on, so
that its sum is zero; shorter periods are met at the scale 8, since a run has 24 words. Where the sum
is zero, the distance seeds an extension to both sides that compares words themselves, so every run
found is true and none is missed. Blocks of more than ``WIDEST`` words are looked for by their first
``WIDEST`` words, in windows of as many distances, so memory does not follow the scale.

The transforms of a scale are matrix products in double precision over all blocks; sums stay
below 2^53 and hence are exact. Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text. Rows are
independent; repeated ones give the same result each. A text of any length is taken whole.
Columns named runs, n_words or collapsed are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from arborinfo.llm import text as tx

LEAST = 24
SMALLEST, WIDEST = 8, 64
#: 7 * 2^20 + 1, with the primitive root 3: transforms of up to 2^20 points.
PRIME = 7_340_033
ROOT = 3
#: Blocks that are transformed at a time.
ROWS = 8192
INSIDE = ~tx.byte_class((0x20, 0x20), (0x09, 0x0D))
RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


def reduced(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^53 modulo the prime; a result may be off by the prime next to 0 and p."""
    return x - np.floor(x * (1.0 / PRIME)) * PRIME


@lru_cache(maxsize=None)
def transforms(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of a transform of 2 ``block`` points: for reversed blocks, for windows, and back."""
    n = 2 * block
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    power = np.array([pow(root, k, PRIME) for k in range(n)], np.float64)
    at = np.outer(np.arange(n), np.arange(n)) % n
    forth, back = power[at], power[-at % n]
    return back[:block].copy(), forth, reduced(back[:, :block] * pow(n, -1, PRIME))


def zero_distances(
    value: np.ndarray, square: np.ndarray, begin: np.ndarray, after: np.ndarray, block: int
) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks occur again: (number of the pair, shift), in order.

    Block k has ``block`` values from ``begin[k]``; shifts count from ``after[k]`` and are below
    ``block``. ``square`` has running sums of squares.
    """
    to_block, to_window, back = transforms(block)
    inner = np.arange(2 * block)
    found: list[np.ndarray] = []
    shifts: list[np.ndarray] = []
    for low in range(0, len(begin), ROWS):
        b, a = begin[low : low + ROWS], after[low : low + ROWS]
        blocks = value[b[:, None] + inner[:block]]
        windows = value[a[:, None] + inner]
        product = reduced(reduced(blocks @ to_block) * reduced(windows @ to_window))
        cross = reduced(product @ back)
        starts = a[:, None] + inner[:block]
        own = (square[b + block] - square[b])[:, None] + square[starts + block] - square[starts]
        rest = reduced((own % PRIME).astype(np.float64) - 2.0 * cross)
        row, shift = np.nonzero((rest == 0) | (rest == PRIME) | (rest == -PRIME))
        found.append(row + low)
        shifts.append(shift)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(shifts)


def reach(word: np.ndarray, at: int, distance: int, limit: int) -> int:
    """First place from ``at`` on, before ``limit``, whose word differs from that ``distance`` on."""
    step = 32
    while at < limit:
        end = min(at + step, limit)
        odd = word[at:end] != word[at + distance : end + distance]
        if odd.any():
            return at + int(odd.argmax())
        at, step = end, 2 * step
    return limit


def reach_back(word: np.ndarray, at: int, distance: int, limit: int) -> int:
    """The smallest place down to ``limit`` from which on all words up to ``at`` repeat."""
    step = 32
    while at > limit:
        begin = max(at - step, limit)
        odd = word[begin:at] != word[begin + distance : at + distance]
        if odd.any():
            return at - int(odd[::-1].argmax())
        at, step = begin, 2 * step
    return limit


def pairs_of(first: np.ndarray, block: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a scale and their windows: begins, where shifts count from, last distance asked.

    ``first`` has the first word of each word's text, ``ends`` the end of it. A block takes part if it
    and its nearest repetition lie in one text.
    """
    width = min(block, WIDEST)
    begin = np.arange(0, len(first), block)
    begin = begin[begin + width <= ends[begin]]
    # Distances below the smallest scale are asked there too.
    froms = [1, block] if block == SMALLEST else list(range(block, 2 * block, width))
    begins, afters = [], []
    for distance in froms:
        fits = begin[begin + distance + width <= ends[begin]]
        begins.append(fits)
        afters.append(fits + distance)
        if not len(fits):
            break
    return np.concatenate(begins), np.concatenate(afters), width


def runs_of_words(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of the texts in one array of word hashes; text k has words offsets[k] to offsets[k + 1].

    Rows (start, length, period), starts counted in their text, by text, start and period; and the
    number of rows before each text.
    """
    n = len(word)
    sizes = np.diff(offsets)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    begins, ends = offsets[:-1][text_of], offsets[1:][text_of]
    longest = int(sizes.max()) if len(sizes) else 0
    pad = np.zeros(2 * WIDEST)
    value = np.concatenate([(word % np.uint64(PRIME)).astype(np.float64), pad])
    square = np.concatenate([[0], np.cumsum(value.astype(np.int64) ** 2 % PRIME), ])
    # The shortest known period at each word, and where its run ends: multiples of it are no news.
    period, until = np.zeros(n, np.int64), np.zeros(n, np.int64)
    known: dict[tuple[int, int], int] = {}
    block = SMALLEST
    while 3 * block <= longest or (block == SMALLEST and longest >= LEAST):
        # A text takes part if the smallest run of the scale fits.
        open_words = np.flatnonzero(sizes >= max(LEAST, 3 * block))
        if not len(open_words):
            break
        begin, after, width = pairs_of(begins, block, ends)
        fits = np.isin(text_of[begin], open_words, assume_unique=False) if len(open_words) < len(sizes) else slice(None)
        begin, after = begin[fits], after[fits]
        row, shift = zero_distances(value, square, begin, after, width)
        at, distance = begin[row], after[row] - begin[row] + shift
        same = at + distance + width <= ends[at]
        news = same & ~(
            (period[at] > 0) & (distance % np.maximum(period[at], 1) == 0) & (at + distance + width <= until[at])
        )
        at, distance = at[news], distance[news]
        order = np.lexsort((at, distance))
        last, covered = 0, 0
        for i, d in zip(at[order].tolist(), distance[order].tolist()):
            if d == last and i < covered:
                continue
            first, end = int(begins[i]), int(ends[i])
            stop = reach(word, i, d, end - d)
            last, covered = d, stop
            if stop < i + width:  # equal modulo the prime only
                continue
            start = reach_back(word, i, d, first)
            length = stop + d - start
            if length < max(LEAST, 3 * d) or (start, stop + d) in known:
                continue
            known[start, stop + d] = d
            part = slice(start, stop + d)
            shorter = (period[part] == 0) | (period[part] > d)
            period[part][shorter], until[part][shorter] = d, stop + d
        block *= 2
    if not known:
        return np.zeros((0, 3), np.int64), np.zeros(len(sizes) + 1, np.int64)
    found = np.array([(s, e - s, d) for (s, e), d in known.items()], np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    texts = text_of[found[:, 0]]
    counts = np.searchsorted(texts, np.arange(len(sizes) + 1))
    found[:, 0] -= offsets[texts]
    return found, counts


def kept_words(found: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the words that no run contains after its first period."""
    change = np.zeros(int(offsets[-1]) + 1, np.int64)
    base = np.repeat(offsets[:-1], np.diff(counts))
    np.add.at(change, base + found[:, 0] + found[:, 2], 1)
    np.add.at(change, base + found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def joined(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, offsets: np.ndarray
) -> pa.Array:
    """The kept words of each text, joined by one space."""
    place = np.concatenate([[0], np.cumsum(keep)])
    first = place[offsets[:-1]]
    kept = np.diff(place[offsets])
    starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1  # a space before each word, the first one's is left out
    total = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(total[-1]) + np.repeat(starts - 1 - total[:-1], sizes)
    out = data[np.maximum(source, 0)]
    out[total[:-1]] = 32
    whole = np.ones(len(out), bool)
    whole[total[first[kept > 0]]] = False
    lengths = total[first + kept] - total[first] - (kept > 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(out[whole].tobytes())]
    ).cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, runs (structs of start, length, period, by start and period) and
    collapsed: the words that no run repeats, joined by spaces."""

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        data, bounds = tx.buffers(tx.column(batch, "text"))
        starts, ends, offsets = tx.find_words(data, bounds, INSIDE)
        word = tx.hash_spans(data, starts, ends)
        found, counts = runs_of_words(word, offsets)
        structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found.T], names=RUN.names)
        keep = kept_words(found, counts, offsets)
        return [
            pa.array(np.diff(offsets), pa.int64()), tx.ragged(counts, structs),
            joined(data, starts, ends, keep, offsets),
        ]

    fields = [
        StructField("n_words", LongType()), StructField("runs", ArrayType(RUN, False)),
        StructField("collapsed", StringType()),
    ]
    return tx.map_rows(docs, fields, find)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, exactly compared; of equal ones the first, null if none."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), runs[0], better))


def listed(runs: Column) -> Column:
    """One line ``start,length,period`` a run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Texts of the fixed tenth of documents whose words repeat from some word on.

    With h the CRC-32 of the decimal doc_id and g = h // 10, a text with h % 10 = 0 has n words; from
    word a = g % n on they repeat with the period 1 + (n - a) // (3 + g % 8). Other texts stay, and so
    do those of a null doc_id.
    """
    number = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumns({
        "_g": F.floor(number / 10),
        "_words": F.when(number % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))),
    })
    n = F.size("_words").cast("long")
    start = F.when(n > 0, F.col("_g") % F.greatest(n, F.lit(1)))
    placed = chosen.withColumns({"_a": start, "_p": 1 + F.floor((n - start) / (3 + F.col("_g") % 8))})
    moved = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    repeated = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.get("_words", moved(i).cast("int"))
    )
    return placed.withColumn(
        "text", F.when(F.col("_a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    ).select(*docs.columns)
