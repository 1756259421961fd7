"""Token counts of a byte-pair vocabulary by rank-synchronous merging of arrays.

Texts are cut into pre-tokens at spaces (no piece reaches over such a border). The pre-tokens of
a batch are held as one ragged array of symbols. In every round each pre-token's lowest-rank pair
(the leftmost among equals) is merged, for all pre-tokens at once; the two neighbouring pairs are
looked up anew, and pre-tokens without a pair leave. What survives is counted; a character that
no piece covers counts one token per UTF-8 byte. Pre-tokens longer than ``LONG`` symbols take the
same merges from a heap, since one merge per round would take quadratic time on them.

Frequent pre-tokens are remembered per worker, up to ``REMEMBERED`` of them.

Defined cases: a null text is an empty one, and an empty text has no tokens. Rows are independent.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from arborinfo.llm import text as tx
from arborinfo.llm.pieces import SPACE, Vocabulary, code_points, keys_of, utf8_sizes

LONG = 400
REMEMBERED = 300_000
NONE = np.int64(1) << 31


class Merger:
    """Merge tables of a vocabulary: which pairs of symbols join, in what order, to what."""

    def __init__(self, vocabulary: Vocabulary):
        symbols = dict(vocabulary.piece)
        for char in sorted({c for piece in vocabulary.piece for c in piece} - symbols.keys()):
            symbols[char] = -2 - len(symbols)  # joins, but is no piece itself
        number = {s: k for k, s in enumerate(sorted(symbols))}
        self.is_piece = np.array([symbols[s] >= 0 for s in number], bool)
        self.size = len(number)
        # Equal scores share a rank; then the leftmost pair comes first.
        rank = {s: r for r, s in enumerate(sorted({-v for v in vocabulary.score.values()}))}
        rows = []
        for piece, i in vocabulary.piece.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * self.size + right, rank[-vocabulary.score[i]], number[piece]))
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.key, self.rank, self.joined = (np.ascontiguousarray(c) for c in table.T)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, which begins with the space mark."""
        points, sizes = code_points(words)
        symbol = self.of_char[points]
        row = np.repeat(np.arange(len(words)), sizes)
        stray = np.where((symbol < 0) | ~self.is_piece[symbol], utf8_sizes(points), 1)
        out = np.zeros(len(words), np.int64)
        begin = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > LONG):
            piece = slice(begin[k], begin[k] + sizes[k])
            out[k] = self._by_heap(symbol[piece].tolist(), stray[piece].tolist())
        short = (sizes <= LONG)[row]
        symbol, row, cost = symbol[short], row[short], stray[short]
        pair = self._pairs(symbol, row)
        while len(symbol):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            spread = np.int64(len(symbol))
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            best = np.minimum.reduceat(rank * spread + np.arange(spread), first)
            going = best < NONE * spread
            if not going.all():
                out_row = row[first[~going]]
                total = np.add.reduceat(cost, first)
                out[out_row] = total[~going]
                stay = np.repeat(going, np.diff(np.append(first, spread)))
                moved = np.cumsum(stay) - 1
                symbol, row, cost, pair = symbol[stay], row[stay], cost[stay], pair[stay]
                if not len(symbol):
                    break
                at = moved[(best % spread)[going]]
            else:
                at = best % spread
            symbol[at] = self.joined[pair[at]]
            cost[at] = 1
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, row, cost, pair = symbol[left], row[left], cost[left], pair[left]
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[at > 0] - 1])
            pair[touched] = self._pairs(symbol, row, touched)
        return out

    def _pairs(self, symbol: np.ndarray, row: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The pair of each symbol (or those at ``at``) with the next one of its row."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, len(symbol) - 1)
        found = self.pair(symbol[at], symbol[after])
        return np.where((row[at] == row[after]) & (after > at), found, -1)

    def _by_heap(self, symbol: list[int], cost: list[int]) -> int:
        """The same merges for one long word, in n log n steps."""
        after = [*range(1, len(symbol)), -1]
        before = [-1, *range(len(symbol) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            lefts = [x for x in lefts if x >= 0 and after[x] >= 0]
            if not lefts:
                return
            a, b = [symbol[x] for x in lefts], [symbol[after[x]] for x in lefts]
            for x, l, r, p in zip(lefts, a, b, self.pair(np.array(a), np.array(b)).tolist()):
                if p >= 0:
                    heapq.heappush(heap, (int(self.rank[p]), x, l, r, int(self.joined[p])))

        offer(list(range(len(symbol))))
        while heap:
            _, x, l, r, joined = heapq.heappop(heap)
            y = after[x]
            if symbol[x] != l or y < 0 or symbol[y] != r:
                continue
            symbol[x], cost[x] = joined, 1
            symbol[y], cost[y] = -3, 0
            after[x] = after[y]
            if after[y] >= 0:
                before[after[y]] = x
            offer([before[x], x])
        return sum(cost)


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(Vocabulary(path))


_known: dict[str, dict[str, int]] = {}


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; pre-tokens met before are looked up."""
    split = [keys_of(t or "") for t in texts]
    known = _known.setdefault(path, {})
    new = list(set().union(*map(set, split)).difference(known))
    if new:
        known.update(zip(new, merger(path).count([SPACE + w for w in new]).tolist()))
    out = [sum(map(known.__getitem__, words)) for words in split]
    if len(known) > REMEMBERED:
        known.clear()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(count_texts(tx.column(batch, "text").to_pylist(), path), pa.int64())]

    counted = tx.map_rows(docs, [StructField("n_tokens", LongType())], count)
    return counted.withColumns({
        "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"),
        "over_limit": F.col("n_tokens") > limit,
    })
