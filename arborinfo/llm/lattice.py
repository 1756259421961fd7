"""Encoding and decoding over the piece lattice of a sentencepiece vocabulary, with N-best lists.

A text is a chain of words (see ``pieces``): no piece reaches over their borders, so its lattice is
a chain of word lattices. Forward Viterbi runs over all new words of a batch at once, position by
position, on arrays. Its scores are exact heuristics: what a path still needs to reach the start
of a word is known, so a backward A-star search from the end of the word pops complete paths in
order of score. The gap to a word's second path is the smallest gap of an arc that enters a node
of the best path, which the forward scores give without a search; the N best segmentations of a
text can only differ in the N - 1 words with the smallest gaps, so A-star runs on those alone and
their lists are merged by total gap.

Scores: the model file holds ranks. A piece of rank r (from 0) has the log-probability
-log(r + 2) less the log of the sum, Zipf's law; a character without a piece is spelt in byte
pieces at the least of these less ``BYTE_PENALTY``. Equal scores go to the path whose last piece
that differs is longer.

Defined cases: a null or empty text has no ids, score 0 and no alternatives; a text with fewer
segmentations than asked for has fewer; decoding drops the space mark put in front of a text, and
any bytes that are not UTF-8 become replacement characters. A text that itself holds the space mark
decodes to a blank there, as in the library. Rows are independent.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from arborinfo.llm import text as tx
from arborinfo.llm.pieces import SPACE, Vocabulary, code_points, keys_of, utf8_sizes

BYTE_PENALTY = 10.0
REMEMBERED = 100_000
#: Characters of words that go through one pass of array code; each takes about 500 bytes there.
BLOCK = 150_000

EDIT = StructType([
    StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("ids", ArrayType(IntegerType())),
])
#: An alternative: replace ids[begin:end] of the best segmentation by each edit's ids.
ALTERNATIVE = StructType([StructField("score", DoubleType()), StructField("edits", ArrayType(EDIT))])


class Lattice:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        rank = {s: r for r, s in enumerate(sorted({-v for v in vocabulary.score.values()}))}
        mass = {p: 1 / (rank[-vocabulary.score[i]] + 2) for p, i in vocabulary.piece.items()}
        total = math.log(sum(mass.values()))
        self.score = {p: math.log(m) - total for p, m in mass.items()}
        self.byte_score = min(self.score.values()) - BYTE_PENALTY
        self.byte_ids = vocabulary.byte_id.tolist()
        self.longest = max(map(len, vocabulary.piece))
        # A trie: the node after a character; node 0 is the root.
        self.letter = np.full(0x110000, -1, np.int32)
        letters = sorted({c for p in vocabulary.piece for c in p})
        for k, c in enumerate(letters):
            self.letter[ord(c)] = k
        self.letters = len(letters)
        child: dict[int, int] = {}
        ids, scores = [-1], [0.0]
        for piece, i in vocabulary.piece.items():
            node = 0
            for c in piece:
                key = node * self.letters + int(self.letter[ord(c)])
                if key not in child:
                    child[key] = len(ids)
                    ids.append(-1)
                    scores.append(0.0)
                node = child[key]
            ids[node], scores[node] = i, self.score[piece]
        order = np.argsort(np.fromiter(child, np.int64, len(child)))
        self.key = np.fromiter(child, np.int64, len(child))[order]
        self.child = np.fromiter(child.values(), np.int32, len(child))[order]
        self.node_id, self.node_score = np.array(ids, np.int32), np.array(scores)
        self.first = np.full(self.letters + 1, -1, np.int32)
        low = self.key < self.letters
        self.first[self.key[low]] = self.child[low]

    def arcs(self, points: np.ndarray, left: np.ndarray):
        """Pieces at every place: (start, length, id, score), id -1 for characters without one.

        ``left`` is the number of characters from each place to the end of its word.
        """
        letter = self.letter[points]
        at = np.arange(len(points))
        node = self.first[letter]  # letter -1 takes the last entry, which is none
        single = np.where(node >= 0, self.node_id[node], -1)
        bare = np.flatnonzero(single < 0)
        out = [(bare, np.ones(len(bare), np.int64), np.full(len(bare), -1), np.full(len(bare), self.byte_score))]
        for length in range(1, self.longest + 1):
            alive = node >= 0
            at, node = at[alive], node[alive]
            ids = self.node_id[node]
            full = ids >= 0
            out.append((at[full], np.full(full.sum(), length), ids[full], self.node_score[node[full]]))
            more = left[at] > length
            at, node = at[more], node[more]
            if not len(at):
                break
            key = node.astype(np.int64) * self.letters + letter[at + length]
            known = letter[at + length] >= 0
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            node = np.where(known & (self.key[place] == key), self.child[place], -1)
        return tuple(np.concatenate(x) for x in zip(*out))

    def best(self, words: list[str]) -> list[tuple[float, float, bytes]]:
        """Score, gap to the second path, and ids (32-bit) of the best path of each word."""
        out, begin = [], 0
        sizes = np.cumsum([0, *map(len, words)])
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + BLOCK, "right")) - 1)
            out += self._best(words[begin:end])
            begin = end
        return out

    def _best(self, words: list[str]) -> list[tuple[float, float, bytes]]:
        points, sizes = code_points(words)
        stop = np.cumsum(sizes)
        left = np.repeat(stop, sizes) - np.arange(len(points))
        start, length, ids, score = self.arcs(points, left)
        # Node k + w is the place before character k of word w; each word has one node more.
        word = np.repeat(np.arange(len(words)), sizes)
        source = start + word[start]
        target = source + length
        origin = np.cumsum(sizes + 1) - sizes - 1
        depth = target - origin[word[start]]
        # By depth, then target, the longest piece first.
        order = np.argsort((depth * (len(points) + len(words) + 1) + target) * 64 - np.minimum(length, 63))
        source, target, ids, score, depth = source[order], target[order], ids[order], score[order], depth[order]
        forward = np.zeros(len(points) + len(words))
        back = np.full(len(forward), -1)
        value = np.empty(len(source))
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        group_depth = depth[first]
        bounds = np.append(first, len(source))
        steps = np.searchsorted(group_depth, np.arange(1, int(sizes.max(initial=0)) + 2))
        for low, high in zip(steps[:-1], steps[1:]):
            if low == high:
                continue
            a, b = bounds[low], bounds[high]
            value[a:b] = forward[source[a:b]] + score[a:b]
            top = np.maximum.reduceat(value[a:b], first[low:high] - a)
            forward[target[first[low:high]]] = top
            hit = np.flatnonzero(value[a:b] == np.repeat(top, np.diff(bounds[low : high + 1]))) + a
            # The first of equals is the longest piece.
            back[target[hit[::-1]]] = hit[::-1]
        last = origin + sizes
        gap = np.full(len(words), np.inf)
        of_node = np.full(len(forward), -1)
        of_node[target[first]] = np.arange(len(first))
        # Second-best arc into each node.
        other = np.where(np.arange(len(source)) == back[target], -np.inf, value)
        second = np.maximum.reduceat(other, first) if len(first) else other
        taken_word, taken_id, taken_at = [], [], []
        here, owner = last.copy(), np.arange(len(words))
        while True:
            going = here > origin[owner]
            here, owner = here[going], owner[going]
            if not len(here):
                break
            np.minimum.at(gap, owner, forward[here] - second[of_node[here]])
            arc = back[here]
            taken_word.append(owner)
            taken_id.append(ids[arc])
            taken_at.append(source[arc])
            here = source[arc]
        if not taken_word:
            return [(0.0, math.inf, b"")] * len(words)
        taken_word, taken_id, taken_at = (np.concatenate(x) for x in (taken_word, taken_id, taken_at))
        order = np.argsort(taken_at)
        taken_word, taken_id, taken_at = taken_word[order], taken_id[order].astype(np.int32), taken_at[order]
        spelt = np.flatnonzero(taken_id < 0)
        if len(spelt):
            chars = points[taken_at[spelt] - taken_word[spelt]]
            count = np.ones(len(taken_id), np.int64)
            count[spelt] = utf8_sizes(chars)
            taken_word, taken_id = np.repeat(taken_word, count), np.repeat(taken_id, count)
            raw = np.frombuffer("".join(map(chr, chars)).encode("utf-8", "surrogatepass"), np.uint8)
            taken_id[taken_id < 0] = self.vocabulary.byte_id[raw]
        cut = np.searchsorted(taken_word, np.arange(len(words) + 1)) * 4
        flat = taken_id.astype("<i4").tobytes()
        cut = cut.tolist()
        return list(zip(forward[last].tolist(), gap.tolist(), [flat[a:b] for a, b in zip(cut, cut[1:])]))

    def nbest(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths of one word by A-star from its end; (score, ids) in order."""
        into: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(len(word) + 1)]  # longest piece first
        for i in range(len(word)):
            if word[i] not in self.score:
                into[i + 1].append((i, self.byte_score, [self.byte_ids[b] for b in word[i].encode("utf-8", "surrogatepass")]))
            for j in range(i + 1, min(i + self.longest, len(word)) + 1):
                piece = word[i:j]
                if piece in self.score:
                    into[j].append((i, self.score[piece], [self.vocabulary.piece[piece]]))
        forward = [0.0] * (len(word) + 1)
        for j in range(1, len(word) + 1):
            forward[j] = max(forward[i] + s for i, s, _ in into[j])
        # An entry costs what it falls behind the best path, 0 for that one; equal costs go by ``Step``.
        heap = [(0.0, Step(len(word)))]
        bound = [-math.inf] * n  # the n least costs of side paths, negated: dearer ones are never needed
        out = []
        while heap and len(out) < n:
            cost, step = heapq.heappop(heap)
            if step.place == 0:
                out.append((forward[-1] - cost, step.ids()))
                continue
            here, along = forward[step.place], False
            for i, s, part in into[step.place]:
                behind = here - (forward[i] + s)
                if behind == 0 and not along:
                    along = True  # goes on with the path of its entry
                elif cost + behind <= -bound[0]:
                    heapq.heapreplace(bound, -(cost + behind))
                else:
                    continue
                heapq.heappush(heap, (cost + behind, Step(i, step, part)))
        return out


class Step:
    """A path from the end of a word to ``place``, as a link to the path that it goes on with.

    Paths are in order of their places from the end. ``jump`` is an earlier path so far back that
    two paths meet after a logarithmic number of jumps.
    """

    __slots__ = ("place", "up", "part", "depth", "jump")

    def __init__(self, place: int, up: Step | None = None, part: list[int] | None = None):
        self.place, self.up, self.part = place, up, part
        if up is None:
            self.depth, self.jump = 0, self
        else:
            far = up.jump
            self.depth = up.depth + 1
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def at(self, depth: int) -> Step:
        step = self
        while step.depth > depth:
            step = step.jump if step.jump.depth >= depth else step.up
        return step

    def __lt__(self, other: Step) -> bool:
        a, b = self.at(other.depth), other.at(self.depth)
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a.place < b.place

    def ids(self) -> list[int]:
        out, step = [], self
        while step.up is not None:
            out += step.part
            step = step.up
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(Vocabulary(path))


class Known:
    """What is known of words: score, gap to the second path, ids, and N-best lists of a few."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.size, self.begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.lists: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    def add(self, words: list[str], model: Lattice) -> None:
        if not words:
            return
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words))))
        scores, gaps, ids = zip(*model.best([SPACE + w for w in words]))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.score, self.gap = np.append(self.score, scores), np.append(self.gap, gaps)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<i4"))


_known: dict[str, Known] = {}


def encode_texts(texts: list[str | None], path: str, n: int):
    """Scores, all ids in a row, where each text's begin, and the alternatives of each text.

    An alternative is (score, edits), an edit (begin, end, ids) replaces ids of the best path.
    """
    split = [keys_of(t or "") for t in texts]
    model = lattice(path)
    known = _known.get(path)
    if known is None or len(known.slot) > REMEMBERED or len(known.lists) > REMEMBERED // 5:
        known = _known[path] = Known()
    known.add(list(set().union(*map(set, split)).difference(known.slot)), model)
    cuts = np.cumsum([0, *map(len, split)])
    slots = np.fromiter(map(known.slot.__getitem__, chain.from_iterable(split)), np.int64, cuts[-1])
    size, gaps = known.size[slots], known.gap[slots]
    at = np.concatenate([[0], np.cumsum(size)])
    ids = known.ids[np.arange(at[-1]) + np.repeat(known.begin[slots] - at[:-1], size)]
    scores = np.zeros(len(texts))
    alternatives: list[list] = [[] for _ in texts]
    for d, words in enumerate(split):
        if not words:
            continue
        first = cuts[d]
        scores[d] = score = float(known.score[slots[first : cuts[d + 1]]].sum())
        total: list[tuple[float, tuple]] = [(0.0, ())]
        for k in smallest(gaps[first : cuts[d + 1]], n - 1) if n > 1 else ():
            if gaps[first + k] == math.inf:
                continue
            found = known.lists.get((words[k], n))
            if found is None:
                found = known.lists[words[k], n] = model.nbest(SPACE + words[k], n)
            top = found[0][0]
            total = heapq.nsmallest(n, [
                (gap + max(top - s, 0.0), (*choice, (k, j)) if j else choice)
                for gap, choice in total for j, (s, _) in enumerate(found)
            ])
        for gap, choice in total[1:]:
            alternatives[d].append((score - gap, [
                (int(at[first + k] - at[first]), int(at[first + k + 1] - at[first]), known.lists[words[k], n][j][1])
                for k, j in sorted(choice)
            ]))
    return scores, ids, at[cuts], alternatives


def smallest(values: np.ndarray, n: int) -> list[int]:
    """Places of the n smallest values, the first of equals first."""
    bound = np.partition(values, n - 1)[n - 1] if n < len(values) else math.inf
    at = np.flatnonzero(values <= bound)
    return at[np.argsort(values[at], kind="stable")][:n].tolist()


def decode_ids(ids: list[int] | np.ndarray, model: Lattice) -> str:
    """The text of ids; byte pieces are put together as UTF-8."""
    return decoder(model)(ids)


def decoder(model: Lattice):
    size = 1 + max(*model.vocabulary.text, *model.byte_ids)
    table = [b""] * size
    for i, piece in model.vocabulary.text.items():
        table[i] = piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")
    for b, i in enumerate(model.byte_ids):
        table[i] = bytes([b])

    def decode(ids) -> str:
        raw = b"".join(map(table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    return decode


@lru_cache(maxsize=2)
def decoder_of(path: str):
    return decoder(lattice(path))


def encode(docs: DataFrame, path: str, n: int = 3) -> DataFrame:
    """``docs`` with ids, n_tokens, score, alternatives (n - 1 at most) and restored.

    ``restored`` says that decoding the ids gives the text again (up to the space mark).
    """
    fields = [
        StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
        StructField("score", DoubleType()), StructField("alternatives", ArrayType(ALTERNATIVE)),
        StructField("restored", BooleanType()),
    ]
    edit = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = tx.column(batch, "text").to_pylist()
        decode = decoder_of(path)
        scores, ids, at, alternatives = encode_texts(texts, path, n)
        others = [
            [{"score": s, "edits": [{"begin": a, "end": b, "ids": x} for a, b, x in edits]} for s, edits in row]
            for row in alternatives
        ]
        good = [decode(ids[at[d] : at[d + 1]]) == (t or "").replace(SPACE, " ") for d, t in enumerate(texts)]
        return [
            tx.ragged(at, pa.array(ids, pa.int32())), pa.array(np.diff(at)), pa.array(scores),
            pa.array(others, pa.list_(other)), pa.array(good, pa.bool_()),
        ]

    return tx.map_rows(docs, fields, run)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids in ``text``; a null list gives a null."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        of = decoder_of(path)
        lists = tx.column(batch, ids_col).to_pylist()
        return [pa.array([None if x is None else of(x) for x in lists], pa.string())]

    return tx.map_rows(rows, [StructField("text", StringType())], run)
