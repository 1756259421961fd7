"""Toxicity of texts after noisy-channel restoration of disguised words.

1. *Language model.* Character trigrams of all texts are counted, by task and then by key, into a
   table of ``SYMBOLS`` cubed cells.
2. *Restoration.* Three kinds of suspicious spans, of any length, are looked for: words with letters written as
   digits or signs, single letters with separators between them, and letters repeated three times
   or more. Each span becomes a lattice: a sign may stand for its letters, a separator may be dropped
   or be a blank, a run may be one letter, two, or itself; each choice has a channel cost. Viterbi
   decoding with the last two characters as state finds the cheapest text under the language
   model, and that text takes the span's place. Plain text has one path only and is left alone.
3. *Score.* Features are the words of the restored text and their beginnings (4 to 6 bytes). On
   half of the training rows each feature gets the lower confidence bound of its log-odds ratio; on
   the other half a logistic function of the largest weight in a text and of the sum of weights is
   fitted; then the weights are taken from all training rows. Labels come from at most ``SAMPLE`` rows,
   those first in order of a hash of the id; their restored texts are written once for these passes.

Defined cases: a null text is an empty one, and an empty text has the score of a text without any
weighted word; training rows need an id, and a label of 0 or 1; of several labels of one id the
largest counts; without training rows of both classes every text gets the share of label 1 (or 0).
Rows are independent; ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from arborinfo.functions.rng import mix64
from arborinfo.lineage import broadcast, materialize, ship_package
from arborinfo.llm import text as tx
from arborinfo.llm.language_mixture import LETTER

SAMPLE = 60_000
SYMBOLS = 60
#: Features with this many toxic training texts, the commonest up to ``FEATURES``.
LEAST, FEATURES = 3, 200_000
PREFIXES = (4, 5, 6)

#: Letters that a sign may stand for (fixed values).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SIGN_COST, BLANK_COST, SQUEEZE_COST = 1.0, 4.0, 1.0

#: Nothing here is tried twice, so long words take linear time. Tokens of common letters only are passed over.
_TOKEN = re.compile(
    r"(?<![^\W_]|[@$|+(€!])(?=[a-zß-öø-ÿ]*+(?:[^\W_]|[@$|+(€!]))(?:[^\W_]|[@$|+(€!])++"
)
_SPACED = re.compile(r"(?<!\w)(?:[^\W_]|[@$|+(€!])(?:[ .\-_*]++(?:[^\W_]|[@$|+(€!])(?![^\W_])){2,}+")
_WORD = re.compile(r"[^\W\d_]++")
_RUN = re.compile(r"([^\W\d_])\1\1")


def symbol_table() -> np.ndarray:
    """Symbol of each Unicode code point: blank, a-z, Latin-1 letters, anything else."""
    table = np.full(0x110000, SYMBOLS - 1, np.int32)
    for c in " \t\n\r.,;:!?\"'()-":
        table[ord(c)] = 0
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    for k in range(32):
        table[0xE0 + k] = table[0xC0 + k] = 27 + k
    return table


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    return symbol_table()


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Bits of each code point: 1 letter, 2 letter or digit, 4 separator, 8 sign."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x30000):
        c = chr(point)
        table[point] = c.isalpha() + 2 * (c.isalnum())
    for c in " .-_*":
        table[ord(c)] |= 4
    for c in SIGNS:
        table[ord(c)] |= 8
    return table


def suspicious(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, line) of the lines that may hold a span to restore: a quick test on all characters.

    Those where a sign is next to a letter, three single characters have separators between them, or
    a letter stands three times in a row. No span reaches over a line end.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    letter, single, gap, sign = (kind & bit > 0 for bit in (1, 2, 4, 8))
    hit = np.zeros(len(points), bool)
    if len(points) > 2:
        hit[1:] |= sign[1:] & letter[:-1] | sign[:-1] & letter[1:]
        same = points[1:] == points[:-1]
        hit[2:] |= same[1:] & same[:-1] & letter[2:]
    begins = np.cumsum(sizes) - sizes
    alone = single | sign
    if len(points) > 4:
        beside = np.zeros(len(points), bool)
        beside[1:] = single[:-1]
        beside[begins[sizes > 0]] = False
        alone &= ~beside
        beside[:-1], beside[-1] = single[1:], False
        beside[(begins + sizes - 1)[sizes > 0]] = False
        alone &= ~beside
        one = np.flatnonzero(alone)
        solid = np.cumsum(~gap, dtype=np.int32)[one]
        apart = (np.diff(solid) == 1) & (np.diff(one) > 1)  # with separators, and nothing else, between
        hit[one[2:][apart[:-1] & apart[1:]]] = True
    at = np.flatnonzero(hit)
    text = np.searchsorted(begins, at, "right") - 1
    breaks = np.flatnonzero(points == 10)
    line = np.searchsorted(breaks, at) - np.searchsorted(breaks, begins[text])
    found = np.stack([text, line])  # in order, as the characters are
    fresh = np.ones(len(at), bool)
    fresh[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
    return found[:, fresh]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of the character trigrams of all texts."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in tx.row_slices(batch):
                joined = "  ".join(t for t in tx.column(part, "text").to_pylist() if t)
                s = symbols()[np.frombuffer(f"  {joined}".encode("utf-32-le", "surrogatepass"), np.uint32)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code int, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores disguised words under a character language model."""

    def __init__(self, counts: pa.Table):
        table = np.zeros(SYMBOLS**3)
        table[counts.column("code").to_numpy()] = counts.column("n").to_numpy()
        table = table.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        pair = table.sum(axis=0)
        single = pair.sum(axis=0) + 1
        p1 = single / single.sum()
        p2 = (pair + 20 * p1) / (pair.sum(axis=1, keepdims=True) + 20)
        p3 = (table + 5 * p2[None]) / (table.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).ravel().tolist()
        self.symbol = {chr(c): int(symbols()[c]) for c in range(0x250)}
        self.known: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def options(self, span: str) -> list[list[tuple[str, float]]]:
        """What each character, or run of one letter, may stand for."""
        out = []
        for run in re.finditer(r"(.)\1*", span, re.DOTALL):
            char, n = run[1], len(run[0])
            if char in " .-_*":
                out.append([("", 0.0), (" ", BLANK_COST if n == 1 else 0.0)])
            elif char in SIGNS:
                out += [[(char, 0.0), *[(x, SIGN_COST) for x in SIGNS[char]]] for _ in range(n)]
            elif n > 2:
                out.append([(char * n, 0.0), (char, SQUEEZE_COST), (char * 2, SQUEEZE_COST)])
            elif out and len(out[-1]) == 1:  # letters without a choice go together
                out[-1] = [(out[-1][0][0] + char * n, 0.0)]
            else:
                out.append([(char * n, 0.0)])
        return out

    def decode(self, span: str) -> str:
        """The cheapest reading of a span, between blanks."""
        found = self.known.get(span)
        if found is not None:
            return found
        table, of, other = self.cost, self.symbol.get, SYMBOLS - 1
        states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # cost, and what was emitted, last first
        for choices in [*self.options(span), [(" ", 0.0)]]:
            grown: dict[tuple[int, int], tuple] = {}
            for (a, b), (cost, trail) in states.items():
                for emitted, channel in choices:
                    x, y, total = a, b, cost + channel
                    for c in emitted:
                        z = of(c, other)
                        total += table[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                    if (x, y) not in grown or total < grown[x, y][0]:
                        grown[x, y] = (total, (trail, emitted))
            states = grown
        trail, parts = min(states.values(), key=lambda s: s[0])[1], []
        while trail:
            trail, emitted = trail
            parts.append(emitted)
        best = "".join(reversed(parts))[:-1]
        self.keep(self.known, span, best)
        return best

    def keep(self, known: dict[str, str], span: str, best: str) -> None:
        """Remembers the reading of a short span."""
        if len(span) <= 100:
            if len(known) > 50_000:
                known.clear()
            known[span] = best

    def _token(self, match: re.Match) -> str:
        """A run of letters, digits and signs, restored if it mixes letters and signs."""
        span = match[0]
        found = self.tokens.get(span)
        if found is None:
            found = self.decode(span) if not span.isalpha() and any(map(str.isalpha, span)) else span
            self.keep(self.tokens, span, found)
        return found

    def restore(self, text: str) -> str:
        """``text`` in lower case with its suspicious spans restored."""
        text = _TOKEN.sub(self._token, text.lower())
        text = _SPACED.sub(lambda m: self.decode(m[0]), text)
        if not _RUN.search(text):
            return text
        return _WORD.sub(lambda m: self.decode(m[0]) if _RUN.search(m[0]) else m[0], text)


def restored(texts: pa.Array, channel: Channel) -> pa.Array:
    """The texts in lower case with their suspicious lines restored; null is empty."""
    plain = [(t or "").lower() for t in texts.to_pylist()]
    rows, lines = (x.tolist() for x in suspicious(plain))
    for row, group in groupby(zip(rows, lines), key=lambda x: x[0]):
        parts = plain[row].split("\n")
        for _, line in group:
            parts[line] = channel.restore(parts[line])
        plain[row] = "\n".join(parts)
    return pa.array(plain, pa.large_string())


@dataclass
class Features:
    """Words and word beginnings of restored texts: equal words of all texts share their features."""

    doc: np.ndarray  # of each word in the texts, rising
    word: np.ndarray  # number of its form
    form: np.ndarray  # of each feature
    key: np.ndarray  # hash of each feature

    @classmethod
    def of(cls, texts: pa.Array) -> Features:
        data, offsets = tx.buffers(texts)
        starts, ends, cuts = tx.find_words(data, offsets, LETTER)
        doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        coded = pa.array(tx.hash_words(data, starts, ends)).dictionary_encode()
        word, keys = coded.indices.to_numpy(), [coded.dictionary.to_numpy()]
        forms = [np.arange(len(keys[0]))]
        place = np.zeros(len(keys[0]), np.int64)
        place[word] = np.arange(len(word))  # any place of the form
        starts, sizes = starts[place], (ends - starts)[place]
        for size in PREFIXES:
            long = np.flatnonzero(sizes > size)
            keys.append(mix64(tx.hash_spans(data, starts[long], starts[long] + size) + np.uint64(size)))
            forms.append(long)
        return cls(doc, word, np.concatenate(forms), np.concatenate(keys))

    def pairs(self, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, document, place among the keys) of each text's distinct features, in order.

        The keys are ``known`` (sorted), which leaves other features out, or those of all features.
        """
        if known is None:
            known, at = np.unique(self.key, return_inverse=True)
            form = self.form
        else:
            at = np.searchsorted(known, self.key)
            at[at == len(known)] = 0
            hit = known[at] == self.key if len(known) else np.zeros(len(at), bool)
            form, at = self.form[hit], at[hit]
        order = np.argsort(form, kind="stable")
        at = at[order]
        count = np.bincount(form, minlength=int(self.form.max(initial=-1)) + 1)
        begin = np.cumsum(count) - count
        inside = np.flatnonzero(count[self.word] > 0)
        seen = np.unique(self.doc[inside] * len(count) + self.word[inside])
        doc, word = np.divmod(seen, max(len(count), 1))
        each = count[word]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        code = np.repeat(doc, each) * len(known) + at[np.repeat(begin[word], each) + inner]
        return known, *np.divmod(np.unique(code), max(len(known), 1))


@dataclass
class Scorer:
    """Weights of features (hash, weight) and the logistic function over a text's weights."""

    keys: np.ndarray
    weights: np.ndarray
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """(largest weight, log of 1 + sum of weights) over each restored text's distinct features."""
        _, doc, place = Features.of(texts).pairs(self.keys)
        out, weight = np.zeros((len(texts), 2)), self.weights[place]
        np.maximum.at(out[:, 0], doc, weight)
        out[:, 1] = np.log1p(np.bincount(doc, weight, len(texts)))
        return out

    def score(self, sums: np.ndarray) -> np.ndarray:
        a, b, c = self.logistic
        return 1 / (1 + np.exp(-np.clip(a + b * sums[:, 0] + c * sums[:, 1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Newton steps for a logistic function of two columns and a constant."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(3)
        beta += np.linalg.solve(hessian, design.T @ (y - p) - ridge * beta)
    return tuple(beta.tolist())


def held_out(id_col: str = "doc_id"):
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def sample_of(labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and labels of at most ``sample`` training rows."""
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = rows.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    ids = taken.column("doc_id").to_numpy()
    order = np.argsort(ids)
    return ids[order], taken.column("toxic").to_numpy()[order]


def restored_sample(docs: DataFrame, ids: np.ndarray, marks: np.ndarray, channel_shared) -> DataFrame:
    """(toxic, half, text) of the sampled rows, restored and written once for all passes of a fit."""
    spark = docs.sparkSession
    half = mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(2) == 0
    picked = spark.createDataFrame(
        pa.table({"doc_id": pa.array(ids), "toxic": pa.array(marks.astype(np.int32)), "half": pa.array(half)})
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").select("toxic", "half", "text")

    def restore(batch: pa.RecordBatch) -> list[pa.Array]:
        return [restored(tx.column(batch, "text"), channel_shared.value).cast(pa.string())]

    return materialize(tx.map_rows(rows, [StructField("text", StringType())], restore), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, channel_shared, sample: int = SAMPLE) -> Scorer:
    """Weights and logistic function from the sampled labels (doc_id, toxic)."""
    spark = docs.sparkSession
    ids, marks = sample_of(labels, sample)
    share = float(marks.mean()) if len(marks) else 0.0
    constant = (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0)
    unlearnt = Scorer(np.zeros(0, np.uint64), np.zeros(0), constant)
    if not 0 < share < 1:
        return unlearnt
    rows = restored_sample(docs, ids, marks, channel_shared)
    in_half = mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(2) == 0
    counts = ["toxic", "clean", "toxic_half", "clean_half"]

    def tally(batches, known=None):
        """Texts of each label, in all and in the half, that have a feature; all features or the known ones."""
        for batch in batches:
            for part in tx.row_slices(batch):
                found, doc, place = Features.of(tx.column(part, "text")).pairs(known and known.value)
                one = tx.column(part, "toxic").to_numpy()[doc] == 1
                half = tx.column(part, "half").to_numpy(zero_copy_only=False)[doc]
                sums = [np.bincount(place, x, len(found)).astype(np.int64) for x in (one, ~one, one & half, ~one & half)]
                some = np.flatnonzero(sums[0] + sums[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[some].view(np.int64)), *(pa.array(x[some]) for x in sums)], names=["key", *counts]
                )

    def tallied(rows: DataFrame, known=None) -> DataFrame:
        made = rows.mapInArrow(lambda b: tally(b, known), "key long, " + ", ".join(f"{c} long" for c in counts))
        return made.groupBy("key").agg(*(F.sum(c).alias(c) for c in counts))

    toxic = tallied(rows.filter("toxic = 1")).filter(F.col("toxic") >= LEAST).select("key", "toxic", "toxic_half")
    toxic = materialize(toxic, "toxicity-features")

    def often(count: str) -> np.ndarray:
        """Sorted features that enough toxic texts have."""
        top = toxic.filter(F.col(count) >= LEAST).orderBy(F.desc(count), "key").limit(FEATURES).select("key").toArrow()
        return np.sort(top.column("key").to_numpy().view(np.uint64))

    chosen = {"": often("toxic"), "_half": often("toxic_half")}
    known = broadcast(spark, np.union1d(*chosen.values()))
    both = tallied(rows, known).toArrow()
    keys = both.column("key").to_numpy().view(np.uint64)

    def weighted(part: str, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted features and their weights, from the half or from all of the sample."""
        totals = [int((marks[of] == y).sum()) for y in (1, 0)]
        if not all(totals):
            return np.zeros(0, np.uint64), np.zeros(0)
        t, c = (both.column(f"{y}{part}").to_numpy() for y in ("toxic", "clean"))
        ratio = np.log((t + 0.5) / (totals[0] + 1)) - np.log((c + 0.5) / (totals[1] + 1))
        weight = ratio - 2 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        keep = np.flatnonzero((weight > 0) & np.isin(keys, chosen[part]))
        keep = keep[np.argsort(keys[keep])]
        return keys[keep], weight[keep]

    scorer_shared = broadcast(spark, Scorer(*weighted("_half", in_half), constant))

    def measure(batches):
        for batch in batches:
            for part in tx.row_slices(batch):
                sums = scorer_shared.value.sums(tx.column(part, "text"))
                label = tx.column(part, "toxic").cast(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1]), label], names=["a", "b", "y"])

    other = rows.filter("not half").mapInArrow(measure, "a double, b double, y double").toArrow()  # half the sample at most
    y = other.column("y").to_numpy()
    if len(y) and 0 < y.sum() < len(y):
        x = np.column_stack([other.column("a").to_numpy(), other.column("b").to_numpy()])
        return Scorer(*weighted("", np.ones(len(ids), bool)), fit_logistic(x, y))
    return unlearnt


def score_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a toxicity score learnt from ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    channel = broadcast(spark, Channel(trigram_counts(docs).toArrow()))  # SYMBOLS cubed rows at most
    scorer = broadcast(spark, train(docs, labels, channel, sample))

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = restored(tx.column(batch, "text"), channel.value)
        return [pa.array(scorer.value.score(scorer.value.sums(texts)))]

    return tx.map_rows(docs, [StructField("score", DoubleType())], score)
