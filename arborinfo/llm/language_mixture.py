"""Languages of a document as a mixture, by expectation-maximisation over its words.

Training counts, for every language, hashed byte trigrams (with word borders, lower case) of all
training texts; each task adds up its own counts and the sums are merged by a keyed aggregate.
The model has ``BINS`` smoothed log-probabilities per language: its size is languages x BINS,
whatever the corpus.

A document's words are its observations: a word has a likelihood under each language (the sum of
its trigrams). EM estimates the proportions of the languages, until an iteration gains less than
``TOLERANCE`` a word. Then the languages are ranked by proportion and the first 1, 2, ... of them are
fitted again; the set with the best log-likelihood less ``penalty`` x log(words) per language is
selected. Sizes go up to all languages; since no set is likelier than all languages together, a size
whose penalty this leaves no room for need not be fitted, nor any larger one. The prediction is the
language with the largest share in that set, its score is the share.

Defined cases: a text that is null or has no letter (Unicode category L) is ``und`` with score 0;
equal shares go to the language first in order; training rows with a null text or language are
not used, and without any training row everything is ``und``. Rows are independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from arborinfo.lineage import broadcast, ship_package
from arborinfo.llm import text as tx

BINS = 1 << 15
LETTER = tx.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTER = tx.byte_class((0x41, 0x5A), (0x61, 0x7A))
UNKNOWN = "und"
#: EM ends for a document when an iteration gains less log-likelihood than this for each word.
TOLERANCE = 1e-6
#: Log-likelihood, for each word, that a fit may still be below its maximum then.
SLACK = 1e-4


def trigrams(texts: pa.Array):
    """Bin of the trigram that ends at each byte, the words, and where documents begin."""
    raw, offsets = tx.buffers(texts)
    data = tx.LOWER[raw]
    if len(raw) > 1:  # capital Latin-1 letters: the byte after C3 is 80-9E, but for the sign 97
        high = np.flatnonzero(raw[:-1] == 0xC3) + 1
        high = high[(raw[high] >= 0x80) & (raw[high] <= 0x9E) & (raw[high] != 0x97)]
        data[high] += 0x20
    starts, ends, cuts = tx.find_words(data, offsets, LETTER)
    one = np.where(LETTER[data], data, 0).astype(np.uint32)
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:], three[2:] = one[:-1], one[:-2]
    begins = offsets[:-1][offsets[:-1] < len(one)]
    two[begins] = 0
    three[begins] = 0
    three[begins[begins + 1 < len(one)] + 1] = 0
    three[two == 0] = 0
    code = (three << 16) | (two << 8) | one
    bins = (code * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return bins, data, starts, ends, cuts, offsets


def train(docs: DataFrame, lang_col: str = "lang") -> "LanguageModel":
    """Learn from all rows of ``docs`` that have a text and a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    ship_package(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tx.row_slices(batch):
                bins, data, _, _, _, offsets = trigrams(tx.column(part, "text"))
                names, which = np.unique(np.array(tx.column(part, "lang").to_pylist(), object), return_inverse=True)
                code = (np.repeat(which, np.diff(offsets)) * BINS + bins)[LETTER[data]]
                made = np.bincount(code, minlength=len(names) * BINS).reshape(-1, BINS)
                for lang, n in zip(names, made):
                    sums[lang] = sums[lang] + n if lang in sums else n
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at])],
                names=["lang", "bin", "n"],
            )

    counts = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return LanguageModel(counts.toArrow())  # languages x BINS rows at most


class LanguageModel:
    """Log-probabilities of trigram bins by language."""

    def __init__(self, counts: pa.Table, smoothing: float = 0.5, penalty: float = 1.0):
        self.penalty = penalty
        langs = counts.column("lang").to_pylist()
        self.languages = sorted(set(langs))
        number = {lang: k for k, lang in enumerate(self.languages)}
        table = np.full((len(self.languages), BINS), smoothing)
        at = np.array([number[x] for x in langs], np.int64)
        np.add.at(table, (at, counts.column("bin").to_numpy()), counts.column("n").to_numpy())
        self.log_p = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)

    def mixtures(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages) proportions in the selected set, and whether there are words."""
        bins, _, starts, ends, cuts, _ = trigrams(texts)
        docs, langs = len(cuts) - 1, len(self.languages)
        share = np.zeros((docs, langs))
        some = np.diff(cuts) > 0
        if not langs or not some.any():
            return share, some & (langs > 0)
        # Words and the gaps between them alternate, so every second sum is a word's.
        edges = np.empty(2 * len(starts), np.int64)
        edges[::2], edges[1::2] = starts, ends
        if edges[-1] == len(bins):
            bins = np.append(bins, 0)
        score = np.stack([np.add.reduceat(row[bins], edges)[::2] for row in self.log_p]).astype(np.float64)
        top = score.max(0)
        weight = np.exp(score - top)  # languages x words
        at, rows = cuts[:-1][some], np.diff(cuts)[some]
        base = np.add.reduceat(top, at)
        full, likely = self._fit(weight, at, rows, np.ones((len(at), langs), bool))
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best = np.where(rank == 0, 1.0, 0.0)
        single = np.add.reduceat(score[np.repeat(order[:, 0], rows), np.arange(len(top))], at)
        gain = single - self.penalty * np.log(rows)
        ceiling = likely + base + SLACK * rows
        for size in range(2, langs + 1):
            has = np.flatnonzero(ceiling - size * self.penalty * np.log(rows) > gain)
            if not len(has):
                break
            words = np.concatenate([np.arange(at[k], at[k] + rows[k]) for k in has])
            begin = np.concatenate([[0], np.cumsum(rows[has])[:-1]])
            mixed, like = self._fit(weight[:, words], begin, rows[has], rank[has] < size)
            like = like + base[has] - size * self.penalty * np.log(rows[has])
            better = like > gain[has]
            best[has[better]], gain[has[better]] = mixed[better], like[better]
        share[some] = best
        return share, some

    @staticmethod
    def _fit(weight, at, rows, allowed):
        """EM for the proportions of the allowed languages; also the log-likelihood.

        Documents leave as they converge.
        """
        theta = (allowed / allowed.sum(1, keepdims=True)).T
        likely, live = np.full(len(rows), -np.inf), np.arange(len(rows))
        while len(live):
            part = weight * np.repeat(theta[:, live], rows, 1)
            total = np.maximum(part.sum(0), 1e-300)
            part /= total
            now = np.add.reduceat(np.log(total), at)
            going = now - likely[live] >= TOLERANCE * rows
            likely[live] = now
            theta[:, live] = np.add.reduceat(part, at, 1) / rows
            if not going.all():
                weight = weight[:, np.repeat(going, rows)]
                live, rows = live[going], rows[going]
                at = np.cumsum(rows) - rows
        return theta.T, likely


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = tx.buffers(texts)
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares (of the model's languages, in order)."""
    shared = broadcast(docs.sparkSession, model)
    fields = [
        StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("lang_shares", ArrayType(DoubleType())),
    ]

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        model: LanguageModel = shared.value
        texts = tx.column(batch, "text")
        share, some = model.mixtures(texts)
        good = some & has_letter(texts)
        share[~good] = 0
        best = share.argmax(1) if share.shape[1] else np.zeros(len(good), int)
        return [
            pa.array([model.languages[b] if g else UNKNOWN for b, g in zip(best, good)], pa.string()),
            pa.array(np.minimum(share.max(1), 1.0) if share.shape[1] else np.zeros(len(good))),
            tx.ragged(np.arange(len(good) + 1) * share.shape[1], pa.array(share.ravel())),
        ]

    return tx.map_rows(docs, fields, predict)


def held_out(id_col: str = "doc_id", parts: int = 3, out: int = 1):
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % parts == out, F.lit(False))


def identify_by_own_rows(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all of ``docs``."""
    return identify(docs, train(docs.filter(~held_out())))


def reject_unidentified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents with a language: those without letters go, and those below ``least``."""
    marked = identify_by_own_rows(docs)
    return marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least)).select(*docs.columns)
