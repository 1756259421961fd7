"""Von Mises mixtures over rows (residue, frame, theta array<double>).

One mixture per residue. The data stays where it is: each pass over it is a map that turns
Arrow batches into matrices, works with the (small, driver-held) parameters and emits one
partial sum per residue and component, which Spark adds up. Responsibilities are never stored.
A log-density is linear in cos(theta) and sin(theta), so an E-step is two matrix products.

Parameters have a size of residues x components x features, whatever the number of frames. The fit keeps
them in a table (``em``); for single passes they are shipped to tasks in groups of residues of at most ``PARAMETER_BUDGET`` bytes; lay the
angles out by residue (``by_residue``) so that each group reads only its own files.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.functions.circular import (
    clamp_kappa,
    kappa_of_resultant,
    mean_angle,
    wrap_angle,
)
from arborinfo.functions.rng import uniform_array
from arborinfo.functions.special import log_i0
from arborinfo.lineage import broadcast, local_table, scratch_path

PARAMETER_BUDGET = 64 << 20
# The first 15 of 28 features (bond angles and the peptide torsion) start tight.
TIGHT_FEATURES = 15
TIGHT_RANGE = (100.0, 500.0)
LOOSE_RANGE = (25.0, 50.0)
SEED_DISTANCE = 1e-8
# Passes that gather seeding candidates, and cosines computed at a time.
SEED_ROUNDS = 5
SEED_CELLS = 2_000_000


@dataclass
class Mixture:
    """Parameters of one residue's mixture; arrays are (components, features)."""

    mu: np.ndarray
    kappa: np.ndarray
    logw: np.ndarray
    mask: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.mu.nbytes + self.kappa.nbytes + self.logw.nbytes

    def log_components(self, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
        """ln(w_k f_k(x)) per row and component, weights as they are."""
        kappa = np.where(self.mask, self.kappa, 0.0)
        # ln(2 pi I0), scaled so that large concentrations do not overflow.
        norm = np.log(2 * math.pi) + np.log(np.i0(kappa))
        const = self.logw - np.where(self.mask, norm, 0.0).sum(axis=1)
        return cos @ (kappa * np.cos(self.mu)).T + sin @ (kappa * np.sin(self.mu)).T + const

    def responsibilities(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(r, ln density) per row."""
        log = self.log_components(np.cos(theta), np.sin(theta))
        top = log.max(axis=1, keepdims=True)
        r = np.exp(log - top)
        total = r.sum(axis=1, keepdims=True)
        shift = self.logw.max()
        log_norm = shift + np.log(np.exp(self.logw - shift).sum())
        return r / total, (top + np.log(total)).ravel() - log_norm


def by_residue(angles: DataFrame) -> DataFrame:
    """Write the angles out clustered by residue and read them back.

    A fit then makes each of its passes over files that hold one residue each, and a residue
    left out of a pass is not read at all. Rebalancing splits a residue with many frames over
    as many files as its size asks for.
    """
    spark = angles.sparkSession
    path = scratch_path(spark, "angles")
    rows = angles.select("frame", "theta", "residue")
    rows.hint("rebalance", "residue").write.partitionBy("residue").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select("residue", "frame", "theta")


def residue_batches(batches, known):
    """Split Arrow batches (residue, frame, theta) by residue, skipping unknown ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        residue = np.asarray(batch.column(0))
        frame = np.asarray(batch.column(1))
        theta = np.asarray(batch.column(2).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
        for value in np.unique(residue):
            key = int(value)
            if key in known:
                hit = residue == value
                yield key, frame[hit], theta[hit]


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
    )


def double_lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists over one flat array."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


SUMS = pa.schema(
    [
        ("residue", pa.int32()), ("comp", pa.int32()), ("n", pa.float64()), ("ll", pa.float64()),
        ("w", pa.float64()), ("c", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())),
    ]
)


def expectation_sums(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, comp, feature, n, ll, w, c, s) of the E-step under ``mixtures``.

    w, c and s are the sums of r, r cos(theta) and r sin(theta); n and ll are the number of
    frames and the summed log-likelihood, carried by component 0.
    """
    shared = broadcast(angles.sparkSession, mixtures)

    def sums(batches):
        # At most one entry per residue shipped, each of the size of its parameters.
        known, acc = shared.value, {}
        for key, _, theta in residue_batches(batches, known):
            r, ll = known[key].responsibilities(theta)
            part = [len(theta), ll.sum(), r.sum(axis=0), r.T @ np.cos(theta), r.T @ np.sin(theta)]
            acc[key] = [a + b for a, b in zip(acc[key], part)] if key in acc else part
        for key, (n, ll, w, c, s) in acc.items():
            k = len(w)
            first = np.arange(k) == 0
            yield as_batch(
                SUMS, np.full(k, key), np.arange(k), first * float(n), first * ll, w,
                double_lists(c), double_lists(s),
            )

    # A task emits one row per residue and component it has seen, summed over its rows.
    partial = angles.select("residue", "frame", "theta").mapInArrow(
        sums, "residue int, comp int, n double, ll double, w double, c array<double>, s array<double>"
    )
    long = partial.select(
        "residue", "comp", "n", "ll", "w", F.posexplode(F.arrays_zip("c", "s")).alias("feature", "cs")
    )
    return long.groupBy("residue", "comp", "feature").agg(
        *[F.sum(x).alias(x) for x in ("n", "ll", "w")],
        F.sum("cs.c").alias("c"), F.sum("cs.s").alias("s"),
    )


def expected_log_likelihood(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, ell): the complete log-likelihood expected under the responsibilities.

    The density terms follow from the sums of the E-step alone; to them comes the sum of w ln w over
    the components' weights.
    """
    params = feature_rows(mixtures_table(angles.sparkSession, mixtures))
    own = F.col("kappa") * (F.col("c") * F.cos("mu") + F.col("s") * F.sin("mu"))
    norm = F.log(F.lit(2.0) * F.pi()) + F.expr(log_i0("kappa"))
    density = expectation_sums(angles, mixtures).join(
        params.select("residue", "comp", "feature", "mu", "kappa"), ["residue", "comp", "feature"]
    ).groupBy("residue").agg(F.sum(own - F.col("w") * norm).alias("density"))
    weights = params.filter("feature = 0").select("residue", F.exp("logw").alias("_w"))
    total = F.sum("_w")
    # With v the weights before they are divided by their total t: sum(v ln v) / t - ln t.
    spread = F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.log("_w")).otherwise(0.0))
    mixing = weights.groupBy("residue").agg((spread / total - F.log(total)).alias("mixing"))
    return density.join(mixing, "residue").select("residue", (F.col("density") + F.col("mixing")).alias("ell"))


def maximization(sums: DataFrame) -> DataFrame:
    """(residue, comp, feature, n, ll, w, logw, mu, kappa) that maximize the expectation.

    The expected log-likelihood separates by component and feature, so each concentration is
    the exact solution of A(kappa) = resultant length, held in its range.
    """
    w = F.col("w")
    length = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / w
    rows = sums.withColumns(
        {
            "mu": wrap_angle(mean_angle(F.col("c"), F.col("s"))),
            "_r": F.least(F.when(w > 0, length).otherwise(0.0), F.lit(1.0)),
        }
    )
    rows = kappa_of_resultant(rows, "_r", "kappa")
    top = F.max("w").over(Window.partitionBy("residue"))
    return rows.select(
        "residue", "comp", "feature", "n", "ll", "w",
        F.coalesce(F.log(w / top), F.lit(float("-inf"))).alias("logw"), "mu", "kappa",
    )


def collect_mixtures(
    rows: DataFrame, masks: dict[int, np.ndarray]
) -> tuple[dict[int, Mixture], dict[int, float]]:
    """Parameters and mean log-likelihood per residue of a ``maximization`` table."""
    table = rows.toPandas().sort_values(["residue", "comp", "feature"])
    mixtures, likelihood = {}, {}
    for residue, part in table.groupby("residue"):
        k = part["comp"].nunique()
        mask = masks[int(residue)]
        shape = lambda c: part[c].to_numpy(np.float64).reshape(k, -1)
        mixtures[int(residue)] = Mixture(
            np.where(mask, shape("mu"), 0.0), np.where(mask, shape("kappa"), 0.0),
            shape("logw")[:, 0].copy(), mask,
        )
        first = part[part["feature"] == 0]
        likelihood[int(residue)] = first["ll"].sum() / first["n"].sum()
    return mixtures, likelihood


CANDIDATE = pa.schema(
    [("residue", pa.int32()), ("key", pa.float64()), ("theta", pa.list_(pa.float64()))]
)


def seed_centres(angles: DataFrame, residues: list[int], k: int, seed: int) -> dict[int, np.ndarray]:
    """k-means++ centres on the sphere, drawn from candidates that few passes gather.

    The first pass draws one row per residue. Each of ``SEED_ROUNDS`` passes then adds ``2 k`` rows,
    drawn with weight (1 - cosine)^2 to the candidates so far; a last one counts the rows nearest to
    each candidate. The k centres are drawn one after the other from the candidates, with weight
    count times (1 - cosine)^2. All of them are data rows. A weighted draw takes the largest
    ln(u) / weight, so each task offers its own best and the best of all stay; u depends on
    (seed, residue, round, frame) only. Where there are fewer distinct rows than centres, centres
    repeat.
    """
    rows = angles.select("residue", "frame", "theta")
    found: dict[int, np.ndarray] = {}
    for draw in range(1 + SEED_ROUNDS):
        picked = weighted_rows(rows, found, residues, 2 * k if draw else 1, seed, draw)
        for residue in residues:
            fresh = [x for r, x in picked if r == residue]
            if fresh:
                known = [found[residue]] if residue in found else []
                found[residue] = np.concatenate([*known, np.array(fresh)])
    counts = nearest_counts(rows, found)
    return {r: drawn_centres(found[r], counts[r], k, seed, r) for r in found}


def nearest(theta: np.ndarray, centres: np.ndarray):
    """(place, 1 - cosine) of the nearest centre of each row, in blocks of rows."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    for low in range(0, len(theta), block := max(1, SEED_CELLS // len(centres))):
        part = theta[low : low + block]
        distance = 1.0 - (part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
        place = distance.argmin(axis=1)
        yield low, place, distance[np.arange(len(place)), place]


def weighted_rows(rows: DataFrame, found: dict, residues: list[int], size: int, seed: int, draw: int):
    """Up to ``size`` rows per residue, (residue, theta), drawn by their distance to ``found``."""
    shared = broadcast(rows.sparkSession, found or {r: None for r in residues})

    def offers(batches):
        known, best = shared.value, {}
        for key, frame, theta in residue_batches(batches, known):
            u = uniform_array(seed, zlib.crc32(f"{key}|{draw}".encode()), frame)
            if known[key] is None:
                score = u
            else:
                distance = np.concatenate([d for _, _, d in nearest(theta, known[key])])
                free = distance > SEED_DISTANCE
                score, theta = np.log(u[free]) / distance[free] ** 2, theta[free]
            if key in best:
                score, theta = np.concatenate([best[key][0], score]), np.concatenate([best[key][1], theta])
            top = np.argsort(-score, kind="stable")[:size]
            best[key] = score[top], theta[top]
        for key, (score, theta) in best.items():
            if len(score):
                yield as_batch(CANDIDATE, np.full(len(score), key), score, double_lists(theta))

    offered = rows.mapInArrow(offers, "residue int, key double, theta array<double>")
    place = F.row_number().over(Window.partitionBy("residue").orderBy(F.desc("key"), "theta"))
    kept = offered.withColumn("_place", place).filter(F.col("_place") <= size).orderBy("residue", "_place")
    picked = [(r["residue"], np.array(r["theta"])) for r in kept.select("residue", "theta").collect()]
    shared.unpersist()
    return picked


def nearest_counts(rows: DataFrame, found: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How many rows each candidate is the nearest of."""
    shared = broadcast(rows.sparkSession, found)

    def count(batches):
        known, total = shared.value, {}
        for key, _, theta in residue_batches(batches, known):
            n = total.setdefault(key, np.zeros(len(known[key]), np.int64))
            for _, place, _ in nearest(theta, known[key]):
                n += np.bincount(place, minlength=len(n))
        for key, n in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), key), pa.int32()), pa.array(np.arange(len(n)), pa.int32()), pa.array(n)],
                names=["residue", "place", "n"],
            )

    counted = rows.mapInArrow(count, "residue int, place int, n long").groupBy("residue", "place").agg(F.sum("n").alias("n"))
    out = {r: np.zeros(len(c), np.int64) for r, c in found.items()}
    for row in counted.collect():
        out[row["residue"]][row["place"]] = row["n"]
    shared.unpersist()
    return out


def drawn_centres(candidates: np.ndarray, counts: np.ndarray, k: int, seed: int, residue: int) -> np.ndarray:
    """k weighted k-means++ draws from the candidates."""
    unit = candidates / np.linalg.norm(candidates, axis=1, keepdims=True)
    u = uniform_array(seed, zlib.crc32(f"{residue}|centres".encode()), np.arange(k))
    far, picked = np.ones(len(candidates)), []
    for draw in range(k):
        weight = counts * np.where(far > SEED_DISTANCE, far, 0.0) ** 2
        total = np.cumsum(weight)
        at = int(np.searchsorted(total, u[draw] * total[-1])) if total[-1] > 0 else draw % len(candidates)
        picked.append(min(at, len(candidates) - 1))
        far = np.minimum(far, 1.0 - unit @ unit[picked[-1]])
    return candidates[picked]


def initial_mixtures(
    angles: DataFrame, masks: dict[int, np.ndarray], k: int = 100, seed: int = 0,
    tight: int = TIGHT_FEATURES,
) -> dict[int, Mixture]:
    """Seeded centres, random concentrations and equal weights."""
    centres, out = {}, {}
    for group in residue_groups({r: 8 * k * (2 * SEED_ROUNDS + 1) * len(m) for r, m in masks.items()}):
        centres.update(seed_centres(angles.filter(F.col("residue").isin(group)), group, k, seed))
    for residue, mu in centres.items():
        features = mu.shape[1]
        ids = np.arange(k * features)
        u = uniform_array(seed, zlib.crc32(f"{residue}|kappa".encode()), ids).reshape(k, features)
        low = np.where(np.arange(features) < tight, TIGHT_RANGE[0], LOOSE_RANGE[0])
        high = np.where(np.arange(features) < tight, TIGHT_RANGE[1], LOOSE_RANGE[1])
        mask = masks[residue]
        out[residue] = Mixture(
            mu, np.where(mask, low + u * (high - low), 0.0), np.full(k, -math.log(k)), mask
        )
    return out


def residue_groups(sizes: dict[int, int]) -> list[list[int]]:
    """Residues in groups of at most ``PARAMETER_BUDGET`` bytes (or one residue)."""
    groups, size = [[]], 0
    for residue in sorted(sizes):
        if groups[-1] and size + sizes[residue] > PARAMETER_BUDGET:
            groups.append([])
            size = 0
        groups[-1].append(residue)
        size += sizes[residue]
    return groups


def parameter_groups(mixtures: dict[int, Mixture], extra: int = 0) -> list[list[int]]:
    """Residues in groups by the size of their parameters plus ``extra`` bytes each."""
    return residue_groups({r: m.nbytes + extra for r, m in mixtures.items()})


def by_group(angles: DataFrame, mixtures: dict[int, Mixture], run, extra: int = 0) -> DataFrame:
    """``run(rows, parameters)`` for each group of residues, united.

    What a pass ships to the tasks stays below the budget for any number of residues.
    """
    groups = parameter_groups(mixtures, extra)
    if len(groups) == 1:
        return run(angles, mixtures)
    parts = [
        run(angles.filter(F.col("residue").isin(g)), {r: mixtures[r] for r in g}) for g in groups
    ]
    return reduce(DataFrame.unionByName, parts)


def sort_mixture(m: Mixture) -> Mixture:
    """Components from most to least weight."""
    order = np.argsort(-m.logw, kind="stable")
    return replace(m, mu=m.mu[order], kappa=m.kappa[order], logw=m.logw[order])


def sort_by_weight(params: DataFrame) -> DataFrame:
    """The same for a parameter table: ``comp`` renumbered by falling ``logw``."""
    rank = Window.partitionBy("residue").orderBy(F.desc("logw"), "comp")
    return params.withColumn("comp", F.row_number().over(rank) - 1)


def responsibilities(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, frame, r array<double>, log_density)."""
    return by_group(angles, mixtures, _responsibilities)


def _responsibilities(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    shared = broadcast(angles.sparkSession, mixtures)
    schema = pa.schema(
        [
            ("residue", pa.int32()), ("frame", pa.int64()), ("r", pa.list_(pa.float64())),
            ("log_density", pa.float64()),
        ]
    )

    def rows(batches):
        known = shared.value
        for key, frame, theta in residue_batches(batches, known):
            r, log_density = known[key].responsibilities(theta)
            yield as_batch(schema, np.full(len(frame), key), frame, double_lists(r), log_density)

    return angles.select("residue", "frame", "theta").mapInArrow(
        rows, "residue int, frame long, r array<double>, log_density double"
    )


PARAMS = pa.schema(
    [
        ("residue", pa.int32()), ("comp", pa.int32()), ("logw", pa.float64()),
        ("mu", pa.list_(pa.float64())), ("kappa", pa.list_(pa.float64())),
        ("mask", pa.list_(pa.bool_())),
    ]
)


def mixtures_table(spark, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, comp, logw, mu, kappa, mask)."""
    rows = [
        {
            "residue": r, "comp": i, "logw": float(m.logw[i]), "mu": m.mu[i].tolist(),
            "kappa": m.kappa[i].tolist(), "mask": m.mask.tolist(),
        }
        for r, m in sorted(mixtures.items()) for i in range(len(m.logw))
    ]
    return local_table(spark, rows, PARAMS)


def mixtures_of_table(params: DataFrame) -> dict[int, Mixture]:
    """The inverse of ``mixtures_table``."""
    out: dict[int, list] = {}
    for row in params.orderBy("residue", "comp").collect():
        out.setdefault(row["residue"], []).append(row)
    return {
        r: Mixture(
            np.array([x["mu"] for x in rows], np.float64),
            np.array([x["kappa"] for x in rows], np.float64),
            np.array([x["logw"] for x in rows], np.float64),
            np.array(rows[0]["mask"], bool),
        )
        for r, rows in out.items()
    }


def feature_rows(params: DataFrame) -> DataFrame:
    """(residue, comp, logw, feature, mu, kappa): one row per unmasked feature."""
    zipped = F.posexplode(F.arrays_zip("mu", "kappa", "mask")).alias("feature", "f")
    return params.select("residue", "comp", "logw", zipped).filter("f.mask").select(
        "residue", "comp", "logw", "feature", "f.mu", "f.kappa"
    )


def held_params(features: DataFrame) -> DataFrame:
    """Feature rows with angles wrapped and concentrations in range."""
    return features.withColumns(
        {"mu": wrap_angle(F.col("mu")), "kappa": clamp_kappa(F.col("kappa"))}
    )


def mask_table(angles: DataFrame, masks: DataFrame | None = None) -> dict[int, np.ndarray]:
    """Feature masks per residue; all features where no mask table is given.

    Residues are read from the partition column of ``by_residue`` alone; all have the same
    number of features.
    """
    if masks is not None:
        return {r["residue"]: np.array(r["m"], bool) for r in masks.collect()}
    width = angles.select(F.size("theta").alias("n")).first()["n"]
    residues = angles.select("residue").distinct().collect()
    return {r["residue"]: np.ones(width, bool) for r in residues}
