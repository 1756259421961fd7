"""Density-based clustering of mixture components into states.

Components are close if they share responsibility for the same frames. The overlap of all
component pairs is one map over the data plus a sum; clustering then works on tables of
components, for any number of residues, leave-outs and neighbourhood sizes at once: each is a
value of the key columns ``by``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborinfo.functions.entropy import (
    plugin_entropy,
    posterior_mean_square,
    posterior_moments,
    posterior_sums,
)
from arborinfo.functions.rng import normal
from arborinfo.functions.special import entr
from arborinfo.lineage import broadcast, materialize, settle, ship_package
from arborinfo.operators.mixture import Mixture, as_batch, by_group, double_lists, residue_batches
from arborinfo.operators.spanning import connected_components

MIN_MASS = 0.01
# Matrix cells one task keeps before it emits them (8 bytes each).
CELL_BUDGET = 16_000_000
MATRIX_ROWS = pa.schema(
    [("residue", pa.int32()), ("key", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))]
)
MATRIX_DDL = "residue int, key int, i int, row array<double>"


def summed_matrices(angles: DataFrame, known: dict, part) -> DataFrame:
    """(residue, key, i, j, x): matrices summed over all frames.

    ``part(value, theta)`` yields (key, matrix) for a batch of one residue; each task adds
    them up before it emits their rows.
    """
    shared = broadcast(angles.sparkSession, known)

    def emit(acc):
        for (residue, key), matrix in acc.items():
            k = len(matrix)
            yield as_batch(
                MATRIX_ROWS, np.full(k, residue), np.full(k, key), np.arange(k), double_lists(matrix)
            )

    def rows(batches):
        acc, cells = {}, 0
        for residue, _, theta in residue_batches(batches, shared.value):
            for key, matrix in part(shared.value[residue], theta):
                at = (residue, key)
                if at in acc:
                    acc[at] = acc[at] + matrix
                else:
                    acc[at] = matrix
                    cells += matrix.size
            if cells > CELL_BUDGET:
                yield from emit(acc)
                acc, cells = {}, 0
        yield from emit(acc)

    partial = angles.select("residue", "frame", "theta").mapInArrow(rows, MATRIX_DDL)
    cells = partial.select("residue", "key", "i", F.posexplode("row").alias("j", "x"))
    return cells.groupBy("residue", "key", "i", "j").agg(F.sum("x").alias("x"))


def component_overlap(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, i, j, c, n) with c = sum over frames of sqrt(r_i r_j) and n the frame count.

    The diagonal is the summed responsibility of a component.
    """

    def part(mixture, theta):
        root = np.sqrt(mixture.responsibilities(theta)[0])
        yield 0, root.T @ root

    cells = by_group(angles, mixtures, lambda rows, known: summed_matrices(rows, known, part))
    # Responsibilities of a frame add up to one, so the trace counts the frames.
    total = Window.partitionBy("residue")
    n = F.sum(F.when(F.col("i") == F.col("j"), F.col("x"))).over(total)
    return cells.select("residue", "i", "j", F.col("x").alias("c"), F.round(n).cast("long").alias("n"))


def component_distances(overlap: DataFrame) -> DataFrame:
    """(residue, i, j, d) with d = 1 - c_ij / sqrt(c_ii c_jj); 1 for empty components."""
    own = overlap.filter("i = j")
    at = lambda end, name: own.select("residue", F.col("i").alias(end), F.col("c").alias(name))
    joined = overlap.join(at("i", "ci"), ["residue", "i"]).join(at("j", "cj"), ["residue", "j"])
    cosine = F.col("c") / F.nullif(F.sqrt(F.col("ci") * F.col("cj")), F.lit(0.0))
    d = F.when(F.col("i") == F.col("j"), 0.0).otherwise(1.0 - F.coalesce(cosine, F.lit(0.0)))
    return joined.select("residue", "i", "j", d.alias("d"))


def component_weights(overlap: DataFrame) -> DataFrame:
    """(residue, i, w, n): mean responsibility of each component."""
    return overlap.filter("i = j").select(
        "residue", "i", (F.col("c") / F.col("n")).alias("w"), "n"
    )


def neighbourhood(distances: DataFrame, eps: Column) -> DataFrame:
    """Component pairs at distance of at most ``eps``, each component being its own neighbour."""
    return distances.filter(F.col("d") <= eps)


def eps_of_spread(distances: DataFrame, k: float = 1.0) -> DataFrame:
    """(residue, eps): one minus k standard deviations of the distances, diagonal included."""
    return distances.filter("i <= j").groupBy("residue").agg(
        (1.0 - k * F.stddev_pop("d")).alias("eps")
    )


def density_states(
    near: DataFrame, weights: DataFrame, by: list[str], min_mass: float = MIN_MASS
) -> DataFrame:
    """(by..., comp, state, is_noise, w) of all components.

    ``near`` (by..., i, j, d) lists neighbours in both orders and each component itself,
    ``weights`` (by..., i, w) the weights. Components whose neighbourhood holds ``min_mass``
    are cores; cores that are neighbours share a state, any other component joins its nearest
    core neighbour (lowest id on ties), and all that is left becomes one noise state. States
    are numbered from most to least probable; noise is the last possible number.
    """
    near = settle(near.select(*by, "i", "j", "d"), "near")
    weights = settle(weights.select(*by, "i", "w"), "weights")
    mass = (
        near.join(weights.withColumnRenamed("i", "j"), [*by, "j"])
        .groupBy(*by, "i").agg(F.sum("w").alias("m"))
    )
    cores = settle(mass.filter(F.col("m") >= min_mass).select(*by, "i"), "cores")
    core_near = near.join(cores, [*by, "i"], "left_semi").join(
        cores.withColumnRenamed("i", "j"), [*by, "j"], "left_semi"
    )
    parts = connected_components(
        core_near.select(*by, F.col("i").alias("a"), F.col("j").alias("b")), by
    ).withColumnsRenamed({"node": "i"})
    border = (
        near.join(cores, [*by, "i"], "left_anti")
        .join(parts.withColumnRenamed("i", "j"), [*by, "j"])
        .groupBy(*by, "i").agg(F.min_by("component", F.struct("d", "j")).alias("component"))
    )
    joined = weights.join(parts.unionByName(border), [*by, "i"], "left")
    group = Window.partitionBy(*by, "component")
    everyone = Window.partitionBy(*by)
    sized = joined.withColumns({"_p": F.sum("w").over(group), "_k": F.count(F.lit(1)).over(everyone)})
    rank = Window.partitionBy(*by).orderBy(
        F.col("component").isNull(), F.desc("_p"), F.col("component")
    )
    noise = F.col("component").isNull()
    return sized.select(
        *by, F.col("i").alias("comp"),
        F.when(noise, F.col("_k") - 1).otherwise(F.dense_rank().over(rank) - 1).cast("int").alias("state"),
        noise.alias("is_noise"), "w",
    )


def states_of_cases(distances: DataFrame, cases: DataFrame, min_mass: float = MIN_MASS) -> DataFrame:
    """``density_states`` of many clusterings of each residue: (residue, key, comp, state, is_noise, w).

    ``cases`` (residue, key, eps, i, w) has the neighbourhood size and the weights of each
    clustering. A group is one residue: its distances are a matrix of components by components and
    its cases rows of weights, whatever the number of frames. Cases of the same weights are cuts of one
    ``Linkage``, at their sizes.
    """

    def cluster(matrix, parts):
        k = int(parts["i"].max()) + 1
        d = np.full((k, k), np.inf)
        d[matrix["i"], matrix["j"]] = matrix["d"]
        out, linkages = [], {}
        for key, part in parts.groupby("key"):
            w = np.zeros(k)
            w[part["i"]] = part["w"]
            linkage = linkages.get(w.tobytes())
            if linkage is None:
                linkage = linkages[w.tobytes()] = Linkage(d, w, min_mass)
            state, noise = linkage.cut(float(part["eps"].iloc[0]))
            ids = part["i"].to_numpy()
            out.append(pd.DataFrame({
                "residue": part["residue"].to_numpy(), "key": key, "comp": ids, "state": state[ids],
                "is_noise": noise[ids], "w": w[ids],
            }))
        return pd.concat(out)

    # Both may come from one table; columns of their own keep them apart.
    own = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names]).groupBy("residue")
    both = own(distances, "residue", "i", "j", "d").cogroup(own(cases, "residue", "key", "eps", "i", "w"))
    return both.applyInPandas(
        lambda a, b: cluster(a, b) if len(b) else pd.DataFrame(
            {c: [] for c in ("residue", "key", "comp", "state", "is_noise", "w")}
        ),
        "residue int, key int, comp int, state int, is_noise boolean, w double",
    )


class Linkage:
    """All density clusterings of one set of components, whatever the neighbourhood size.

    A component is a core from its core distance on: the radius in which it has ``min_mass``. Two cores are
    neighbours from the largest of their distance and both core distances on, so the states of all sizes are
    the cuts of one single-linkage tree over these mutual distances.
    """

    def __init__(self, d: np.ndarray, w: np.ndarray, min_mass: float):
        self.d, self.w = d, w
        k = len(w)
        order = np.argsort(d, axis=1, kind="stable")
        near = np.take_along_axis(d, order, axis=1)
        enough = np.cumsum(w[order], axis=1) >= min_mass
        self.core_distance = np.where(enough.any(axis=1), near[np.arange(k), enough.argmax(axis=1)], np.inf)
        mutual = np.maximum(np.maximum(d, self.core_distance[:, None]), self.core_distance[None, :])
        self.heights, merges = self._spanning(mutual)
        # Labels after 0, 1, 2, ... merges: the lowest member of each part.
        self.labels = np.empty((len(merges) + 1, k), np.int64)
        self.labels[0] = np.arange(k)
        for m, (a, b) in enumerate(merges):
            now = self.labels[m].copy()
            low, high = sorted((now[a], now[b]))
            now[now == high] = low
            self.labels[m + 1] = now

    @staticmethod
    def _spanning(mutual: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Heights and ends of the minimum spanning tree's edges, lowest first; infinite ones left out."""
        k = len(mutual)
        best, source = mutual[0].copy(), np.zeros(k, np.int64)
        free = np.ones(k, bool)
        free[0] = False
        edges = []
        for _ in range(k - 1):
            at = int(np.where(free, best, np.inf).argmin()) if free.any() else 0
            if not free[at]:  # all that is left is infinitely far
                at = int(free.argmax())
            edges.append((best[at], int(source[at]), at))
            free[at] = False
            nearer = free & (mutual[at] < best)
            best[nearer], source[nearer] = mutual[at][nearer], at
        edges = sorted(e for e in edges if np.isfinite(e[0]))
        return np.array([e[0] for e in edges]), [e[1:] for e in edges]

    def cut(self, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """(state, is_noise) of each component at the neighbourhood size ``eps``."""
        k = len(self.w)
        core = self.core_distance <= eps
        label = np.where(core, self.labels[np.searchsorted(self.heights, eps, "right")], k)
        rest = np.flatnonzero(~core)
        reach = np.where((self.d[rest] <= eps) & core, self.d[rest], np.inf)
        border = np.isfinite(reach).any(axis=1)
        label[rest[border]] = label[reach[border].argmin(axis=1)]
        noise = label == k
        mass = np.bincount(label, self.w, k + 1)[:k]
        found = np.unique(label[~noise])
        rank = np.full(k + 1, k - 1)
        rank[found[np.lexsort((found, -mass[found]))]] = np.arange(len(found))
        return rank[label], noise


def state_weights(membership: DataFrame, by: list[str]) -> DataFrame:
    """(by..., state, p): summed weight of each state."""
    return membership.groupBy(*by, "state").agg(F.sum("w").alias("p"))


def state_entropy(membership: DataFrame, n_obs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., s, s_pm, s_se): plug-in entropy of the state weights and its posterior moments
    with p * n as counts. ``n_obs`` is (residue, n)."""
    p = state_weights(membership, by).join(n_obs, "residue")
    p = p.withColumn("_n", F.col("p") * F.col("n"))
    sums = p.groupBy(*by).agg(F.expr(f"sum({entr('p')})").alias("s"), *posterior_sums("_n"))
    return posterior_moments(sums, "s_pm", "s_se")


def membership_matrices(membership: DataFrame, key: str | None = None) -> dict:
    """{residue: {key: 0/1 matrix (states, components)}}; states that occur, in order."""
    out: dict = {}
    columns = ["residue", "comp", "state"] + ([key] if key else [])
    table = membership.select(*columns).toPandas()
    table["_key"] = table[key] if key else 0
    for (residue, value), part in table.groupby(["residue", "_key"]):
        ids = np.sort(part["state"].unique())
        matrix = np.zeros((len(ids), int(table[table["residue"] == residue]["comp"].max()) + 1))
        matrix[np.searchsorted(ids, part["state"]), part["comp"]] = 1.0
        out.setdefault(int(residue), {})[int(value)] = (matrix, ids)
    return out


def assign_states(angles: DataFrame, mixtures: dict[int, Mixture], membership: DataFrame) -> DataFrame:
    """(residue, frame, state): the state of most summed responsibility, lowest id on ties."""
    schema = pa.schema([("residue", pa.int32()), ("frame", pa.int64()), ("state", pa.int32())])

    def assign(rows, group):
        matrices = membership_matrices(membership.filter(F.col("residue").isin(list(group))))
        shared = broadcast(rows.sparkSession, 
            {r: (m, *matrices[r][0]) for r, m in group.items()}
        )

        def states(batches):
            for residue, frame, theta in residue_batches(batches, shared.value):
                mixture, matrix, ids = shared.value[residue]
                p = mixture.responsibilities(theta)[0] @ matrix.T
                yield as_batch(schema, np.full(len(frame), residue), frame, ids[p.argmax(axis=1)])

        return rows.select("residue", "frame", "theta").mapInArrow(
            states, "residue int, frame long, state int"
        )

    return by_group(angles, mixtures, assign, matrix_bytes(mixtures))


def matrix_bytes(mixtures: dict[int, Mixture], copies: int = 1) -> int:
    """Bytes of ``copies`` membership matrices of the largest mixture."""
    return copies * 8 * max(len(m.logw) for m in mixtures.values()) ** 2


def density_matrix(
    angles: DataFrame, mixtures: dict[int, Mixture], membership: DataFrame, key: str | None = None
) -> DataFrame:
    """(residue, key, i, j, x): overlap of the square-root state responsibilities, trace one."""

    def part(value, theta):
        mixture, groupings = value
        r = mixture.responsibilities(theta)[0]
        for at, matrix in groupings.items():
            root = np.sqrt(r @ matrix.T)
            yield at, root.T @ root

    def summed(rows, group):
        matrices = membership_matrices(membership.filter(F.col("residue").isin(list(group))), key)
        known = {r: (m, {k: c for k, (c, _) in matrices[r].items()}) for r, m in group.items()}
        return summed_matrices(rows, known, part)

    copies = membership.agg(F.max(key)).first()[0] + 1 if key else 1
    cells = by_group(angles, mixtures, summed, matrix_bytes(mixtures, copies))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("x"))).over(
        Window.partitionBy("residue", "key")
    )
    return cells.withColumn("x", F.col("x") / trace)


def von_neumann_entropy(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by..., s_vn): -sum of l ln l over the eigenvalues of each symmetric matrix (by, i, j, x).

    A matrix has one row per state or component of a residue.
    """
    ship_package(cells.sparkSession)
    types = dict(cells.dtypes)

    def entropy(part: pd.DataFrame) -> pd.DataFrame:
        size = int(max(part["i"].max(), part["j"].max())) + 1
        matrix = np.zeros((size, size))
        matrix[part["i"], part["j"]] = part["x"]
        values = np.linalg.eigvalsh(matrix)
        terms = np.where(values > 0, -values * np.log(np.where(values > 0, values, 1.0)), 0.0)
        row = {c: part[c].iloc[0] for c in by}
        return pd.DataFrame([{**row, "s_vn": float(np.maximum(terms, 0.0).sum())}])

    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", s_vn double"
    return cells.groupBy(*by).applyInPandas(entropy, schema)


def replicate_moments(entropies: DataFrame) -> DataFrame:
    """(residue, s_mean, s_se) over replicates of posterior moments."""
    square = posterior_mean_square(F.col("s_pm"), F.col("s_se"))
    out = entropies.groupBy("residue").agg(F.avg("s_pm").alias("s_mean"), F.avg(square).alias("_sq"))
    spread = F.greatest(F.col("_sq") - F.col("s_mean") * F.col("s_mean"), F.lit(0.0))
    return out.select("residue", "s_mean", F.sqrt(spread).alias("s_se"))


def over_grid(table: DataFrame, key: str, values: list) -> DataFrame:
    """Each row once per value of a parameter grid of fixed length."""
    return table.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))


def eps_sweep(
    overlap: DataFrame, angles: DataFrame | None, mixtures: dict[int, Mixture] | None,
    grid: list[float] | None = None, min_mass: float = MIN_MASS,
) -> DataFrame:
    """(residue, eps, s, s_pm, s_se[, s_vn, z_sq_vn]) of the clusterings along a grid of eps.

    The von Neumann columns need one more pass over ``angles``.
    """
    grid = grid or [round(0.01 * i, 2) for i in range(1, 100)]
    by = ["residue", "key"]
    keys = list(range(len(grid)))
    eps = F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("key") + 1)
    weights = component_weights(overlap)
    cases = over_grid(weights, "key", keys).withColumn("eps", eps)
    membership = materialize(states_of_cases(component_distances(overlap), cases, min_mass), "sweep")
    n_obs = weights.select("residue", "n").distinct()
    out = state_entropy(membership, n_obs, by)
    columns = ["residue", eps.alias("eps"), "s", "s_pm", "s_se"]
    if angles is not None:
        matrices = density_matrix(angles, mixtures, membership, "key")
        out = out.join(von_neumann_entropy(matrices, by), by)
        z = (F.col("s_vn") - F.col("s")) / (F.col("s_se") + 1e-9)
        columns += ["s_vn", (z * z).alias("z_sq_vn")]
    return out.select(*columns)


def eps_resampling(
    overlap: DataFrame, eps: DataFrame, seed: int, replicates: int = 100, min_mass: float = MIN_MASS
) -> DataFrame:
    """(residue, s_mean, s_se) over clusterings with eps + z (1 - eps)^2, z standard normal.

    Draws are shared by all residues. ``eps`` is (residue, eps).
    """
    by = ["residue", "key"]
    keys = list(range(replicates))
    weights = component_weights(overlap)
    noisy = F.col("eps") + normal(seed, F.col("key")) * (1.0 - F.col("eps")) * (1.0 - F.col("eps"))
    grid = settle(over_grid(eps, "key", keys).select("residue", "key", noisy.alias("eps")), "eps")
    cases = over_grid(weights, "key", keys).join(grid, by)
    membership = states_of_cases(component_distances(overlap), cases, min_mass)
    n_obs = weights.select("residue", "n").distinct()
    return replicate_moments(state_entropy(membership, n_obs, by))


def left_out_weights(angles: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(residue, key, i, w): mean responsibilities after leaving component ``key`` out and
    renormalizing every frame. A frame that only ``key`` explains adds nothing."""

    def part(mixture, theta):
        r = mixture.responsibilities(theta)[0]
        rest = 1.0 - r
        # Where a component holds almost everything, the others are added up instead.
        each, top = np.arange(len(r)), r.argmax(axis=1)
        others = r.copy()
        others[each, top] = 0.0
        rest[each, top] = others.sum(axis=1)
        scale = np.where(rest > 0, 1.0 / np.where(rest > 0, rest, 1.0), 0.0)
        total = scale.T @ r
        np.fill_diagonal(total, 0.0)
        yield 0, total

    cells = by_group(angles, mixtures, lambda rows, known: summed_matrices(rows, known, part))
    return cells.select("residue", F.col("i").alias("key"), F.col("j").alias("i"), F.col("x").alias("w"))


def component_jackknife(
    angles: DataFrame, mixtures: dict[int, Mixture], overlap: DataFrame, eps: DataFrame,
    min_mass: float = MIN_MASS,
) -> DataFrame:
    """(residue, s_mean, s_se) over clusterings that leave out one component each."""
    by = ["residue", "key"]
    weights = component_weights(overlap)
    n_obs = weights.select("residue", "n").distinct()
    left = left_out_weights(angles, mixtures).join(n_obs, "residue")
    left = materialize(left.select(*by, "i", (F.col("w") / F.col("n")).alias("w")), "left_out")
    membership = states_of_cases(component_distances(overlap), left.join(eps, "residue"), min_mass)
    return replicate_moments(state_entropy(membership, n_obs, by))


def cluster_summary(membership: DataFrame, eps: DataFrame, n_obs: DataFrame) -> DataFrame:
    """(residue, n_states, eps, s, s_pm, s_se) of one clustering per residue."""
    counts = membership.groupBy("residue").agg(F.count_distinct("state").alias("n_states"))
    return counts.join(eps, "residue").join(state_entropy(membership, n_obs, ["residue"]), "residue")


def state_summary(states: DataFrame) -> DataFrame:
    """(residue, n_states, s, s_se) of assigned states."""
    counts = states.groupBy("residue", "state").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.groupBy("residue").agg(
        F.count(F.lit(1)).alias("n_states"), plugin_entropy("n").alias("s"),
        *posterior_sums("n"),
    )
    return posterior_moments(sums, "_m", "s_se").drop("_m")
