"""Expectation-maximization with the parameters as a table.

The state of a fit has one row a residue: its parameters, the likelihood of the last pass and whether it
has converged. The angles are packed into blocks of frames and bucketed by residue and slot, a slot being
some thousand frames of a residue. An iteration deals the state rows of active residues to the slots,
meets each slot's blocks where they lie (the angles are never shuffled again), and gathers
one row of sums a slot at the residue, where the new state row is made. Residues are as independent as
their rows: neither their number nor that of the frames is limited by the driver or by what a task
is shipped. Nothing but the number of active residues returns to the driver.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborinfo.functions.circular import MAX_KAPPA, MIN_KAPPA
from arborinfo.functions.special import BESSEL_RATIO
from arborinfo.lineage import local_table, materialize, scratch_path, ship_package
from arborinfo.operators.mixture import Mixture, sort_mixture

log = logging.getLogger("arborinfo")

#: Frames of a block, and of a slot on average.
BLOCK_FRAMES, SLOT_FRAMES = 256, 2048
NEWTON_STEPS = 4
STATE = pa.schema([
    ("residue", pa.int32()), ("mu", pa.list_(pa.float64())), ("kappa", pa.list_(pa.float64())),
    ("logw", pa.list_(pa.float64())), ("mask", pa.list_(pa.bool_())), ("iter", pa.int32()), ("ll", pa.float64()),
    ("converged", pa.bool_()),
])
STATE_SQL = (
    "residue int, mu array<double>, kappa array<double>, logw array<double>, mask array<boolean>,"
    " iter int, ll double, converged boolean"
)
SUMS_SQL = "residue int, n double, ll double, w array<double>, c array<double>, s array<double>"


@dataclass
class Blocks:
    """Packed angles: a table bucketed by (residue, slot)."""

    table: DataFrame
    slots: int
    name: str

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def packed(angles: DataFrame) -> Blocks:
    """Rows (residue, frame, theta) as bucketed blocks (residue, slot, theta), thetas end to end."""
    spark = angles.sparkSession
    ship_package(spark)
    frames = angles.groupBy("residue").count().agg(F.max("count")).first()[0] or 0
    slots = max(1, -(-frames // SLOT_FRAMES))

    def pack(batches):
        for batch in batches:
            residue = np.asarray(batch.column(0))
            theta = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            for value in np.unique(residue).tolist():
                rows = theta[residue == value]
                parts = [rows[low : low + BLOCK_FRAMES].ravel() for low in range(0, len(rows), BLOCK_FRAMES)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts), value), pa.int32()), pa.array(parts, pa.list_(pa.float64()))],
                    names=["residue", "theta"],
                )

    blocks = angles.select("residue", "theta").mapInArrow(pack, "residue int, theta array<double>")
    # Any deal will do, as long as a repeated task deals alike.
    blocks = blocks.withColumn("slot", F.pmod(F.xxhash64("theta"), F.lit(slots)).cast("int"))
    name = f"angles_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartition(buckets, "residue", "slot").write.format("parquet").bucketBy(
        buckets, "residue", "slot"
    ).sortBy("residue", "slot").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    return Blocks(spark.table(name), slots, name)


def state_of(spark, mixtures: dict[int, Mixture]) -> DataFrame:
    """The state table of given parameters."""
    rows = [
        {
            "residue": r, "mu": m.mu.ravel(), "kappa": m.kappa.ravel(), "logw": m.logw, "mask": m.mask.tolist(),
            "iter": -1, "ll": None, "converged": False,
        }
        for r, m in sorted(mixtures.items())
    ]
    return local_table(spark, rows, STATE)


def mixture_of(row: dict) -> Mixture:
    """The parameters of one state row."""
    k = len(row["logw"])
    shape = lambda name: np.array(row[name], np.float64).reshape(k, -1)
    return Mixture(shape("mu"), shape("kappa"), np.array(row["logw"], np.float64), np.array(row["mask"], bool))


def one_row(table: pa.Table) -> dict:
    return {
        name: column[0].values.to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else column[0].as_py()
        for name, column in zip(table.column_names, table.columns)
    }


def concentrations(length: np.ndarray) -> np.ndarray:
    """The concentration of each mean resultant length, held in its range, by Newton steps."""
    held = lambda k: np.clip(k, MIN_KAPPA, MAX_KAPPA)
    with np.errstate(divide="ignore"):
        kappa = held(np.where(length < 1, length * (2 - length**2) / (1 - length**2), MAX_KAPPA))
    for _ in range(NEWTON_STEPS):
        ratio = np.polynomial.polynomial.polyval(1 / kappa, BESSEL_RATIO)
        kappa = held(kappa - (ratio - length) / (1 - ratio**2 - ratio / kappa))
    return kappa


def slot_sums(key: tuple, blocks: pa.Table, state: pa.Table) -> pa.Table:
    """Sums of the E-step over one slot of one residue."""
    names = ["residue", "n", "ll", "w", "c", "s"]
    if not state.num_rows or not blocks.num_rows:
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3]
        return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
    m = mixture_of(one_row(state))
    theta = blocks.column("theta").combine_chunks().flatten().to_numpy().reshape(-1, m.mu.shape[1])
    total = None
    for low in range(0, len(theta), SLOT_FRAMES):
        part = theta[low : low + SLOT_FRAMES]
        r, ll = m.responsibilities(part)
        new = [len(part), ll.sum(), r.sum(axis=0), r.T @ np.cos(part), r.T @ np.sin(part)]
        total = new if total is None else [a + b for a, b in zip(total, new)]
    n, ll, w, c, s = total
    return pa.table({
        "residue": pa.array([key[0].as_py()], pa.int32()), "n": [float(n)], "ll": [float(ll)], "w": [w],
        "c": [c.ravel()], "s": [s.ravel()],
    })


def new_state(atol: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The M-step of one residue: its slots' sums and its old state row make the new one."""

    def step(key: tuple, sums: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:
            return STATE.empty_table()
        old = one_row(state)
        add = lambda name: sum(x.values.to_numpy() for x in sums.column(name).combine_chunks())
        if not sums.num_rows:  # a residue without frames stays as it is
            return state.set_column(state.column_names.index("converged"), "converged", pa.array([True])).cast(STATE)
        m = mixture_of(old)
        w, c, s = add("w"), add("c").reshape(m.mu.shape), add("s").reshape(m.mu.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.where(w[:, None] > 0, np.hypot(c, s) / w[:, None], 0.0)
            logw = np.log(w / w.max())
        mu = np.where(m.mask & (np.hypot(c, s) > 0), np.arctan2(s, c), 0.0)
        kappa = np.where(m.mask, concentrations(np.minimum(length, 1.0)), 0.0)
        ll = sum(sums.column("ll").to_pylist()) / sum(sums.column("n").to_pylist())
        done = old["ll"] is not None and abs(ll - old["ll"]) < atol
        return pa.Table.from_pylist([{
            "residue": key[0].as_py(), "mu": np.where(mu <= -math.pi, math.pi, mu).ravel(), "kappa": kappa.ravel(),
            "logw": logw, "mask": m.mask.tolist(), "iter": old["iter"] + 1, "ll": ll, "converged": bool(done),
        }], schema=STATE)

    return step


def iterate(blocks: Blocks, active: DataFrame, atol: float) -> DataFrame:
    """The state of the active residues after one more iteration."""
    dealt = active.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(blocks.slots - 1))))
    sums = blocks.table.groupBy("residue", "slot").cogroup(dealt.groupBy("residue", "slot")).applyInArrow(slot_sums, SUMS_SQL)
    return sums.groupBy("residue").cogroup(active.groupBy("residue")).applyInArrow(new_state(atol), STATE_SQL)


@dataclass
class TableFit:
    """The last state row of every residue, and a row for each residue and iteration."""

    state: DataFrame
    trace: DataFrame
    unconverged: int


def fit_state(
    angles: DataFrame, state: DataFrame, atol: float = 1e-2, max_iter: int = 100,
    on_iteration: Callable[[int, int, int], None] | None = None,
) -> TableFit:
    """Iterate from ``state`` until each residue's mean log-likelihood moves by less than ``atol``.

    Converged residues take no part in later iterations. The likelihood of an iteration belongs to
    the parameters it started from. Residues without frames stay as they are.
    """
    blocks = packed(angles)
    state = materialize(state.withColumns({"iter": F.lit(-1), "converged": F.lit(False)}), "state")
    total = left = state.count()
    passed: list[DataFrame] = []
    active = state
    for iteration in range(max_iter if left else 0):
        seen = Observation()
        new = iterate(blocks, active, atol).observe(seen, F.count_if(~F.col("converged")).alias("left"))
        new = materialize(new, "state")
        left = seen.get["left"]
        passed.append(new)
        if on_iteration:
            on_iteration(iteration, total - left, total)
        if not left:
            break
        active = new.filter(~F.col("converged"))
    blocks.drop()
    if left and max_iter:
        log.warning("%d of %d residues have not converged after %d iterations.", left, total, max_iter)
    if not passed:
        return TableFit(state, state.select("residue", "iter", "ll", "converged").limit(0), left)
    trace = reduce(DataFrame.unionByName, [p.select("residue", "iter", "ll", "converged") for p in passed])
    done = [p.filter("converged") for p in passed[:-1]] + passed[-1:]
    return TableFit(reduce(DataFrame.unionByName, done), trace, left)


def parameter_table(state: DataFrame) -> DataFrame:
    """(residue, comp, logw, mu, kappa, mask) of a state table, components from most to least weight."""
    width = F.size("mask")
    piece = lambda name: F.slice(name, F.col("place") * width + 1, width).alias(name)
    order = F.array_sort(
        F.transform("logw", lambda w, i: F.struct((-w).alias("low"), i.alias("place"), w.alias("logw")))
    )
    rows = state.select("residue", "mu", "kappa", "mask", F.posexplode(order).alias("comp", "of"))
    return rows.select(
        "residue", "comp", "of.logw", F.col("of.place").alias("place"), "mu", "kappa", "mask"
    ).select("residue", "comp", "logw", piece("mu"), piece("kappa"), "mask")


@dataclass
class Fit:
    """A fit whose parameters and trace are read from their tables when asked for."""

    table: TableFit

    @cached_property
    def mixtures(self) -> dict[int, Mixture]:
        """Parameters by residue, components from most to least weight."""
        rows = self.table.state.toArrow().to_pylist()
        return {r["residue"]: sort_mixture(mixture_of(r)) for r in sorted(rows, key=lambda r: r["residue"])}

    @cached_property
    def trace(self) -> list[dict]:
        return self.table.trace.orderBy("residue", "iter").toArrow().to_pylist()

    @cached_property
    def converged(self) -> dict[int, bool]:
        return {r["residue"]: r["converged"] for r in self.table.state.select("residue", "converged").toArrow().to_pylist()}


def fit_mixtures(
    angles: DataFrame, start: dict[int, Mixture], atol: float = 1e-2, max_iter: int = 100,
    on_iteration: Callable[[int, int, int], None] | None = None,
) -> Fit:
    """The fit from given parameters; residues without any are left out."""
    state = state_of(angles.sparkSession, start)
    return Fit(fit_state(angles, state, atol, max_iter, on_iteration))
