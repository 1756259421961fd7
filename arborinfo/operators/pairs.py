"""Counting the joint states of every pair of variables.

The result is always (u, v, xu, xv, n) with u < v by name and states as strings. Three inputs
lead to it, none of which joins the data with itself or writes out a row per pair and frame:

* few columns of any type: count distinct joint rows first (one map-side combined shuffle,
  each input row is touched once), then spread that small table over the pairs;
* many columns, or an array of states per row: each task adds its rows into contingency
  matrices with numpy and emits only the non-zero cells, at its end;
* long (frame, var, state) rows: gather each frame's states into an array, then as above.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.special import quoted
from arborinfo.lineage import ship_package

NULL_STATE = "null"
# Up to this many variables a frame's states are gathered as one aggregate per variable.
PIVOT_VARIABLES = 64
# Above this many variables distinct joint rows rarely repeat, so matrices are counted instead.
MAX_JOINT_VARIABLES = 12
# Cells one task keeps in memory (4 bytes each in matrices, 16 as codes).
CELL_BUDGET = 24_000_000
# State numbers that are turned into cells at a time.
CHUNK_CODES = 2_000_000


def text(name: str) -> str:
    """SQL for the state of a column as a string."""
    return f"coalesce(CAST(`{name}` AS STRING), '{NULL_STATE}')"


def pair_cells(variables: list[str], state=text) -> Column:
    """array<struct<u, v, xu, xv>>: the states of all pairs of variables of a row."""
    cells = [
        f"struct({quoted(u)} AS u, {quoted(v)} AS v, {state(u)} AS xu, {state(v)} AS xv)"
        for u, v in combinations(sorted(variables), 2)
    ]
    return F.expr(f"array({', '.join(cells)})")


def joint_counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """Distinct joint states with their count ``n``; states become strings."""
    counted = df.groupBy(*variables).agg(F.count(F.lit(1)).alias("n"))
    return counted.selectExpr(*[f"{text(v)} AS `{v}`" for v in variables], "n")


def pairs_of_joint(joint: DataFrame, variables: list[str]) -> DataFrame:
    """Pair counts of a table of distinct joint states."""
    cells = pair_cells(variables, lambda v: f"`{v}`")
    spread = joint.select(F.explode(cells).alias("p"), "n").select("p.*", "n")
    return spread.groupBy("u", "v", "xu", "xv").agg(F.sum("n").alias("n"))


class Cells:
    """Joint counts of all pairs of variables in one task.

    States are numbered as they are met, for each variable by itself, so matrices are as wide as the
    states that occur. One matrix per variable u holds the cells of all later v side by side. When
    the matrices outgrow ``budget`` cells, occupied cells are kept as sorted codes instead, and
    are handed over in parts when these outgrow it too.
    """

    def __init__(self, n_vars: int, budget: int = CELL_BUDGET):
        self.n, self.budget = n_vars, budget
        self.known: list[dict[str, int]] = [{} for _ in range(n_vars)]
        self.width = np.full(n_vars, 4, np.int64)
        self.dense: list[np.ndarray] | None = [np.zeros(4 * 4 * (n_vars - 1 - u), np.int32) for u in range(n_vars - 1)]
        self.sparse: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n_vars - 1)]

    def number(self, v: int, values: list[str]) -> np.ndarray:
        known = self.known[v]
        return np.array([known.setdefault(x, len(known)) for x in values], np.int64)

    def _fit(self) -> None:
        """Widen the matrices for the states known by now."""
        need = np.array([len(k) for k in self.known])
        if self.dense is None or (need <= self.width).all():
            return
        old = self.width.copy()
        while (need > self.width).any():
            self.width = np.where(need > self.width, 2 * self.width, self.width)
        after = np.append(np.cumsum(self.width[::-1])[::-1][1:], 0)
        if (self.width * after).sum() > self.budget:
            for u, flat in enumerate(self.dense):
                x, v, y, n = self._cells(u, flat, old)
                order = np.argsort(code := self._code(x, v, y))
                self.sparse[u] = [(code[order], n[order].astype(np.int64))]
            self.dense = None
            return
        for u, flat in enumerate(self.dense):
            before = flat.reshape(old[u], -1)
            grown = np.zeros((self.width[u], after[u]), np.int32)
            at, to = 0, 0
            for v in range(u + 1, self.n):
                grown[: old[u], to : to + old[v]] = before[:, at : at + old[v]]
                at, to = at + old[v], to + self.width[v]
            self.dense[u] = grown.ravel()

    def _cells(self, u: int, flat: np.ndarray, width: np.ndarray):
        """(state of u, v, state of v, count) of the occupied cells of u's matrix."""
        offsets = np.cumsum(width[u + 1 :]) - width[u + 1 :]
        at = np.flatnonzero(flat)
        x, place = np.divmod(at, int(width[u + 1 :].sum()))
        k = np.searchsorted(offsets, place, "right") - 1
        return x, k + u + 1, place - offsets[k], flat[at]

    @staticmethod
    def _code(x, v, y):
        return (v << 48) | (x << 24) | y

    def add(self, codes: np.ndarray) -> None:
        """Count rows of state numbers."""
        self._fit()
        if max(len(k) for k in self.known) >= 1 << 24:
            raise ValueError("a variable has more than 16 million states in one task")
        later = np.arange(self.n)
        for low in range(0, len(codes), step := max(1, CHUNK_CODES // self.n)):
            part = codes[low : low + step]
            for u in range(self.n - 1):
                if self.dense is not None:
                    width = self.width[u + 1 :]
                    place = part[:, u + 1 :] + (np.cumsum(width) - width)
                    place += part[:, [u]] * int(width.sum())
                    self.dense[u] += np.bincount(place.ravel(), minlength=len(self.dense[u])).astype(np.int32)
                else:
                    code = self._code(part[:, [u]], later[u + 1 :], part[:, u + 1 :])
                    self.sparse[u].append(np.unique(code.ravel(), return_counts=True))
                    if len(self.sparse[u]) > 8:
                        self._merge(u)

    def _merge(self, u: int) -> None:
        code = np.concatenate([c for c, _ in self.sparse[u]])
        found, at = np.unique(code, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in self.sparse[u]]))
        self.sparse[u] = [(found, total)]

    def full(self) -> bool:
        return self.dense is None and sum(len(c) for s in self.sparse for c, _ in s) > self.budget

    def emit(self):
        """What has been counted, as batches; counting starts anew."""
        names = [np.array(list(k), object) for k in self.known]
        for u in range(self.n - 1):
            if self.dense is not None:
                x, v, y, n = self._cells(u, self.dense[u], self.width)
                self.dense[u][:] = 0
            else:
                if not self.sparse[u]:
                    continue
                self._merge(u)
                ((code, n),) = self.sparse[u]
                v, x, y = code >> 48, (code >> 24) & 0xFFFFFF, code & 0xFFFFFF
                self.sparse[u] = []
            if not len(n):
                continue
            xv = np.empty(len(n), object)
            for k in np.unique(v):
                xv[v == k] = names[k][y[v == k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), u), pa.int32()), pa.array(v, pa.int32()),
                 pa.array(names[u][x], pa.string()), pa.array(xv, pa.string()), pa.array(n, pa.int64())],
                names=["u", "v", "xu", "xv", "n"],
            )


def _count_columns(batches, budget: int = CELL_BUDGET):
    """Cells of batches with one text column per variable."""
    cells = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = cells or Cells(batch.num_columns, budget)
        codes = np.empty((batch.num_rows, batch.num_columns), np.int64)
        for v, column in enumerate(batch.columns):
            coded = column.dictionary_encode()
            codes[:, v] = cells.number(v, coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        cells.add(codes)
        if cells.full():
            yield from cells.emit()
    if cells:
        yield from cells.emit()


def _count_batches(batches, budget: int = CELL_BUDGET):
    """Cells of batches with one array of states per row."""
    cells = None
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column(0).flatten()
        n_vars = len(flat) // batch.num_rows
        cells = cells or Cells(n_vars, budget)
        if flat.null_count:
            flat = flat.cast(pa.string()).fill_null(NULL_STATE)
        states = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_vars)
        codes = np.empty(states.shape, np.int64)
        for v in range(n_vars):
            values, at = np.unique(states[:, v], return_inverse=True)
            codes[:, v] = cells.number(v, [str(x) for x in values.tolist()])[at]
        cells.add(codes)
        if cells.full():
            yield from cells.emit()
    if cells:
        yield from cells.emit()


def _summed(found: DataFrame, variables: list[str]) -> DataFrame:
    names = F.array(*[F.lit(v) for v in variables])
    return found.groupBy("u", "v", "xu", "xv").agg(F.sum("n").alias("n")).select(
        F.element_at(names, F.col("u") + 1).alias("u"), F.element_at(names, F.col("v") + 1).alias("v"),
        "xu", "xv", "n",
    )


CELLS = "u int, v int, xu string, xv string, n long"


def pairs_of_arrays(df: DataFrame, states: Column, variables: list[str]) -> DataFrame:
    """Pair counts where ``states`` holds each row's states as integers, in the order of
    ``variables`` (which must be sorted by name). A null element is the state ``null``."""
    if list(variables) != sorted(variables):
        raise ValueError("variables must be sorted by name")
    ship_package(df.sparkSession)
    found = df.select(states.cast("array<bigint>").alias("x")).mapInArrow(lambda b: _count_batches(b), CELLS)
    return _summed(found, variables)


def pair_counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """Pair counts of the columns ``variables``; each row is one joint observation.

    Columns may be of any type; a missing value is the state ``null``. The number of columns decides
    between two plans with the same result, each of which reads the rows once.
    """
    variables = sorted(variables)
    if len(variables) < 2 or len(set(variables)) < len(variables):
        raise ValueError("need at least two distinct variables")
    if len(variables) <= MAX_JOINT_VARIABLES:
        return pairs_of_joint(joint_counts(df, variables), variables)
    ship_package(df.sparkSession)
    texts = df.select(*[F.expr(text(v)).alias(f"c{k}") for k, v in enumerate(variables)])
    return _summed(texts.mapInArrow(lambda b: _count_columns(b), CELLS), variables)


def frame_arrays(states: DataFrame, variables: list[str]) -> DataFrame:
    """(frame, x array<int>) of long (frame, var, state) rows; x follows sorted ``variables``.

    A frame holds one state per variable, so gathering it needs no more room than the variable
    list. Frames with missing or repeated variables are refused.
    """
    want = len(variables)
    if want <= PIVOT_VARIABLES:
        # Plain maxima stay in generated code and combine map-side.
        at = [f"max(CASE WHEN var = {quoted(v)} THEN CAST(state AS INT) END)" for v in variables]
        gathered = states.groupBy("frame").agg(
            F.count(F.lit(1)).alias("k"), F.expr(f"array({', '.join(at)})").alias("x")
        )
        whole = (F.col("k") == want) & ~F.exists("x", lambda s: s.isNull())
    else:
        gathered = states.groupBy("frame").agg(
            F.sort_array(F.collect_list(F.struct("var", F.col("state").cast("int").alias("state"))))
            .alias("g")
        ).select("frame", F.col("g.var").alias("k"), F.col("g.state").alias("x"))
        whole = F.col("k") == F.array(*[F.lit(v) for v in variables])
    refuse = F.raise_error(F.lit("a frame does not hold exactly one state per variable"))
    return gathered.select("frame", F.when(whole, F.col("x")).otherwise(refuse).alias("x"))


def pair_counts_long(states: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Pair counts of long (frame, var, state) rows."""
    if variables is None:
        variables = [r["var"] for r in states.select("var").distinct().collect()]
    variables = sorted(variables)
    return pairs_of_arrays(frame_arrays(states, variables), F.col("x"), variables)


def pair_probabilities(pair_counts: DataFrame) -> DataFrame:
    """Pair counts with p = n / total of the pair."""
    total = pair_counts.groupBy("u", "v").agg(F.sum("n").alias("_t"))
    return pair_counts.join(total, ["u", "v"]).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def node_counts(pair_counts: DataFrame) -> DataFrame:
    """(var, state, n) from the pairs of one variable; no further pass over the data.

    Every variable has a pair with the first one, on either side of it.
    """
    first = pair_counts.agg(F.min(F.least("u", "v"))).first()[0]
    own = pair_counts.filter((F.col("u") == first) | (F.col("v") == first))
    left = F.col("u") == first
    own = own.select(
        F.when(left, F.col("v")).otherwise(F.col("u")).alias("var"),
        F.when(left, F.col("xv")).otherwise(F.col("xu")).alias("state"),
        F.when(left, F.col("xu")).otherwise(F.col("xv")).alias("own"), "n",
    )
    partner = own.agg(F.min("var")).first()[0]
    cells = F.array(
        F.struct("var", "state"),
        F.when(F.col("var") == partner, F.struct(F.lit(first).alias("var"), F.col("own").alias("state"))),
    )
    return (
        own.select(F.explode(cells).alias("c"), "n").filter("c is not null")
        .groupBy("c.var", "c.state").agg(F.sum("n").alias("n"))
    )
