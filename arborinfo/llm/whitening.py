"""Whitening of vectors by shifted Cholesky QR.

Entries become whole numbers, floor(64 c) + 1000000, so that sums and centred rows are exact. The fit
takes passes of one kind over the rows, each read from the source: tasks form the Gram matrix
of their rows and send it, cut into blocks of its rows, into two rounds of sums. The first Gram
matrix A'A of the centred rows gets a shift just above its rounding errors and a Cholesky factor
R1; later passes see the rows A inv(R1) inv(R2) ..., got by triangular solves, and their factors bring them
to orthogonality at the level of rounding, however badly A is conditioned. The singular value
decomposition of R = R3 R2 R1 then has the right singular vectors of A (the components) and its
singular values (n times the variances, squared) without A'A having been decomposed itself.

Bounds: the driver and each broadcast hold a few matrices of dimension by dimension, whatever the
number of rows; a task of a sum holds strips of ``CELLS`` cells of one in ``SLOTS`` of
the other tasks.

Defined cases: rows whose vector is null or has a null or non-finite entry are not in the result. Vectors
of different lengths are fits of their own, empty vectors have no components. Repeated rows count as often
as they are there. Entries beyond 2^46 count as 2^46. Components whose variance is zero within
rounding (fewer rows than dimensions, constant or dependent entries) have a null ``whitened``, and
``explained`` is null where no entry varies; they do not enter ``identity_error``. A ``deviation`` beyond
a long is null. The sign of a component makes its largest entry positive. An empty table gives no
rows. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from arborinfo.lineage import broadcast

SCALE, OFFSET = 64, 1_000_000
#: Largest size of a whole entry; sums of its pieces of 18 bits are exact as doubles for 2^35 rows.
LARGEST = 1 << 52
BITS = 18
PASSES = 3
#: Cells of a matrix that a task of a sum holds of each other task, and groups of tasks added first.
CELLS = 8192
SLOTS = 256
#: Vectors worked on at a time.
ROWS = 4096
EPS = np.finfo(np.float64).eps
#: Singular values below this part of the largest are rounding errors.
NOTHING = 1e-12
PARTIAL = "size int, strip int, slot int, cells array<double>"


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    total: list[int]
    exact: bool  # n times an entry fits a long
    factors: list[np.ndarray]
    components: np.ndarray | None = None  # one a row
    variance: np.ndarray | None = None
    trace: float = 0.0
    rank: int = 0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.exact:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squared(self, x: np.ndarray) -> list[int | None]:
        """Sums of squared deviations, null beyond a long."""
        d = self.deviations(x)
        largest = int(np.abs(d).max()) if d.size else 0
        if largest * largest * max(d.shape[1], 1) < 1 << 63:
            return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
        sums = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """Coordinates on the first ``k`` components, NaN for those that do not vary."""
        out = np.full((len(x), min(k, x.shape[1])), np.nan)
        m = min(self.rank, out.shape[1])
        out[:, :m] = self.centred(x) @ self.components[:m].T / np.sqrt(self.variance[:m])
        return out


def solved(rows: np.ndarray, upper: np.ndarray, step: int = 64) -> np.ndarray:
    """rows @ inv(upper), by forward substitution over blocks of columns."""
    out = np.empty_like(rows)
    for low in range(0, rows.shape[1], step):
        part = slice(low, low + step)
        rest = rows[:, part] - out[:, :low] @ upper[:low, part]
        out[:, part] = np.linalg.solve(upper[part, part].T, rest.T).T
    return out


def whole_entries(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries as whole numbers) of the usable vectors, by length, some rows at a time."""
    if pa.types.is_null(vectors.type):
        return
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        among = np.flatnonzero(sizes == size)
        for low in range(0, len(among), ROWS):
            rows = among[low : low + ROWS]
            c = values[starts[rows][:, None] + np.arange(size)]
            good = np.isfinite(c).all(axis=1)
            if good.any():
                x = np.clip(np.floor(c[good] * SCALE) + OFFSET, -LARGEST, LARGEST)
                yield rows[good], x.astype(np.int64)


def summed(
    vectors: DataFrame, name: str, width: Callable[[int], int], made: Callable[[np.ndarray], np.ndarray]
) -> dict[int, np.ndarray]:
    """Sums of the matrices that ``made`` gives for the entries of some rows, by length of the vectors.

    ``width`` has the columns of a matrix. Each task adds up its own; strips of matrix rows are then
    added within slots of tasks, and the sums of the slots once more, so that no task meets the
    matrices of all others.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId() % SLOTS
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_entries(batch.column(0)):
                held[x.shape[1]] = held.get(x.shape[1], 0) + made(x)
        for size, matrix in held.items():
            step = max(1, CELLS // matrix.shape[1])
            for k, low in enumerate(range(0, len(matrix), step)):
                yield strip_of(size, k, slot, matrix[low : low + step].ravel())

    def add(key: tuple, table: pa.Table) -> pa.Table:
        cells = table.column("cells").combine_chunks()
        total = cells.flatten().to_numpy().reshape(len(cells), -1).sum(axis=0)
        return pa.Table.from_batches([strip_of(*[k.as_py() for k in (*key, pa.scalar(0))[:3]], total)])

    parts = vectors.select(name).mapInArrow(gather, PARTIAL)
    once = parts.groupBy("size", "strip", "slot").applyInArrow(add, PARTIAL)
    rows = once.groupBy("size", "strip").applyInArrow(add, PARTIAL).toArrow()
    cells: dict[int, list] = {}
    for row in sorted(rows.to_pylist(), key=lambda r: (r["size"], r["strip"])):
        cells.setdefault(row["size"], []).extend(row["cells"])
    return {size: np.array(flat).reshape(-1, width(size)) for size, flat in cells.items()}


def strip_of(size: int, strip: int, slot: int, cells: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), pa.array(cells, pa.float64()))
    keys = [pa.array([k], pa.int32()) for k in (size, strip, slot)]
    return pa.RecordBatch.from_arrays([*keys, lists], names=["size", "strip", "slot", "cells"])


def pieces(x: np.ndarray) -> np.ndarray:
    """Rows of the number of ``x`` and of the sums of its pieces of ``BITS`` bits, low ones first."""
    low = (1 << BITS) - 1
    parts = [np.ones_like(x), x & low, (x >> BITS) & low, x >> 2 * BITS]
    return np.stack([p.sum(axis=0) for p in parts]).astype(np.float64)


def begun(sums: np.ndarray) -> Fit:
    n = int(sums[0, 0])
    total = [sum(int(v) << k * BITS for k, v in enumerate(column)) for column in sums[1:].T]
    largest = max(abs(t) for t in total) + n * LARGEST
    return Fit(n, total, largest < 1 << 62, [])


def factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular Cholesky factor of ``gram``, shifted by its rounding errors if asked or needed."""
    size = len(gram)
    shift = 100 * size * EPS * max(np.trace(gram), np.finfo(np.float64).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * shifted * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift *= 1 if not shifted else 10
            shifted = True


def finished(fit: Fit) -> Fit:
    """The components, from the singular values of the product of all factors."""
    product = fit.factors[0]
    for later in fit.factors[1:]:
        product = later @ product
    _, sizes, rows = np.linalg.svd(product)
    peak = np.take_along_axis(rows, np.abs(rows).argmax(axis=1)[:, None], 1)
    fit.components = rows * np.where(peak < 0, -1.0, 1.0)
    fit.variance = sizes**2 / fit.n
    fit.trace = float(fit.variance.sum())
    # Where nothing varies, the shift of the first factor is all that there is.
    fit.rank = int((sizes > max(NOTHING * sizes[0], 1e-100)).sum())
    return fit


def fit_vectors(vectors: DataFrame, name: str = "embedding") -> dict[int, Fit]:
    """Components of the vectors of each length: one pass for sums, ``PASSES`` for Gram matrices."""
    fits = {size: begun(sums) for size, sums in summed(vectors, name, lambda size: size, pieces).items()}
    for turn in range(PASSES if fits else 0):
        shipped = broadcast(vectors.sparkSession, fits)

        def gram(x: np.ndarray, shipped=shipped) -> np.ndarray:
            known = shipped.value[x.shape[1]]
            rows = known.centred(x)
            for upper in known.factors:
                rows = solved(rows, upper)
            return rows.T @ rows

        for size, matrix in summed(vectors, name, lambda size: size, gram).items():
            fits[size].factors.append(factor(matrix, turn == 0))
        shipped.unpersist()
    return {size: finished(fit) for size, fit in fits.items()}


def identity_errors(vectors: DataFrame, fits: dict[int, Fit], k: int, name: str = "embedding") -> dict[int, float]:
    """Largest absolute entry of the covariance of the first ``k`` whitened coordinates minus the identity."""
    if not fits:
        return {}
    shipped = broadcast(vectors.sparkSession, fits)
    columns = lambda size: min(k, fits[size].rank) + 1

    def moments(x: np.ndarray) -> np.ndarray:
        known = shipped.value[x.shape[1]]
        rows = np.ones((len(x), min(k, known.rank) + 1))
        rows[:, 1:] = known.whitened(x, k)[:, : min(k, known.rank)]
        return rows.T @ rows

    out = {}
    for size, sums in summed(vectors, name, columns, moments).items():
        mean = sums[0, 1:] / fits[size].n
        odd = sums[1:, 1:] / fits[size].n - np.outer(mean, mean) - np.eye(len(mean))
        out[size] = float(np.abs(odd).max()) if odd.size else 0.0
    return out


def whiten(vectors: DataFrame, k: int = 32, key: str = "vec_id", name: str = "embedding") -> DataFrame:
    """A row for each usable vector and each of its first ``k`` components.

    Columns: ``key``, component (from 1), n, deviation (sum of the squares of n x - S), whitened,
    explained (share of the variance), identity_error.
    """
    fits = fit_vectors(vectors, name)
    errors = identity_errors(vectors, fits, k, name)
    shipped = broadcast(vectors.sparkSession, (fits, errors))
    id_type = vectors.schema[key].dataType.simpleString()
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odd = shipped.value
        for batch in batches:
            for at, x in whole_entries(batch.column(1)):
                fit = known[x.shape[1]]
                white = fit.whitened(x, k)
                m = white.shape[1]
                explained = fit.variance[:m] / fit.trace if fit.rank else np.full(m, np.nan)
                each = np.repeat(np.arange(len(at)), m)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), fit.n, np.int64)),
                    pa.array(fit.squared(x), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(at)), from_pandas=True),
                    pa.array(np.full(len(each), odd[x.shape[1]])),
                ], names=names)

    schema = (
        f"`{key}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double,"
        " identity_error double"
    )
    return vectors.select(key, name).mapInArrow(rows, schema)
