"""Whitening of vectors by shifted CholeskyQR.

The distinct centred rows A are made orthonormal in passes over the table. A pass forms the Gram matrix of the rows as
they stand, the driver takes its Cholesky factor R, and the next pass solves the rows against all factors found so far,
so no orthogonal factor is ever stored. The first Gram matrix is shifted by a little more than its rounding errors,
which lets the factor exist whatever the rows' condition; passes go on until the Gram matrix is the identity. The
product of the factors is the R of A = QR, and its singular vectors and values are the components and their deviations.

Tasks hold one matrix of a dimension squared, which is added up in two steps; the driver holds a few such matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relfold.llm.common import small_batches, written

#: Components in the result, passes at most, and how far from the identity the last Gram matrix may be, per dimension.
COMPONENTS, PASSES, ORTHONORMAL = 16, 8, 1e-14
#: A component whose deviation is below this share of the largest one has no variance but rounding.
NO_VARIANCE = 1e-10
# x = floor(64 c) + 1000000. Products beyond LARGEST are cut to it, so that x stays a long.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 60
ROUNDING = 2.0**-53


def scaled_vector(vector: Column) -> Column:
    """x as array<bigint>; null if the vector is null or holds null or non-finite entries."""
    values = vector.cast("array<double>")
    good = F.forall(values, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    cut = F.transform(values, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + OFFSET)
    return F.when(good, cut)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows of an array column, whole batches at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q of QR = rows for an upper triangular R, column after column."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


@dataclass(frozen=True)
class Centre:
    """The exact mean sums / n of the fit list."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and remaining part of n times the mean, so that n x - S = n (x - whole) - rest."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - w * self.n for s, w in zip(self.sums, whole)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision, from exact differences."""
        whole, rest = self.parts()
        return (x - whole).astype(np.float64) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 for each row, exactly; null where it is beyond a long."""
        whole, rest = self.parts()
        apart = x - whole
        most = (int(np.abs(apart).max()) + 1) * self.n if apart.size else 0
        if most * most * max(1, x.shape[1]) < 1 << 62:
            return ((apart * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, rest)) for row in apart]
        return [v if v < 1 << 63 else None for v in exact]


def _added_up(partial: DataFrame) -> np.ndarray:
    """The sum of matrices (task, m) given as bytes: groups of tasks first, so that the driver gets about the square
    root of their number."""
    tasks = partial.agg(F.max("task")).first()[0]
    if tasks is None:
        return np.empty(0)
    groups = max(1, math.isqrt(tasks + 1))

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.float64) for m in part.sort_by("task")["m"].to_pylist())
        return pa.table({"group": pa.array([part["group"][0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    grouped = partial.select((F.col("task") % groups).cast("int").alias("group"), "task", "m").groupBy("group").applyInArrow(add, "group int, m binary")
    rows = sorted(grouped.collect(), key=lambda r: r["group"])
    return sum(np.frombuffer(r["m"], np.float64) for r in rows)


def upper_factor(g: np.ndarray) -> np.ndarray:
    """R of RᵀR = g. Where g is singular, its directions without length count as of unit length."""
    try:
        return np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        values, axes = np.linalg.eigh(g)
        none = axes[:, values <= NO_VARIANCE * values[-1]]
        return np.linalg.cholesky(g + values[-1] * none @ none.T).T


def gram(fit: DataFrame, dimension: int, transform, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrix, column sums) of transformed rows of ``fit`` (x); one matrix leaves a task."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((columns + 1, columns))
        seen = False
        for batch in batches:
            if batch.num_rows:
                rows = transform(_matrix(batch.column(0), dimension))
                total[:columns] += rows.T @ rows
                total[columns] += rows.sum(axis=0)
                seen = True
        if seen:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "m"])

    total = _added_up(written(fit.select("x").mapInArrow(multiplied, "task int, m binary"))).reshape(columns + 1, columns)
    return total[:columns], total[columns]


@dataclass(frozen=True)
class Whitening:
    """``components``: unit eigenvectors as columns, by falling eigenvalue; ``values``: eigenvalues, 0 where there is
    no variance but rounding; ``trace``: sum of all of them; ``error``: largest entry of the whitened fit list's
    covariance minus the identity, as measured; ``passes``: Gram passes until the rows were orthonormal."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows' whitened components; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centre.centred(x) @ self.components / np.sqrt(self.values)
        out[:, self.values == 0] = np.nan
        return out


def fit_whitening(fit: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted on the distinct vectors ``fit`` (x array<bigint> of ``dimension`` entries each, read several
    times); None for an empty table."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact sums of a task's rows: high and low halves apart, as long as they fit."""
        total, count = [0] * dimension, 0
        for batch in batches:
            x = _matrix(batch.column(0), dimension)
            high, low = x >> 32, x & 0xFFFFFFFF
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high.sum(axis=0), low.sum(axis=0))]
            count += len(x)
        if count:
            yield pa.record_batch([pa.array(range(-1, dimension), pa.int32()), pa.array([str(v) for v in [count, *total]])], names=["at", "total"])

    sums = fit.select("x").mapInArrow(summed, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["at"]: int(r["total"]) for r in sums.collect()}
    if not found:
        return None
    centre = Centre(found[-1], tuple(found[d] for d in range(dimension)))
    n = centre.n
    factors: list[np.ndarray] = []
    passes, offset = 0, None
    while passes < PASSES:

        def solved(x: np.ndarray, factors=tuple(factors)) -> np.ndarray:
            rows = centre.centred(x)
            for r in factors:
                rows = triangular_solve(rows, r)
            return rows

        g, s = gram(fit, dimension, solved, dimension)
        passes += 1
        offset = s / n if offset is None else offset
        if not np.trace(g) > 0:
            break
        # Directions without variance never become unit vectors: the matrix is then a projection instead.
        if factors and np.abs(g @ g - g).max() <= ORTHONORMAL * dimension * math.sqrt(n):
            break
        if not factors:
            g = g + np.eye(dimension) * (11 * (dimension * n + dimension * (dimension + 1)) * ROUNDING * np.trace(g))
        factors.append(upper_factor(g))
    if not factors:
        size = min(components, dimension)
        return Whitening(centre, np.eye(dimension)[:, :size], np.zeros(size), 0.0, 0.0, passes)
    whole = factors[0]
    for r in factors[1:]:
        whole = r @ whole
    kinds, turned = np.linalg.eigh(g)
    _, deviations, axes = np.linalg.svd((turned * np.sqrt(np.where(kinds > 0.5, kinds, 0.0))).T @ whole)
    values = np.where(deviations > NO_VARIANCE * deviations[0], deviations**2 / n, 0.0)
    axes = axes[:components]
    # Either sign will do; the largest entry is made positive, so that reruns agree.
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    model = Whitening(centre, axes.T, values[: len(axes)], float(values.sum()), 0.0, passes)
    varying = model.values > 0
    mean = (offset @ model.components)[varying] / np.sqrt(model.values[varying])
    g, _ = gram(fit, dimension, lambda x: model.whitened(x)[:, varying] - mean, int(varying.sum()))
    error = float(np.abs(g / n - np.eye(len(g))).max())
    return Whitening(centre, model.components, model.values, model.trace, error, passes)


RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def scaled_rows(vectors: DataFrame, vector: str, identity: str) -> tuple[DataFrame, int]:
    """((vec_id, x), dimension): rows whose vector is null or holds null or non-finite entries, or has another length
    than most, are dropped. Of equally common lengths the greatest counts; empty vectors count as none."""
    rows = vectors.select(F.col(f"`{identity}`").alias("vec_id"), scaled_vector(F.col(f"`{vector}`")).alias("x")).where(F.size("x") > 0)
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = most["d"] if most else 0
    return rows.where(F.size("x") == dimension), dimension


def whiten(vectors: DataFrame, vector: str = "embedding", identity: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n (distinct vectors), deviation, whitened, explained and identity_error for every
    remaining row of ``vectors`` and component up to ``components``.

    Rows without a usable vector are dropped (see ``scaled_rows``); repeated rows and ids stay, a null id stays null.
    Repeated vectors weigh once. A component without variance has null whitened values and explains 0, or null if there
    is no variance at all; identity_error looks at the others. ``deviation`` is null beyond a long. Other columns are
    ignored. No rows give an empty result.
    """
    small_batches(vectors.sparkSession)
    kept, dimension = scaled_rows(vectors, vector, identity)
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, {RESULT}"
    fit = written(kept.select("x").distinct())
    model = fit_whitening(fit, dimension, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = len(model.values)
    explained = [float(v / model.trace) if model.trace else None for v in model.values]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = _matrix(some.column("x"), dimension)
                rows = len(x)
                take = pa.array(np.repeat(np.arange(rows), size))
                values = model.whitened(x).ravel()
                yield pa.record_batch(
                    [
                        some.column("vec_id").take(take), pa.array(np.tile(np.arange(1, size + 1), rows), pa.int32()),
                        pa.array(np.full(rows * size, model.centre.n, np.int64)), pa.array(model.centre.deviations(x), pa.int64()).take(take),
                        pa.array(values, mask=np.isnan(values)), pa.array(explained * rows, pa.float64()), pa.array(np.full(rows * size, model.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.select("vec_id", "x").mapInArrow(projected, schema)
