"""Embedding whitening by cyclic Jacobi rotations.

Entries become whole numbers on a grid, so sums and deviations are exact.  The
fit list is every distinct vector once.  One pass sums it by dimension; the next
one centres each vector (n * x - S in whole numbers, one division after it) and
gathers the scatter matrix, a partial one a task, summed by Spark.  The driver,
which holds matrices of dims x dims only, applies Jacobi rotations to it: a sweep
meets every pair of dimensions once, dims / 2 disjoint pairs at a time, until each
off-diagonal entry is below rounding against its own two diagonal entries,
which is what keeps small eigenvalues accurate.  The sorted and scaled
eigenvectors are broadcast (dims x components numbers), every row is projected,
and a last pass over the fit list measures how far the covariance of what came
out is from the identity.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries are dropped, so are vectors of another length than the commonest one (the
shorter on a tie); a null id keeps its row; repeated rows are projected each, but
fitted once; entries beyond 2**31 grid steps are held there; a component without
variance beyond rounding has null ``whitened`` and stands outside identity_error;
a deviation beyond 64 bits is null; an empty table gives no rows; other columns are not read.
Each eigenvector's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

GRID, SHIFT, COMPONENTS = 64, 1_000_000, 16
FAR = float(1 << 31)
#: Numbers of a block of vectors that is worked on at once.
BLOCK = 1 << 20
WHITENED = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with finite vectors of the commonest length, on the grid."""
    v = F.col(f"`{vector}`")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0)
    found = rows.select(F.col(f"`{key}`").alias("vec_id"), v.alias("v")).where(whole)
    common = found.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("k")).agg(F.max_by("dims", F.struct("k", F.negative("dims")))).first()[0]
    step = lambda c: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c.cast("double") * GRID))).cast("long") + SHIFT
    return found.where(F.size("v") == (common or 0)).select("vec_id", F.transform("v", step).alias("x"))


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of a list column of one length, in blocks."""
    if len(column):
        x = column.flatten().to_numpy().reshape(len(column), -1)
        step = max(1, BLOCK // x.shape[1])
        for at in range(0, len(x), step):
            yield x[at : at + step]


def _dimension_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """n and S; dims rows come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for x in _blocks(batch.column(0)):
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)).astype(np.int32)), pa.array(np.append(n, total))], ["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()
    s = rows.s.to_numpy(np.int64)
    return (int(s[0]), s[1:]) if len(s) else (0, s)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding: the difference is taken in whole numbers."""
    return (n * x - sums) / float(n)


def _mean_products(fit: DataFrame, of) -> np.ndarray:
    """Mean over the fit list of the products of all entries of ``of(x)``; a matrix of them comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for x in _blocks(batch.column(0)):
                z = of(x)
                n, total = n + len(x), total + z.T @ z
        if n:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k).astype(np.int32)), pa.array(np.tile(np.arange(k), k).astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(k * k, n))], ["i", "j", "s", "n"])

    rows = fit.select("x").mapInArrow(add, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i", "j").toPandas()
    k = int(len(rows) ** 0.5)
    return rows.m.to_numpy().reshape(k, k)


def _rounds(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of k things, as rounds of disjoint pairs."""
    seats = list(range(k + k % 2))
    out = []
    for _ in range(len(seats) - 1):
        p, q = np.array(seats[: len(seats) // 2]), np.array(seats[: len(seats) // 2 - 1 : -1])
        real = (p < k) & (q < k)
        out.append((np.minimum(p, q)[real], np.maximum(p, q)[real]))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix; fails if it doesn't settle."""
    a, k = (matrix + matrix.T) / 2, len(matrix)
    vectors, rounds, tiny = np.eye(k), _rounds(k), np.finfo(float).eps
    for _ in range(most_sweeps):
        turned = False
        for p, q in rounds:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            turn = (np.abs(apq) > tiny * np.sqrt(np.abs(app * aqq))) & (np.abs(apq) > np.finfo(float).tiny)
            if not turn.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[turn], q[turn], app[turn], aqq[turn], apq[turn]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            # What the rotation does to its own entries, without cancellation.
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
            v_p, v_q = vectors[:, p].copy(), vectors[:, q].copy()
            vectors[:, p], vectors[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
        if not turned:
            break
    else:
        raise RuntimeError(f"rotations not settled after {most_sweeps} sweeps")
    value = np.diag(a)
    order = np.argsort(-value, kind="stable")
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return value[order], vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - S) ** 2, null beyond 64 bits."""
    d = n * x - sums
    top = float(np.abs(d).max(initial=0))
    if top * top * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in d.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rows -> WHITENED, one row a usable row and component."""
    spark = rows.sparkSession
    schema = WHITENED.format(kind=rows.schema[key].dataType.simpleString())
    given = usable(rows, key, vector)
    fit = written(given.select("x").distinct(), "fit-list")
    n, sums = _dimension_sums(fit)
    if not n:
        return spark.createDataFrame([], schema)
    variance = _mean_products(fit, lambda x: centred(x, n, sums))
    trace = float(np.trace(variance))
    value, axes = jacobi(variance)
    value, axes = value[:components], axes[:, :components]
    real = value > len(variance) * np.finfo(float).eps * max(value[0], 0.0)
    shared = spark.sparkContext.broadcast(axes[:, real] / np.sqrt(value[real]))
    error = None
    if real.any():
        error = float(np.abs(_mean_products(fit, lambda x: centred(x, n, sums) @ shared.value) - np.eye(int(real.sum()))).max())
    k = len(value)
    explained = np.clip(value, 0, None) / trace if trace > 0 else np.full(k, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1)):
                m = len(x)
                z = np.full((m, k), np.nan)
                z[:, real] = centred(x, n, sums) @ shared.value
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, m).take(each),
                        pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)),
                        pa.array(np.full(m * k, n)),
                        pa.array(deviations(x, n, sums), pa.int64()).take(each),
                        pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                        pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m)),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )
                at += m

    return given.mapInArrow(project, schema)
