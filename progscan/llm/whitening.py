"""Operator 13: embedding whitening.

The entries of a vector become fixed-point integers, so equal vectors are equal
exactly and their sums are exact. The fit list holds every distinct vector once.
Each task sums its part (count, exact sums, scatter about its own mean) and the
parts are merged pairwise exactly by the shift of their means, over two rounds of
tasks; only one d x d matrix reaches the driver. There the centred scatter gets a
Cholesky factor with diagonal pivoting, and one-sided Jacobi rotations make the
columns of that triangular factor orthogonal: their squared norms are the
eigenvalues and the normalised columns, with the pivoting undone, the
components. Small eigenvalues keep their relative accuracy, because the
covariance is never multiplied out again.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from progscan.llm.common import table, written
from progscan.llm.registry import job

#: Fixed-point steps of an entry.
STEPS = 256
#: Components that are returned.
COMPONENTS = 4
#: Longest vector that is fitted: the driver and each merging task hold two matrices of MAX_DIMENSION squared.
MAX_DIMENSION = 4096

_STATE = "state binary"


def fixed_point(vector: Column) -> Column:
    """floor(256 c) of each entry c, as longs; null for a vector that is null or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(c * STEPS)))


def _matrix(column, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Moments:
    """Count, sum and scatter about the mean of some vectors. Integer sums stay exact."""

    def __init__(self, n: int, total: np.ndarray, scatter: np.ndarray):
        self.n, self.total, self.scatter = n, total, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        total = x.sum(axis=0)
        centred = x - total / len(x)
        return cls(len(x), total, centred.T @ centred)

    def __add__(self, other: Moments) -> Moments:
        shift = self.total / self.n - other.total / other.n
        between = np.outer(shift, shift) * (self.n * other.n / (self.n + other.n))
        return Moments(self.n + other.n, self.total + other.total, self.scatter + other.scatter + between)


def _merged(states) -> list:
    whole = None
    for s in states:
        whole = s if whole is None else whole + s
    return [] if whole is None else [pa.RecordBatch.from_arrays(
        [pa.array([pickle.dumps((whole.n, whole.total, whole.scatter))], pa.binary())], ["state"])]


def moments(vectors: DataFrame, d: int, of=None) -> Moments | None:
    """The moments of the ``x`` column (lists of d numbers), or of ``of`` applied to its matrix; None for no rows."""
    def partial(batches):
        yield from _merged(Moments.of(of(m) if of else m) for m in (
            _matrix(b.column(0), d) for b in batches if b.num_rows))

    def merge(batches):
        yield from _merged(Moments(*pickle.loads(s.as_py())) for b in batches for s in b.column(0))

    parts = vectors.select("x").mapInArrow(partial, _STATE)
    some = max(1, math.isqrt(vectors.rdd.getNumPartitions()))
    rows = parts.repartition(some).mapInArrow(merge, _STATE).coalesce(1).mapInArrow(merge, _STATE).collect()
    return Moments(*pickle.loads(rows[0]["state"])) if rows else None


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L^T, L lower trapezoidal with as many columns as a has rank."""
    d = len(a)
    order, left = np.arange(d), a.diagonal().copy()
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            return factor[:, :k], order
        for v in (order, left):
            v[[k, p]] = v[[p, k]]
        factor[[k, p]] = factor[[p, k]]
        factor[k, k] = math.sqrt(left[k])
        column = a[order[k + 1:], order[k]] - factor[k + 1:, :k] @ factor[k, :k]
        factor[k + 1:, k] = column / factor[k, k]
        left[k + 1:] -= factor[k + 1:, k] ** 2
    return factor, order


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal: one-sided Jacobi.

    A round turns disjoint pairs of columns at once; the rounds of a sweep are
    those of a tournament, so each pair meets once.
    """
    g = factor.copy()
    r = g.shape[1]
    table_of = list(range(r + r % 2))
    tol = np.finfo(float).eps * math.sqrt(max(1, len(g)))
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(table_of) - 1):
            half = len(table_of) // 2
            pairs = [(p, q) for p, q in zip(table_of[:half], reversed(table_of[half:]), strict=True) if max(p, q) < r]
            p, q = (np.array(v) for v in zip(*pairs, strict=True))
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(aa * bb)
            turn = np.abs(ab) > tol * size
            if turn.any():
                worst = max(worst, float((np.abs(ab[turn]) / size[turn]).max()))
                z = (bb[turn] - aa[turn]) / (2 * ab[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a, b = a[:, turn], b[:, turn]
                g[:, p[turn]], g[:, q[turn]] = c * a - s * b, s * a + c * b
            table_of = [table_of[0], table_of[-1], *table_of[1:-1]]
        if worst <= tol:
            break
    return g


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a covariance, as many as its rank."""
    factor, order = pivoted_cholesky(covariance)
    turned = orthogonal_columns(factor)
    norms = np.linalg.norm(turned, axis=0)
    falling = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned / norms
    return norms[falling] ** 2, vectors.T[falling]


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum of (n x - total)^2 of each row, exactly; None beyond 63 bits."""
    off = np.abs(n * x.astype(float) - total).max(initial=0.0)
    if len(total) * off * off < 2.0 ** 62:
        return ((n * x - total) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(k, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Unusable rows (null vectors, null or non-finite entries) are left out; so
    are empty vectors and those of another length than the most frequent one
    (the longer on ties). Repeated vectors count once in the fit and each row
    gets its values; null and repeated keys are ordinary. There are no more
    components than the rank of the covariance: none, hence no rows, where all
    vectors are equal or the table is empty. A deviation beyond 63 bits is null.
    Only key and vector are read.
    """
    spark = embeddings.sparkSession
    source = embeddings.select(F.col(key).alias("k"), fixed_point(F.col(vector)).alias("x"))
    fit = written(source.select("x").where("size(x) > 0").distinct(), "whitening-fit")
    common = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = StructType([StructField("k", source.schema["k"].dataType), *StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION} are fitted")
    fit = fit.where(F.size("x") == d)
    whole = moments(fit, d)
    n, total = whole.n, whole.total
    covariance = whole.scatter / n
    values, vectors = components(covariance)
    values, vectors = values[:count], vectors[:count]
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = (values / np.trace(covariance)).tolist()
    onto, mean = (vectors / np.sqrt(values)[:, None]).T, total / n

    def project(x):
        return (x - mean) @ onto

    check = moments(fit, d, project)
    error = float(np.abs(check.scatter / n - np.eye(len(values))).max())

    def rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, c = _matrix(b.column(1), d), len(explained)
            each = np.repeat(np.arange(b.num_rows), c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), b.num_rows)),
                 pa.array(np.full(len(each), n)), pa.array(deviations(x, n, total), pa.int64()).take(pa.array(each)),
                 pa.array(project(x).ravel()), pa.array(explained * b.num_rows), pa.array(np.full(len(each), error))],
                schema.names)

    return source.where(F.size("x") == d).mapInArrow(rows, schema)


@job("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("k", "vec_id")
