"""Embedding whitening: streaming moments of the distinct integer vectors, merged over partitions, and principal axes.

Welford's rank-one updates run in the tasks that hold the distinct vectors; what they leave (a count, a mean and a sum
of centred products) is merged by the parallel update formula of Chan et al., MERGE partitions at a time and then in
one task, which reads MERGE matrices one after another. The driver gets one matrix and solves it by Householder
tridiagonalisation and the symmetric QR algorithm; the axes, dimension times COMPONENTS, are broadcast.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise

SCALE, OFFSET, COMPONENTS, MERGE = 64, 1_000_000, 16, 32
#: Numbers that keep their whole part as double, and room for the offset.
LARGEST = float(1 << 52)
#: Vectors that a task holds as a matrix at a time.
ROWS = 4096


# -- streaming moments


@dataclass
class Moments:
    """Count, mean and sum of centred products of a stream of vectors."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.products += np.outer(before, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel update by another stream."""
        n = self.n + other.n
        if other.n:
            gap = other.mean - self.mean
            self.products += other.products + np.outer(gap, gap) * (self.n * other.n / n)
            self.mean += gap * (other.n / n)
            self.n = n

    def covariance(self) -> np.ndarray:
        """By divisor n, symmetric to the last bit."""
        c = self.products / max(self.n, 1)
        return (c + c.T) / 2


MOMENTS = "n long, mean binary, products binary"


def packed(m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.n], pa.int64()), pa.array([m.mean.tobytes()], pa.binary()), pa.array([m.products.tobytes()], pa.binary())], names=["n", "mean", "products"])


def merged(parts: DataFrame, d: int) -> Moments:
    """Moments of all parts: two levels of merging in tasks, one row to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Moments.empty(d)
        for b in batches:
            for k in range(b.num_rows):
                n, mean, products = (b.column(c)[k].as_py() for c in range(3))
                whole.merge(Moments(n, np.frombuffer(mean), np.frombuffer(products).reshape(d, d)))
        yield packed(whole)

    rows = parts.repartition(MERGE).mapInArrow(run, MOMENTS).repartition(1).mapInArrow(run, MOMENTS).collect()
    whole = Moments.empty(d)
    for r in rows:
        whole.merge(Moments(r.n, np.frombuffer(r["mean"]), np.frombuffer(r.products).reshape(d, d)))
    return whole


def matrices(batch: pa.RecordBatch, column: int, d: int) -> Iterator[np.ndarray]:
    """The arrays of a column as matrices of ROWS rows at most."""
    for at in range(0, batch.num_rows, ROWS):
        own = batch.column(column).slice(at, ROWS)
        yield own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)


def moments(vectors: DataFrame, d: int, project=None) -> Moments:
    """Moments of the vectors (column x, integers), or of what `project` makes of a matrix of them."""
    width = d if project is None else project(np.zeros((1, d), np.int64)).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.empty(width)
        for b in batches:
            for m in matrices(b, 0, d):
                # Integers less a fixed offset are exact and small: covariances do not change, digits are kept.
                for x in (m - OFFSET).astype(float) if project is None else project(m):
                    own.add(x)
        yield packed(own)

    return merged(vectors.select("x").mapInArrow(run, MOMENTS), width)


# -- symmetric eigenproblem


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with q' a q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = math.hypot(*v) if len(v) < 3 else float(np.linalg.norm(v))
        if not np.abs(v[1:]).any():
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix.

    Implicit QR steps with Wilkinson's shift on the tridiagonal form, each rotation applied to the basis. The largest
    entry of a vector is positive.
    """
    d, e, q = tridiagonal(a)
    hi, tiny = len(d) - 1, np.finfo(float).eps
    for _ in range(60 * len(d)):
        while hi > 0 and abs(e[hi - 1]) <= tiny * (abs(d[hi - 1]) + abs(d[hi])):
            e[hi - 1] = 0.0
            hi -= 1
        if hi <= 0:
            break
        lo = hi
        while lo > 0 and abs(e[lo - 1]) > tiny * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - off * off / (half + math.copysign(math.hypot(half, off), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, w, t = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * t + s * s * w, s * s * p - 2 * c * s * t + c * c * w
            e[k] = c * s * (w - p) + (c * c - s * s) * t
            left, right = q[:, k].copy(), q[:, k + 1].copy()
            q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    else:
        raise ArithmeticError("the QR steps did not converge")
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[:, order]
    if len(d):
        q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(len(d))] < 0, -1.0, 1.0)
    return d, q


# -- the operator


@dataclass
class Model:
    """What a fit learned: n vectors, their exact sums as n * whole + rest, axes (d, k), their variances, the trace, and the largest error of the whitened covariance."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors; NaN along axes without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.whole - self.rest / self.n) @ (self.axes / np.sqrt(np.where(self.variances > 0, self.variances, np.nan)))


def integers(vector: Column) -> Column:
    """floor(SCALE * c) + OFFSET of each entry, SCALE * c being held within LARGEST; null where the vector is null, empty, or has a null or non-finite entry."""
    c = vector.cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    x = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + OFFSET)
    return F.when((F.size(c) > 0) & ~F.exists(c, lambda v: F.coalesce(bad(v), F.lit(True))), x)


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """rows with x, those that have one, and the dimension: that of most vectors (the largest of equal ones); others are left out."""
    own = rows.withColumn("x", integers(F.col(vector))).filter("x is not null")
    found = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = found.d if found else 0
    return own.filter(F.size("x") == d), d


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """Model of the distinct vectors (column x) of dimension d; None without any."""
    vectors = materialise(rows.select("x").distinct(), "whitening-vectors")
    got = vectors.agg(F.count("*").alias("n"), *(F.sum((F.get("x", F.lit(k)) - OFFSET).cast("decimal(38,0)")).alias(f"s{k}") for k in range(d))).first()
    if not got.n:
        return None
    sums = [divmod(int(got[f"s{k}"]), got.n) for k in range(d)]
    mean = np.array([q + OFFSET for q, _ in sums], np.int64), np.array([r for _, r in sums], np.int64)
    v = moments(vectors, d).covariance()
    e, q = eigen(v)
    k = min(components, d)
    # What rounding leaves of an axis on which nothing varies is no variance.
    e = np.where(e > d * np.finfo(float).eps * max(float(e[0]), 0.0), e, 0.0)
    model = Model(got.n, *mean, q[:, :k], e[:k], float(np.trace(v)), None)
    if (e[:k] > 0).any():
        live = Model(got.n, *mean, q[:, :k][:, e[:k] > 0], e[:k][e[:k] > 0], model.trace, None)
        check = moments(vectors, d, live.project).covariance()
        model.identity_error = float(np.abs(check - np.eye(len(check))).max())
    return model


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Model, d: int, key: str) -> DataFrame:
    """A row a vector and component: (key, component, n, deviation, whitened, explained, identity_error)."""
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.variances)
        explained = pa.array(m.variances / m.trace if m.trace > 0 else [None] * k, pa.float64())
        for b in batches:
            at = 0
            for x in matrices(b, 1, d):
                off = x - m.whole
                far = ((m.n * off.astype(float) - m.rest) ** 2).sum(axis=1) > 9.2e18  # no long holds it
                off = m.n * off - m.rest
                deviation = pa.array((off * off).sum(axis=1), pa.int64(), mask=far)
                who = pa.array(np.repeat(np.arange(len(x)), k))
                w = m.project(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(x)).take(who), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(w), m.n)), deviation.take(who),
                    pa.array(w, mask=np.isnan(w)), pa.concat_arrays([explained] * len(x)), pa.array([m.identity_error] * len(w), pa.float64()),
                ], names=[key, *(c.split()[0] for c in OUT.split(", "))])
                at += len(x)

    return rows.select(key, "x").mapInArrow(run, f"{key} {kind}, {OUT}")


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector along the first principal axes of the distinct ones.

    Null and empty vectors, those with null or non-finite entries, and those of another dimension than most are left
    out. Repeated vectors count once in the fit; repeated rows and null keys each give their rows. An axis without
    variance (fewer distinct vectors than dimensions) has null whitened values and explains 0; with one distinct vector
    explained and identity_error are null. A deviation that no long holds is null, and entries beyond 2 ** 46 count as that. An empty table gives an empty one;
    other columns are ignored.
    """
    rows = rows.select(F.col(key), F.col(vector))
    own, d = usable(rows, vector)
    model = fit(own, d, components) if d else None
    if model is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, {OUT}")
    return transform(own, model, d, key)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every embedding along 16 axes."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
