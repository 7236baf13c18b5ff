"""Whitening of embeddings: pivoted Cholesky of their centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become whole numbers floor(256 * c), so that equal ones are found and sums are exact. Spark
counts each distinct vector once, sums them, and adds up the scatter of the centred vectors, a
square matrix of the dimensions, in which the number of rows plays no part. Its Cholesky factor with
pivoting needs no further rotation of its own: one-sided Jacobi turns the factor's columns until they
are at right angles; then their norms are the roots of the eigenvalues and their directions the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_batches, table

SCALE = 256
_HALF = 1 << 32


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * c) of each entry as a long, the nearest long where it is beyond."""
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(vectors, np.float64) * SCALE) + 0.0
    top = x >= 2.0**63
    return np.where(top, np.int64(2**63 - 1), np.where(x < -(2.0**63), np.int64(-(2**63)), np.where(top, 0, x).clip(-(2.0**63)).astype(np.int64)))


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest whole-number type that holds it: equal rows give equal bytes, others different ones."""
    out: list[bytes] = [b""] * len(x)
    low, high = (x.min(axis=1), x.max(axis=1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    for kind in (np.int64, np.int32, np.int16):
        for k in np.flatnonzero((low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)):
            out[k] = x[k].astype(kind).tobytes()
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    """The rows that ``packed`` gave; a row's width tells its type."""
    kinds = {dims * 2: "<i2", dims * 4: "<i4", dims * 8: "<i8"}
    return np.array([np.frombuffer(r, kinds[len(r)]).astype(np.int64) for r in rows], np.int64).reshape(len(rows), dims)


def usable(vector: str) -> Column:
    """Whether a vector isn't null and holds neither null nor a number that isn't finite, nor nothing at all."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_list(rows: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """x binary: each distinct vector of whole numbers once, as ``packed``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(packed(whole_numbers(_matrix(batch.column(0), dims))), pa.binary())], ["x"])

    return over_batches(rows, [F.col(vector)], work, "x binary").distinct()


def exact_sums(fits: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of the packed vectors and their sums by dimension, exact however large: high and low halves are added apart."""

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & (_HALF - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = fits.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    by_i = {r["i"]: r for r in parts.collect()}  # one row a dimension
    return (by_i[0]["n"], [int(by_i[i]["high"]) * _HALF + int(by_i[i]["low"]) for i in range(dims)]) if by_i else (0, [0] * dims)


def scatter(fits: DataFrame, centred, dims: int) -> np.ndarray:
    """Sum of the outer products of ``centred(x)`` over the packed vectors; a task adds up its own before anything is shuffled.

    centred: gives the centred rows, ``dims`` wide, of a list of packed vectors.
    """
    upper = np.triu_indices(dims)

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            c = centred(batch.column(0).to_pylist())
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)) for k in upper] + [pa.array(total[upper])], ["i", "j", "v"])

    sums = fits.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # half a square of the dimensions
    out = np.zeros((dims, dims))
    i, j, v = (sums.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(a: np.ndarray, least: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """L and the order of rows p with a[p][:, p] = L L', the largest pivot first; as many columns as a has rank.

    least: a pivot that is left of less than this share of its own diagonal entry is rounding, not rank.
    """
    a = np.array(a, np.float64)
    d, order, l = len(a), np.arange(len(a)), np.zeros_like(a)
    left, own = np.diag(a).copy(), np.diag(a).copy()
    for k in range(d):
        left[k:][left[k:] <= least * own[k:]] = 0
        at = k + int(left[k:].argmax())
        if not left[at] > 0:
            return l[:, :k], order
        for v in (order, left, own):
            v[[k, at]] = v[[at, k]]
        l[[k, at], :k] = l[[at, k], :k]
        l[k, k] = np.sqrt(left[k])
        l[k + 1 :, k] = (a[order[k + 1 :], order[k]] - l[k + 1 :, :k] @ l[k, :k]) / l[k, k]
        left[k + 1 :] -= l[k + 1 :, k] ** 2
    return l, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60, close: float = 1e-15) -> np.ndarray:
    """``factor`` times a rotation that puts its columns at right angles to each other, longest first."""
    u = np.array(factor, np.float64).T.copy()  # columns as rows, which lie together
    n = len(u)
    even = np.arange(n + n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(even) - 1, 0)):  # pairs of a tournament: all of a round are apart and turn at once
            pairs = np.sort(np.stack([even[: len(even) // 2], even[::-1][: len(even) // 2]]), axis=0)
            p, q = pairs[:, pairs[1] < n]
            a, b, c = (u[p] ** 2).sum(axis=1), (u[q] ** 2).sum(axis=1), (u[p] * u[q]).sum(axis=1)
            on = np.abs(c) > close * np.sqrt(a * b)
            p, q, a, b, c = p[on], q[on], a[on], b[on], c[on]
            if len(p):
                turned = True
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                cos = (1 / np.hypot(1, t))[:, None]
                sin = cos * t[:, None]
                u[p], u[q] = cos * u[p] - sin * u[q], sin * u[p] + cos * u[q]
            even = np.concatenate([even[:1], even[-1:], even[1:-1]])
        if not turned:
            break
    return u[np.argsort(-(u**2).sum(axis=1), kind="stable")].T


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero of a symmetric matrix without negative ones, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(a).max(initial=0))
    if not scale > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    l, order = pivoted_cholesky(a / scale)
    u = one_sided_jacobi(l)
    norms = np.sqrt((u**2).sum(axis=0))
    vectors = np.empty_like(u)
    vectors[order] = u / norms
    return norms**2 * scale, vectors


@dataclass(frozen=True)
class Whitening:
    """n: vectors of the fit list. sums: theirs by dimension. values: eigenvalues, falling. vectors: components as columns.

    trace: of the covariance. identity_error: of the covariance of the fit list's whitened vectors.
    """

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the dimensions of (n * x - S)^2, exact."""
        far = max(self.n * int(np.abs(x).max(initial=0, where=x > -(2**63))) if not (x == -(2**63)).any() else self.n << 63, 0) + max(map(abs, self.sums), default=0)
        if far * far * max(self.dims, 1) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]


def dimensions(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most vectors have, the larger on ties; 0 without vectors."""
    first = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def fit(vectors: DataFrame, components: int = 4, vector: str = "embedding") -> Whitening | None:
    """Fit to each distinct vector once; None without usable vectors.

    Fewer components come out where the covariance has a smaller rank. Vectors of another length than
    ``dimensions`` gives take no part.
    """
    rows = vectors.filter(usable(vector)).select(vector)
    if not (dims := dimensions(rows, vector)):
        return None
    fits = table(fit_list(rows.filter(F.size(vector) == dims), dims, vector))
    n, sums = exact_sums(fits, dims)
    plain = Whitening(n, tuple(sums), np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    v = scatter(fits, lambda x: plain.centred(unpacked(x, dims)), dims) / n
    values, axes = eigen(v)
    found = Whitening(n, tuple(sums), values[:components], axes[:, :components], float(np.trace(v)), 0.0)
    k = len(found.values)
    if not k:
        return found

    def means(batches):
        for batch in batches:
            z = found.whitened(unpacked(batch.column(0).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(z.sum(axis=0))], ["i", "v"])

    by_i = {r["i"]: r["v"] / n for r in fits.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([by_i[i] for i in range(k)])
    spread = scatter(fits, lambda x: found.whitened(unpacked(x, dims)) - mean, k) / n
    return Whitening(n, found.sums, found.values, found.vectors, found.trace, float(np.abs(spread - np.eye(k)).max()))


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per usable row of ``vectors`` and component: vec_id, component int (from 1), n long, deviation decimal(38,0), whitened double, explained double, identity_error double.

    Rows whose vector is null, empty or of another length than the model's, or holds null or a number
    that isn't finite, are left out; a null vec_id stays null and repeated rows give repeated rows. A
    deviation beyond 38 digits is null. An empty table, and one whose vectors are all equal, gives no
    rows, as it has no components. Other columns are not read.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    dims = model.dims if model else 0
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # a few rows of the dimensions

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        m = shared.value
        k = len(m.values)
        if not k:
            return None
        x = whole_numbers(_matrix(batch.column(1), dims))
        n = len(x)
        rows = pa.array(np.repeat(np.arange(n), k))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n)), pa.array([str(v) for v in m.deviations(x)]).take(rows),
                pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.values / m.trace, n)), pa.array(np.full(n * k, m.identity_error)),
            ],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    rows = vectors.filter(usable(vector) & (F.size(vector) == dims))
    return over_batches(rows, [F.col(vec_id), F.col(vector)], work, schema).withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))
