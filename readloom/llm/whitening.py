"""Embedding whitening (operator 12): blockwise TSQR, then one-sided Jacobi SVD of the small factor.

Entries become whole numbers x = floor(1024 * c) + 100000, so counts and sums over all vectors are exact.  Centred rows
x - S / n are compressed to a triangular factor R a block at a time; each task returns one R, and R's of several tasks are
stacked and factored again until one is left, so nothing larger than ``FAN`` factors meets in a task.  Plane rotations
orthogonalise R's columns; the rotations together are the components, the columns' norms over sqrt(n) their standard
deviations.  The covariance matrix is never formed, so small deviations keep their digits.

Defined results: rows whose vector is null or empty or holds null or non-finite entries are dropped, and so are vectors of
another dimension than the commonest one (of several the largest).  Entries are limited to 2^53 either way.  ``deviation``
is null where it is beyond a long.  A component without variance has whitened null and doesn't count in identity_error;
without any variance explained is null.  Null and repeated vec_ids are rows like others.  An empty table gives an empty
result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import map_arrow, staged
from readloom.llm.vectors import finite

#: Components returned, factors that meet in one task, numbers of a block of rows.
MOST, FAN, BLOCK = 8, 16, 1 << 20
LIMIT = 2.0**53


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """A batch's vectors as whole numbers."""
    c = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return np.clip(np.floor(1024 * c), -LIMIT, LIMIT).astype(np.int64) + 100000


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact n * x - S where that fits a long."""
    if len(x) and n * max(int(np.abs(x).max()), *map(abs, sums)) >= 1 << 62:
        return x - np.array([s / n for s in sums])
    return (n * x - np.array(sums, np.int64)) / n


def rotations(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: ``(V, norms)`` with orthonormal V and orthogonal columns of r @ V, by falling norm.

    Each round rotates disjoint pairs of columns together; the rounds of a sweep are those of a round-robin tournament.
    """
    d = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(d)
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        moved = False
        for _ in range(len(ring) - 1):
            p, q = np.sort(np.stack([ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]]), axis=0)
            real = q < d
            p, q = p[real], q[real]
            ring[1:] = np.roll(ring[1:], 1)
            alpha, beta, gamma = (a[:, p] ** 2).sum(axis=0), (a[:, q] ** 2).sum(axis=0), (a[:, p] * a[:, q]).sum(axis=0)
            turn = np.abs(gamma) > 4e-16 * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            moved = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not moved:
            break
    norm = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norm, kind="stable")
    return v[:, order], norm[order]


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            x = whole(batch, dim)
            if len(x):
                part = x.sum(axis=0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(axis=0)
                total, n = [a + int(b) for a, b in zip(total, part)], n + len(x)
        places = pa.array(np.arange(dim + 1, dtype=np.int32))  # the last one is the number of rows
        yield pa.RecordBatch.from_arrays([places, pa.array([*map(Decimal, [*total, n])], pa.decimal128(38, 0))], names=["place", "total"])

    return run


def _factor(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _factors(dim: int, n: int, sums: list[int]):
    """One triangular factor of all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, step = np.zeros((0, dim)), max(dim, BLOCK // dim)
        for batch in batches:
            x = centred(whole(batch, dim), n, sums)
            for lo in range(0, len(x), step):
                r = _factor(r, x[lo : lo + step])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    return run


def _stack(dim: int):
    def run(rows: pa.Table) -> pa.Table:
        r = np.zeros((0, dim))
        for x in sorted(rows.column("r").to_pylist()):
            r = _factor(r, np.array(x).reshape(-1, dim))
        return pa.table({"r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return run


def triangular(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows, by a tree of tasks."""
    level = staged(map_arrow(vectors.select("vector"), _factors(dim, n, sums), "r array<double>"), "factors")
    while (count := level.count()) > 1:
        numbered = level.withColumn("group", F.pmod(F.xxhash64("r"), F.lit(-(-count // FAN))))
        level = staged(numbered.groupBy("group").applyInArrow(_stack(dim), "r array<double>"), "factors")
    row = level.first()
    return np.array(row["r"]).reshape(-1, dim) if row else np.zeros((0, dim))


def _moments(dim: int, n: int, sums: list[int], project: np.ndarray):
    """A task's rows, means and centred products of whitened values, by place."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(whole(batch, dim), n, sums) @ project
            if not len(w):
                continue
            here = w.mean(axis=0)
            d = here - mean
            m2 += (w - here).T @ (w - here) + np.outer(d, d) * rows * len(w) / (rows + len(w))
            mean += d * len(w) / (rows + len(w))
            rows += len(w)
        i, j = (x.ravel().astype(np.int32) for x in np.indices((k, k)))
        between = rows * np.outer(mean, mean)
        values = [i, j, m2.ravel() + between.ravel(), rows * mean[i]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["i", "j", "products", "sums"])

    return run


def _whiten(dim: int, n: int, sums: list[int], project: np.ndarray, some: np.ndarray):
    """``some``: the components that have variance, one column of ``project`` each."""
    k = len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch, dim)
            center = centred(x, n, sums)
            guess = ((center * n) ** 2).sum(axis=1)
            with np.errstate(over="ignore"):
                exact = n * x - np.array([((s + (1 << 63)) % (1 << 64)) - (1 << 63) for s in sums], np.int64)
                exact = (exact * exact).sum(axis=1)  # whole numbers modulo 2^64: right wherever the sum itself fits
            deviation = pa.array(exact, mask=guess >= 2.0**63 * (1 - 1e-9))
            w = np.full((len(x), k), np.nan)
            w[:, some] = center @ project
            at = np.repeat(np.arange(len(x)), k)
            place = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            arrays = [batch.column("vec_id").take(pa.array(at)), pa.array(place), deviation.take(pa.array(at)), pa.array(w.ravel(), mask=~np.tile(some, len(x)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "deviation", "whitened"])

    return run


def whiten(table: DataFrame, most: int = MOST) -> DataFrame:
    """``table(vec_id, embedding, ...)`` -> ``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    spark = table.sparkSession
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(finite("vector"))
    dims = base.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if dims is None:
        return spark.createDataFrame([], ddl)
    dim = dims["dim"]
    base = base.where(F.size("vector") == dim)
    totals = map_arrow(base.select("vector"), _sums(dim), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    *sums, n = (int(r["total"]) for r in totals.orderBy("place").collect())  # as many numbers as dimensions

    r = triangular(base, dim, n, sums)
    components, norms = rotations(r)
    k = min(most, dim)
    variance = norms**2 / n
    scale = norms[:k] / np.sqrt(n)
    some = scale > dim * np.finfo(float).eps * max(norms[0] / np.sqrt(n), 1e-300)
    project = components[:, :k][:, some] / scale[some]

    error = None
    if some.any():
        sums_of = map_arrow(base.select("vector"), _moments(dim, n, sums, project), "i int, j int, products double, sums double").groupBy("i", "j").agg(F.sum("products").alias("products"), F.sum("sums").alias("sums")).collect()
        mean = {r["i"]: r["sums"] / n for r in sums_of}
        error = max(abs(r["products"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in sums_of)
    total = variance.sum()
    share = F.array(*[F.lit(float(variance[i] / total) if total else None).cast("double") for i in range(k)])
    rows = map_arrow(base, _whiten(dim, n, sums, project, some), "vec_id long, component int, deviation long, whitened double")
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
