"""Whitening of embeddings by a randomised range finder.

Entries are made whole numbers first (SCALE steps a unit, raised by SHIFT), so that counts and sums are exact. The covariance is never built
unless it must be: a random test matrix of wanted + OVERSAMPLE columns is multiplied by it in passes over all centred rows,

    Y = (1 / n) sum of (x - mean) ((x - mean)' Q),

made orthonormal after each (a power pass), and the Rayleigh-Ritz values and vectors of Q' Y are the components once
their residuals |V u - e u| are at rounding level. Where the spectrum has no gap behind the columns, POWER passes do not get there: then Q
becomes the whole space, whose one pass gives the covariance itself, and the same Rayleigh-Ritz step the components.

A pass sends one matrix a partition into SLOTS groups, each summed by a task, and SLOTS matrices of (length x columns) doubles to the driver:
that size depends on the vectors' length only. The components, as many, go back with the tasks' code.

Semantics: vectors that are null, empty, or hold a null or non-finite entry, or one of magnitude 2**42 or more (whose step would not
be exact), are dropped. Vectors of each length are whitened on their own. Components of no variance (under 1e-12 of the trace) have no rows, so
equal vectors alone give none. Repeated rows and null ids count as vectors of their own; extra columns are ignored; an empty table
gives an empty result. A deviation beyond the range of long (over some millions of rows) is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, map_batches

SCALE, SHIFT = 1024, 100_000
OVERSAMPLE, POWER, SLOTS = 8, 4, 32
RESIDUAL = 1e-13
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def prepare(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, d (length), x (its whole numbers as little-endian 64-bit integers) of the usable vectors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, lists = batch.column(0), batch.column(1)
        keep, length, blobs = [], [], []
        for i, v in enumerate(lists):
            if v.is_valid and len(v) and not v.values.null_count:
                c = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(c).all() and np.abs(c).max() < 2.0**42:
                    keep.append(i)
                    length.append(len(c))
                    blobs.append((np.floor(SCALE * c).astype("<i8") + SHIFT).tobytes())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(length, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "d", "x"])

    src = vectors.select(vectors[key].cast("long").alias("id"), vectors[column].cast("array<double>").alias("e"))
    return map_batches(src, run, "id long, d int, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a column of equally long blobs as a matrix, without copying."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i8", count=len(column) * d, offset=int(off[0])).reshape(len(column), d)


def summed(rows: DataFrame, d: int, kind: str, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what ``add(matrix, into)`` adds up in an array of ``size`` numbers: one array a partition,
    then one a slot."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        into = np.zeros(size, kind)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                some = b.column(0).slice(a, 4096)
                add(_matrix(some, d), into)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([into.tobytes()], pa.binary())], names=["slot", "sum"])

    def merge(group: pa.Table) -> pa.Table:
        into = np.zeros(size, kind)
        for blob in group.column("sum"):
            into += np.frombuffer(blob.as_buffer(), kind)
        return pa.table({"sum": pa.array([into.tobytes()], pa.binary())})

    got = rows.select("x").mapInArrow(part, "slot int, sum binary").groupBy("slot").applyInArrow(merge, "sum binary").collect()  # at most SLOTS rows
    return sum((np.frombuffer(r["sum"], kind) for r in got), np.zeros(size, kind))


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """(n x - S) / n: the difference is taken in whole numbers where they are exact."""
    if n * int(np.abs(x).max()) < 2**62:
        return (n * x - total).astype(np.float64) / n
    return x - total.astype(np.float64) / n


def covariance_times(rows: DataFrame, d: int, n: int, total: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V q for the covariance V, in one pass."""

    def add(x: np.ndarray, into: np.ndarray) -> None:
        c = _centred(x, n, total)
        into += (c.T @ (c @ q)).ravel()

    return summed(rows, d, "f8", q.size, add).reshape(q.shape) / n


def components(rows: DataFrame, d: int, n: int, total: np.ndarray, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance."""
    wanted = min(wanted, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, wanted + OVERSAMPLE))))[0]
    passes = 0
    while True:
        if q.shape[1] == d:
            q = np.eye(d)
        y = covariance_times(rows, d, n, total, q)
        t = q.T @ y
        values, s = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(values)[::-1][:wanted]
        e, u = values[order], q @ s[:, order]
        worst = np.linalg.norm(y @ s[:, order] - u * e, axis=0).max()
        passes += 1
        if q.shape[1] == d or worst <= RESIDUAL * max(e[0], 0):
            return e, u / np.linalg.norm(u, axis=0)
        q = np.eye(d) if passes > POWER else np.linalg.qr(y)[0]


def _squares(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """sum of (n x - S)**2 of each row, exactly; null beyond the range of long."""
    most = n * int(np.abs(x).max()) + int(np.abs(total).max())
    if most < 2**62:
        diff = n * x - total
        if x.shape[1] * int(np.abs(diff).max()) ** 2 < 2**63:
            return (diff * diff).sum(axis=1).tolist()
    sums = [sum((n * a - b) ** 2 for a, b in zip(row, total.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in sums]


def _whiten(rows: DataFrame, d: int, wanted: int) -> DataFrame:
    def count(x: np.ndarray, into: np.ndarray) -> None:  # in two halves, so that no sum overflows
        into[0] += len(x)
        into[1 : d + 1] += (x >> 26).sum(axis=0)
        into[d + 1 :] += (x & (2**26 - 1)).sum(axis=0)

    first = summed(rows, d, "i8", 2 * d + 1, count).tolist()
    n, total = first[0], np.array([a * 2**26 + b for a, b in zip(first[1 : d + 1], first[d + 1 :], strict=True)], object)
    if np.abs(total).max() < 2**62:
        total = total.astype(np.int64)

    def spread(x: np.ndarray, into: np.ndarray) -> None:
        into += np.square(_centred(x, n, total)).sum()

    trace = float(summed(rows, d, "f8", 1, spread)[0]) / n
    e, u = components(rows, d, n, total, wanted) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    live = e > 1e-12 * trace
    e, u = e[live], u[:, live]
    k = len(e)
    weights = u / np.sqrt(e)

    def moments(x: np.ndarray, into: np.ndarray) -> None:
        w = _centred(x, n, total) @ weights
        into[: k * k] += (w.T @ w).ravel()
        into[k * k :] += w.sum(axis=0)

    error = 0.0
    if k:
        m = summed(rows, d, "f8", k * k + k, moments)
        mean = m[k * k :] / n
        error = float(np.abs(m[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = e / trace if k else e

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows if k else 0, 4096):
                ids, some = b.column(0).slice(a, 4096), b.column(1).slice(a, 4096)
                x = _matrix(some, d)
                w = _centred(x, n, total) @ weights
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(_squares(x, n, total), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, len(x)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.select("id", "x").mapInArrow(project, _OUT).withColumn("identity_error", F.lit(error))


def whiten(vectors: DataFrame, wanted: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (1 to ``wanted``), n, deviation, whitened, explained, identity_error of every usable vector."""
    spark: SparkSession = vectors.sparkSession
    rows = Scratch(spark, "whitening").save(prepare(vectors, key, column))
    lengths = sorted(r["d"] for r in rows.select("d").distinct().collect())  # one row a length of vectors
    parts = [_whiten(rows.where(F.col("d") == d), d, wanted) for d in lengths]
    if not parts:
        return spark.createDataFrame([], f"{_OUT}, identity_error double").withColumnRenamed("vec_id", key)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("vec_id", key)
