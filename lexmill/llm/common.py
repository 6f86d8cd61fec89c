"""Shared plumbing of the large-corpus operators: scratch tables, ordering, packing of arrays.

Nothing here keeps state on a machine-local disk: intermediate results that must survive a lost
executor are written as Parquet below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a folder below the warehouse in local mode, which one
    machine alone can read; on a cluster, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir')}/lexmill-checkpoint"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables made by save() that no later result reads."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            for f in df.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_mod(col: str | Column, n: int) -> Column:
    return F.pmod(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(n))


def give_back() -> None:
    """Returns what a finished task has freed to the system: workers live on, and what they kept would add up over tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow over pandas-free batches: fn(pa.RecordBatch) -> pa.RecordBatch | pa.Table | None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        give_back()

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, column: str, fn, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """All columns of df and new ones: fn(pa.Array of ``column``) -> arrays. One narrow pass."""
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in fields)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *fn(batch.column(at))], names=[*batch.schema.names, *(n for n, _ in fields)])

    return map_batches(df, run, schema)


def global_order(df: DataFrame, by: list[str], scratch: Scratch, weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (0, 1, ... in the order of ``by``) and, given ``weight``, ``before`` (its running sum
    over all earlier rows).

    Range partitions are sorted and numbered on their own; only one (rows, sum) pair a partition
    reaches the driver. No single task sees the whole order, however often a key repeats.
    """
    cols = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_idx", T.LongType()), T.StructField("_cum", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, idx, cum = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            w = b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.zeros(n, np.int64)
            run = np.cumsum(w)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(idx, idx + n)), pa.array(cum + run - w)],
                names=[*b.schema.names, "_pid", "_idx", "_cum"],
            )
            idx, cum = idx + n, cum + int(run[-1]) if n else cum

    local = scratch.save(df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).mapInArrow(number, schema))
    last = F.col("_cum") + (F.col(weight).cast("long") if weight else F.lit(0))
    totals = sorted(local.groupBy("_pid").agg(F.count("*").alias("n"), F.max(last).alias("s")).collect())
    offsets, rows, total = [], 0, 0
    for pid, n, s in totals:
        offsets.append((pid, rows, total))
        rows, total = rows + n, total + s
    table = local.sparkSession.createDataFrame(offsets or [(-1, 0, 0)], "_pid int, _r0 long, _c0 long")
    out = local.join(F.broadcast(table), "_pid")  # one row a partition
    return out.select(*cols, (F.col("_r0") + F.col("_idx")).alias("rank"), *([(F.col("_c0") + F.col("_cum")).alias("before")] if weight else []))


def group_order(df: DataFrame, key: str, by: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``at`` (0, 1, ... within the value of ``key``, which is not null, in the order of ``by``, nulls first) and ``total``
    (rows of that value). Range partitions are sorted and numbered on their own; then the places of a key's parts follow
    from one row for each key and partition. No task sees all rows of a key."""
    local = scratch.save(df.repartitionByRange(key, *by).sortWithinPartitions(key, *by).withColumn("_m", F.monotonically_increasing_id()))
    local = local.withColumn("_pid", F.shiftright("_m", 33))
    parts = local.groupBy(key, "_pid").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("_start", before).withColumn("total", F.sum("_n").over(whole)).drop("_n")
    return local.join(starts, [key, "_pid"]).withColumn("at", F.col("_start") + F.col("_m") - F.col("_first")).drop("_m", "_pid", "_first", "_start")


# --- text as numpy arrays -------------------------------------------------------------------------

_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("p", ())) < n:
        m = max(n, 1 << 16)
        for key, base in (("p", BASE), ("i", BASE_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows (null as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, rows: int = 512, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of at most ``rows`` rows and ``size`` bytes of text, one row at least: bounds
    what is worked on at once, whatever the batch."""
    _, off = text_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, min(a + rows, int(np.searchsorted(off, off[a] + size, side="right")) - 1))
        yield a, b - a
        a = b


def binary_list(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts in order, and each word's text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[off] = True
    start = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | border[:-1]))
    end = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | border[1:])) + 1
    p, inv = powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[raw] if lower else raw] * p[: len(raw)], out=run[1:])
    h = mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(off, start, side="right") - 1
