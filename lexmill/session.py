"""Session factory with the settings the operators are designed for."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def get_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting and partition coalescing; other settings as given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; where that is unset, a folder below
    the warehouse in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir')}/lexmill-checkpoint"
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder. Range partitions are dealt by a sample that
    differs from job to job, so whatever numbers them must see one dealing only, also when an executor is lost."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared folder: for what is large and read again and again."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/lexmill-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """df, settled, to be broadcast if it has at most so many rows, and joined by a shuffle if it has more."""
    kept = settled(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a scan of fewer splits than cores is dealt out anew before costly row-wise work; a large one,
    already in many, is left as it is, without a shuffle. Behind an exchange adaptive execution sizes the partitions,
    and asking for their number would run the stages before it, so such a df is left alone."""
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def give_back() -> None:
    """Returns what Python work has freed to the system: workers live on, and what they keep adds up over batches and tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)
