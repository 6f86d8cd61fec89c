"""Scans and sinks: role partitions, JSON lines, reports, predictions and file manifests."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.records import ROLES, SCHEMA


def read_partition(spark: SparkSession, base: str, role: str) -> DataFrame:
    """One non-sealed role; others are refused before any path is opened, and only this role's is."""
    if role not in ROLES:
        raise ValueError(f"role {role!r} may not be read; allowed: {ROLES}")
    return read_jsonl(spark, f"{base}/{role}.jsonl", SCHEMA)


def read_partitions(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {r: read_partition(spark, base, r) for r in ROLES}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, split at \\n only; blank lines are skipped, malformed ones are errors."""
    r = spark.read.option("lineSep", "\n").option("mode", "FAILFAST")
    return (r.schema(schema) if schema is not None else r).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("lineSep", "\n").option("ignoreNullFields", "false").json(path)


def write_roles(df: DataFrame, base: str, roles: list[str]) -> None:
    """One folder a role, empty ones too; refuses to overwrite."""
    for r in roles:
        write_jsonl(df.where(F.col("split") == r), f"{base}/{r}.jsonl")


def write_predictions(df: DataFrame, path: str) -> None:
    write_jsonl(df.select("id", "label", "probability"), path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "id string, label int, probability double")


def _file_system(path: str):
    """The JVM, the Hadoop file system of a path, and the path in it: local and remote bases alike."""
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    _, fs, where = _file_system(path)
    return fs.exists(where)


def names(path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    _, fs, where = _file_system(path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if not f.getPath().getName().startswith(".")) if fs.exists(where) else []


def remove(path: str) -> None:
    """Deletes a file or folder, if there is one."""
    _, fs, where = _file_system(path)
    fs.delete(where, True)


def write_json(value, path: str) -> None:
    """A report: sorted keys, indented, ending in a newline; written beside its place and put there at once."""
    jvm, fs, where = _file_system(path)
    fs.mkdirs(where.getParent())
    part = where.suffix(".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    over = SparkSession.active().sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(fs.makeQualified(part), fs.makeQualified(where), over)


def read_json(path: str):
    jvm, fs, where = _file_system(path)
    stream = fs.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _streamed_sha256(path: str, piece: int = 1 << 20) -> str:
    """SHA-256 of one file, ``piece`` bytes at a time, where pyarrow opens its file system."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    h = hashlib.sha256()
    with store.open_input_stream(name) as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()


def file_manifest(spark: SparkSession, folder: str, large: int = 1 << 28) -> DataFrame:
    """path (relative), sha256, bytes of every file below a folder, hashed where the file is read. Files of under ``large`` bytes are
    hashed as they are scanned; larger ones, which no row could hold, by tasks that stream them in pieces of 1 MiB,
    the longest dealt out first. Those need a file system that pyarrow opens as well. A scan passes over empty files, so these are told by its
    list of names."""
    from urllib.parse import unquote

    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    at = root.split(":", 1)[-1].lstrip("/")
    relative = F.expr("substring(path, instr(path, '{0}') + {1})".format(at.replace("'", "''"), len(at))).alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = files.where(F.col("length") < large).select(relative, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    named = [(re.sub(r"^(\w+):/+(?=[^/])", r"\1:/", unquote(f)) if f.startswith("file:") else unquote(f),) for f in files.inputFiles()]
    empty = spark.createDataFrame(named, "path string").join(files.select("path"), "path", "left_anti")
    small = small.unionByName(empty.select(relative, F.lit(hashlib.sha256().hexdigest()).alias("sha256"), F.lit(0).cast("long").alias("bytes")))
    big = sorted(((r["length"], r["path"]) for r in files.where(F.col("length") >= large).select("path", "length").collect()), reverse=True)  # names, not contents
    if not big:
        return small
    tasks = min(len(big), max(1, 4 * spark.sparkContext.defaultParallelism))

    def run(batch: pa.Table) -> pa.Table:
        paths = batch.column("path").to_pylist()
        return pa.table({"path": pa.array(paths, pa.string()), "sha256": pa.array([_streamed_sha256(p) for p in paths], pa.string()), "bytes": batch.column("bytes")})

    dealt = spark.createDataFrame([(p, n, i % tasks) for i, (n, p) in enumerate(big)], "path string, bytes long, _turn int")
    return small.unionByName(dealt.groupBy("_turn").applyInArrow(run, "path string, sha256 string, bytes long").select(relative, "sha256", "bytes"))
