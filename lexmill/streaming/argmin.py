"""Single-pass streams: one best row a key, kept in versioned Parquet, and progress.

The state of a stream is a folder: the best rows of each micro-batch in a folder of its own, and a current.json that
lists those that count, with the last batch merged and the revision of the source. A batch writes its rows first and
then replaces current.json at once, so a run that is killed leaves the state before or after the batch, never between; when
the batch comes again it is written anew, or skipped if it counts already. Every COMPACT batches they are merged into one. The
table is the best row of each key over the folders that count; nothing of it is held by the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import files

COMPACT = 8


def best_rows(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The least row of each key, on batches and streams alike (complete or update mode): state is one row a key."""
    best = F.min_by(F.struct(*[F.col(c) for c in columns]), order).alias("best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"best.{c}").alias(c) for c in columns])


def source_revision(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """Digest of the files of a folder (or a file): their names, lengths and times of change. No file is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return hashlib.sha256(repr(sorted((r["path"].rpartition("/")[2], r["length"], r["modificationTime"]) for r in found.select("path", "length", "modificationTime").collect())).encode()).hexdigest()


class BestRowStore:
    """The least row of each key over all rows merged so far, in the folder ``base``."""

    def __init__(self, spark: SparkSession, base: str, by: list[str], order: Column, columns: list[str], revision: str | None = None):
        self.spark, self.base, self.by, self.order, self.columns, self.revision = spark, base.rstrip("/"), by, order, columns, revision
        kept = self.current()
        if kept["revision"] != revision and kept["parts"]:
            raise ValueError(f"the state was made from revision {kept['revision']}, not {revision}")

    def current(self) -> dict:
        path = f"{self.base}/current.json"
        return files.read_json(path) if files.exists(path) else {"batch": -1, "parts": [], "revision": self.revision}

    def _union(self, parts: list[str]) -> DataFrame:
        return best_rows(self.spark.read.parquet(*[f"{self.base}/{p}" for p in parts]), self.by, self.order, self.columns)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch. Keys and order columns of ``rows`` as in ``by`` and ``order``."""
        kept = self.current()
        if batch <= kept["batch"]:
            return
        name = f"batch-{batch:012d}"
        best_rows(rows, self.by, self.order, self.columns).write.mode("overwrite").parquet(f"{self.base}/{name}")
        parts = [*kept["parts"], name]
        if len(parts) > COMPACT:
            merged = f"merged-{batch:012d}"
            self._union(parts).write.mode("overwrite").parquet(f"{self.base}/{merged}")
            parts = [merged]
        files.write_json({"batch": batch, "parts": parts, "revision": self.revision}, f"{self.base}/current.json")
        for old in {*kept["parts"], name} - set(parts):
            files.remove(f"{self.base}/{old}")

    def table(self) -> DataFrame | None:
        parts = self.current()["parts"]
        return self._union(parts) if parts else None

    def run(self, stream: DataFrame) -> DataFrame | None:
        """Merges what the stream holds now that was not merged before; the table (none before the first rows)."""
        q = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.table()


class Progress(StreamingQueryListener):
    """Calls ``tell`` each time another ``every`` rows have been read."""

    def __init__(self, every: int = 100_000, tell=print):
        self.every, self.tell, self.rows = every, tell, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        before, self.rows = self.rows, self.rows + event.progress.numInputRows
        if self.rows // self.every > before // self.every:
            self.tell(f"{self.rows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
