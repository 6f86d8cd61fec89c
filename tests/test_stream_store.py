"""The store of best rows: equal to a batch, whatever is killed and started again."""

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.streaming import argmin

BY, ORDER, COLUMNS = ["k"], "struct(v, id)", ["id", "v"]


def _write(spark, folder, start, n):
    spark.range(start, start + n).selectExpr("id", "id % 7 as k", "(id * 7919 % 101) as v").coalesce(1).write.mode("append").parquet(folder)


def _rows(df):
    return sorted(tuple(r) for r in df.select("k", "id", "v").collect())


def _stream(spark, folder):
    return spark.readStream.schema("id long, k long, v long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_equals_the_batch_after_kills_and_restarts(spark, tmp_path, monkeypatch):
    source, base = str(tmp_path / "in"), str(tmp_path / "store")
    for i in range(5):
        _write(spark, source, i * 40, 40)
    monkeypatch.setattr(argmin, "COMPACT", 3)
    store = argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, "r1")
    assert store.table() is None
    inner, calls = files.write_json, []

    def killed(value, path):
        calls.append(path)
        if len(calls) in (2, 4):  # after a batch's rows are written, before they count
            raise RuntimeError("killed")
        inner(value, path)

    monkeypatch.setattr(files, "write_json", killed)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, "r1").run(_stream(spark, source))
    whole = argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, "r1")
    want = _rows(argmin.best_rows(spark.read.parquet(source), BY, F.expr(ORDER), COLUMNS))
    assert _rows(whole.run(_stream(spark, source))) == want
    kept = whole.current()
    assert kept["batch"] == 4 and len(kept["parts"]) <= 4 and set(files.names(base)) - {"checkpoint", "current.json"} == set(kept["parts"])
    assert _rows(whole.run(_stream(spark, source))) == want and whole.current() == kept  # nothing new
    whole.merge(spark.range(1).selectExpr("cast(0 as long) id", "cast(0 as long) k", "cast(-5 as long) v"), 3)  # an old batch comes again
    assert whole.current() == kept
    _write(spark, source, 200, 30)
    assert _rows(whole.run(_stream(spark, source))) == _rows(argmin.best_rows(spark.read.parquet(source), BY, F.expr(ORDER), COLUMNS))


def test_revision_is_pinned(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "store")
    _write(spark, source, 0, 10)
    revision = argmin.source_revision(spark, source)
    assert revision == argmin.source_revision(spark, source)
    argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, revision).run(_stream(spark, source))
    _write(spark, source, 10, 10)
    changed = argmin.source_revision(spark, source)
    assert changed != revision
    with pytest.raises(ValueError, match="revision"):
        argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, changed)
    assert argmin.BestRowStore(spark, base, BY, F.expr(ORDER), COLUMNS, revision).table().count() == 7
