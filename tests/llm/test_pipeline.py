"""The pipeline against the same steps taken plainly, one document after another."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import BYTE_BPE, ODD, brute_groups, brute_runs

import corpus_pipeline
from lexmill.llm import language_id, line_dedup, packing, quality

SF = "/root/testdata/sf0.001"


def test_against_plain_steps(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    rows = [r for r, s in zip(rows, model.score(pa.array([r["text"] for r in rows])), strict=True) if s >= 0.3]
    kept = docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    told = language_id.fit(kept).predict(pa.array([r["text"] for r in rows]))
    rows = [r for r, n, s in zip(rows, *told, strict=True) if n != "und" and s >= 0.5]
    texts = brute_runs([(r["doc_id"], r["text"]) for r in rows], line_dedup.MIN_CHARS)
    stay = [i for i, _, c in brute_groups(list(texts.items())) if i == c]
    want = collections.Counter()
    t = packing.tokens(BYTE_BPE)
    for i in stay:
        ids = np.array(t.library.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert 0 < len(stay) < docs.count()


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, stage):
    """Nulls in any column, empty and long texts, repeats, an empty table and extra columns."""
    df = spark.createDataFrame([(i, t, "en" if i else None, None, None) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumn("k", F.lit(1)).withColumn("score", F.lit("x"))
    _, fn = corpus_pipeline.STAGES[stage]
    out = fn(spark, df, SF)
    if stage < 4:
        assert out.columns == df.columns and 0 < out.count() <= len(ODD)
    else:
        assert out.where("offset + length > 2048").count() == 0
    assert fn(spark, df.limit(0), SF).count() == 0


def test_rows_of_one_id_are_told_by_text(spark):
    """A text without a near duplicate stays even if another row of its id goes; of equal rows one stays."""
    a, b = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen")
    rows = [(5, a), (9, a), (9, b), (7, a), (7, "alone " * 9), (7, "alone " * 9), (3, ""), (3, ""), (None, b), (None, "no id but words of its own here"), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[3][1](spark, df, SF)
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == df.columns
    assert got == collections.Counter([(5, a), (9, b), (7, "alone " * 9), (3, ""), (3, ""), (None, "no id but words of its own here"), (4, None)])
