"""Every registered query against its oracle SQL, in another engine, on the smallest tables."""

import pytest
from conftest import SF, as_rows

import lexmill.registry as registry

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns, rows = oracle(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(columns)
    assert as_rows(df.columns, df.collect()) == as_rows(columns, rows)


def test_rows_only(spark):
    q = registry.queries()
    low, mid, high = q["bootstrap_auc"](spark, SF).first()
    assert 0.5 < low <= mid <= high <= 1
    assert q["weighted_draw"](spark, SF).count() == 1000
    assert q["file_manifest"](spark, SF).count() == 14
    p = q["platt_crossfit"](spark, SF)
    assert p.count() == q["confusion_matrix"](spark, SF).selectExpr("tn + fp + fn + tp").first()[0]
    for name in ("tfidf_lr_scores", "fusion_scores"):
        got = q[name](spark, SF).collect()
        assert got and all(0 < r["probability"] < 1 for r in got) and len({r["id"] for r in got}) == len(got)
    low, mid, high = q["bootstrap_auc_lineitem"](spark, SF).first()
    auc = q["ranking_unbounded"](spark, SF).agg({"roc_auc": "avg"}).first()[0]
    assert low < mid < high and abs(mid - auc) < 0.05
    windows = q["encoded_windows"](spark, SF).collect()
    assert len(windows) == p.count() and all(len(r["windows"]) == 3 and {len(w) for w in r["windows"]} == {256} and len(r["features"]) == 23 for r in windows)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tfidf_vectors_keep_every_term(spark):
    """One column a term: the weights are those of the long form, none merged."""
    from pyspark.sql import functions as F

    from lexmill.operators import features

    df = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(3000))), ("b", " ".join(f"w{i % 500}" for i in range(700))), ("c", "")], "id string, text string")
    got = {r["id"]: r["features"] for r in features.tfidf_vectors(df, df, features.word_ngrams).collect()}
    want = features.tfidf(df, features.word_ngrams(F.col("text"))).collect()
    assert all(v.size == len({r["term"] for r in want}) for v in got.values()) and got["c"].numNonzeros() == 0
    for key in "ab":
        assert sorted(round(float(x), 9) for x in got[key].values) == sorted(round(r["weight"], 9) for r in want if r["id"] == key)
    new = spark.createDataFrame([("n", "w1 w2 unseen")], "id string, text string")
    assert features.tfidf_vectors(df, new, features.word_ngrams).first()["features"].numNonzeros() == 3


@pytest.mark.parametrize("name", ["token_windows", "token_window_rows"])
def test_token_windows_of_odd_texts(spark, tmp_path, name):
    """Blank, empty and null texts have one window, and rows of one id are counted together."""
    import duckdb

    rows = [(i, t) for i, t in enumerate(["", " ", "\n \n", None, "a b", "a " * 17, "a " * 18, " a" * 16, "á\U0001f600 z", "\t\r\n"])] + [(4, "x"), (3, None), (0, ""), (None, "b c"), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, str(tmp_path))
    assert as_rows(df.columns, df.collect()) == as_rows([d[0] for d in want.description], want.fetchall())
