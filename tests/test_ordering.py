"""Places, trees and draws against plain loops: nothing depends on partitions, and nothing is lost in cells."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate, ordering, records, sampling


def auc(y, p):
    pos, neg = p[y == 1], np.sort(p[y == 0])
    return (np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()) / 2 / len(pos) / len(neg)


def scored(spark, n=1500, scale=100.0, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round((rng.normal(size=n) + 0.5 * y) * scale, 3)
    return y, p, spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "id long, label int, p double")


def test_ranks(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([(None, 3), (None, None), ("a", 2), ("a", 1), ("a", 2), ("b", 0)])]
    df = spark.createDataFrame(rows, "g string, v int, i long")
    for parts in (1, 3):
        got = {r["i"]: (r["rank"], r["total"]) for r in ordering.ranked(df.repartition(parts), ["g"], [F.asc("v"), F.asc("i")]).collect()}
        assert got == {1: (0, 2), 0: (1, 2), 3: (0, 3), 2: (1, 3), 4: (2, 3), 5: (0, 1)}
    assert ordering.ranked(df.limit(0), [], [F.asc("v")]).count() == 0


def test_hash_tree_at_any_partitioning(spark):
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) id", "map('b', id, 'a', -id) m", "named_struct('z', id, 'a', array(id, null)) s", "if(id % 3 = 0, null, 'x') n")
    roots = {records.table_digest(df.repartition(k), ["id"]) for k in (1, 4, 64)}
    assert len(roots) == 1
    assert roots == {records.table_digest(df.select("s", "n", "id", F.map_from_entries(F.reverse(F.map_entries("m"))).alias("m")), ["id"])}
    assert roots != {records.table_digest(df.where("id <> '5'"), ["id"])} and records.table_digest(df.limit(0), ["id"]) == hashlib.sha256().hexdigest()
    few = spark.createDataFrame([("b", 2, None), ("a", 1, "é")], "id string, n int, t string")
    leaf = lambda r: hashlib.sha256(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    leaves = [leaf({"id": "a", "n": 1, "t": "é"}), leaf({"id": "b", "n": 2, "t": None})]
    assert records.table_digest(few, ["id"]) == hashlib.sha256("".join(leaves).encode()).hexdigest()
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(10)]
    nodes = spark.createDataFrame(list(enumerate(h)), "i int, d string").repartition(3)
    while len(h) > 1:
        h = [hashlib.sha256("".join(h[a : a + 3]).encode()).hexdigest() for a in range(0, len(h), 3)]
    assert ordering.hash_tree(nodes, [F.col("i")], F.col("d"), fan=3) == h[0]


@pytest.mark.parametrize("scale", [1e6, 1e-9])
def test_ranking_of_unbounded_and_bunched_scores(spark, scale, monkeypatch):
    """Negative and huge scores, and scores that all lie within a billionth; no cell of a group is much over its share."""
    y, p, df = scored(spark, scale=scale)
    frame = evaluate.cumulative(df.repartition(3).withColumn("z", F.lit(1)), ["z"])
    assert evaluate.ranking(frame, ["z"]).first()["roc_auc"] == pytest.approx(auc(y, p), abs=1e-12)
    cells = [r["count"] for r in ordering.ranged(evaluate.score_counts(df, [], "label", "p"), [], [F.desc("score")]).groupBy("_cell").count().collect()]
    if scale > 1:
        assert len(cells) == 1 or max(cells) <= 3 * sum(cells) / len(cells)


def test_thresholds_over_negative_scores(spark):
    for top in (-1.0, -0.75, -3e-310, 0.0, 5.0):
        df = spark.createDataFrame([(0, top), (1, top - 1)], "label int, p double")
        got = evaluate.best_thresholds(df, [0.0]).first()
        assert got["threshold"] == np.nextafter(top, np.inf) and got["recall"] == 0


def test_bootstrap_tree(spark, monkeypatch):
    """Cells of few scores and a tree of several levels give the interval of plain resampling."""
    y, p, df = scored(spark, 600)
    rng = np.random.default_rng(5)
    plain = []
    for _ in range(1500):
        a, b = rng.choice(p[y == 1], (y == 1).sum()), rng.choice(p[y == 0], (y == 0).sum())
        plain.append(auc(np.r_[np.ones(len(a)), np.zeros(len(b))], np.r_[a, b]))
    monkeypatch.setattr(ordering, "FAN", 6)
    runs = np.array([r["auc"] for r in evaluate.bootstrap_runs(df, 300, 3, cell=16).collect()])
    assert len(runs) == 300
    assert runs.mean() == pytest.approx(np.mean(plain), abs=5 * np.std(plain) / 300**0.5) and runs.std() == pytest.approx(np.std(plain), rel=0.2)
    again = evaluate.bootstrap_runs(df.repartition(5), 300, 3, cell=16).collect()
    assert sorted(r["auc"] for r in again) == pytest.approx(sorted(runs))
    low, mid, high = evaluate.bootstrap_auc(df, 300, 4).first()
    assert [low, mid, high] == pytest.approx(np.percentile(plain, [2.5, 50, 97.5]), abs=0.012)
    assert evaluate.bootstrap_auc(df.where("label = 1"), 10, 1).first()["median"] is None


def test_split_draws_are_exact_multinomials(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FAN", 4)
    w = [0.0, 1.0, 2.0, 3.0, 0.0, 4.0, 5.0, 1.0, 1.0, 1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 80.0]
    nodes = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(w)], "_node long, w double, one double")
    got = ordering.split_draws(nodes, ["w", "one"], [50, 7], 400, 1).toPandas()
    assert (got.groupby("_run")[["w", "one"]].sum() == [50, 7]).all().all() and got["_run"].nunique() == 400
    share = got.groupby("_node")["w"].sum().reindex(range(len(w)), fill_value=0) / (50 * 400)
    assert (share[[i for i, x in enumerate(w) if not x]] == 0).all()
    assert np.abs(share - np.array(w) / sum(w)).max() < 0.012
    spread = got[got["_node"] == 17].set_index("_run")["w"].reindex(range(400), fill_value=0).var()
    assert spread == pytest.approx(50 * 0.8 * 0.2, rel=0.3)


def test_weighted_draw(spark):
    """Exactly n draws; their counts pass a chi-square test; rows without weight are never drawn."""
    df = spark.range(400).selectExpr("id", "case when id % 10 = 0 then null when id % 10 = 1 then -1.0 else cast(id % 10 as double) end weight")
    got = sampling.weighted_draw(df, 20_000, 3, cell=32).toPandas()
    assert len(got) == 20_000 and sorted(got["draw"]) == list(range(20_000))
    counts = got.groupby("id").size()
    want = {i: 20_000 * (i % 10) / (40 * sum(range(2, 10))) for i in range(400) if i % 10 > 1}
    assert set(counts.index) <= set(want)
    chi = sum((counts.get(i, 0) - e) ** 2 / e for i, e in want.items())
    assert abs(chi - len(want) + 1) < 5 * (2 * len(want)) ** 0.5
    other = sampling.weighted_draw(df.repartition(7), 20_000, 3, cell=32).toPandas()
    assert other.sort_values("draw")["id"].tolist() == got.sort_values("draw")["id"].tolist()
    assert sampling.weighted_draw(df.where("id % 10 < 2"), 5, 1).count() == 0
    one = sampling.weighted_draw(df.where("id in (5, 399)").withColumn("weight", F.when(F.col("id") == 5, 1e-300).otherwise(1e300)), 50, 1)
    assert {r["id"] for r in one.collect()} == {399}
    with pytest.raises(ValueError):
        sampling.weighted_draw(df.withColumn("weight", F.lit(float("inf"))), 5, 1)
