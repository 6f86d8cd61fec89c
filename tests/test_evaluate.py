"""Metrics, thresholds and calibration against direct formulas."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.functions import numeric
from lexmill.operators import calibrate, evaluate

ROWS = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows):
    return spark.createDataFrame([(y, s / 20) for y, s in rows], "label int, p double")


@QUICK
@given(rows=ROWS)
def test_auc_and_ap(spark, rows):
    m = evaluate.binary_metrics(frame(spark, rows)).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        assert m["roc_auc"] is None and m["pr_auc"] is None
        return
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert m["roc_auc"] == pytest.approx(auc)
    ap = 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(s >= t for s in pos)
        ap += sum(s == t for s in pos) / len(pos) * tp / (tp + sum(s >= t for s in neg))
    assert m["pr_auc"] == pytest.approx(ap)


@QUICK
@given(rows=ROWS, cap=st.sampled_from([0.0, 0.1, 0.5]))
def test_threshold(spark, rows, cap):
    got = evaluate.best_thresholds(frame(spark, rows), [cap]).first()
    pos, neg = [s / 20 for y, s in rows if y], [s / 20 for y, s in rows if not y]
    top = max(s / 20 for _, s in rows)
    best = None
    for t in {s / 20 for _, s in rows} | {math.nextafter(top, math.inf)}:
        fpr = sum(s >= t for s in neg) / len(neg) if neg else 0.0
        recall = sum(s >= t for s in pos) / len(pos) if pos else 0.0
        if fpr <= cap:
            best = max(best or (-1, 0, 0), (recall, -fpr, -t))
    assert (got["recall"], -got["fpr"], -got["threshold"]) == pytest.approx(best)


def test_fixed_points(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.7), (1, 0.9)], "label int, p double")
    m = evaluate.binary_metrics(df).first()
    assert (m["roc_auc"], m["pr_auc"], m["human_fpr"], m["tpr_at_1pct_fpr"]) == (1.0, 1.0, 0.0, 1.0)
    df = spark.createDataFrame([(0, 0.1), (1, 0.6), (0, 0.7), (1, 0.9)], "label int, p double")
    assert evaluate.best_thresholds(df, [0.0]).first()["threshold"] == 0.9
    df = spark.createDataFrame([(0, 0.9), (1, 0.2)], "label int, p double")
    assert evaluate.best_thresholds(df, [0.0]).first()["threshold"] == math.nextafter(0.9, math.inf)
    one = evaluate.binary_metrics(spark.createDataFrame([(1, 0.2)], "label int, p double")).first()
    assert one["roc_auc"] is None and one["human_fpr"] is None and one["precision"] == 0


def test_metrics_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("cast(id % 3 = 0 as int) label", "round((id * 37 % 101) / 101, 2) p", "id % 4 s")
    a = sorted(evaluate.binary_metrics(df, ["s"]).collect())
    b = sorted(evaluate.binary_metrics(df.repartition(7), ["s"]).collect())
    assert [[pytest.approx(x) for x in r] for r in a] == [list(r) for r in b]


def test_platt_and_folds(spark):
    rows = [(f"g{i % 3}", i % 2, 0.2 + 0.1 * (i % 5) + 0.2 * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "lineage_id string, label int, p double")
    slope, intercept = calibrate.fit_platt(df)
    x, y = [math.log(p / (1 - p)) for _, _, p in rows], [r[1] for r in rows]
    a = b = 0.0
    for _ in range(60):  # Newton's method on the same objective
        q = [1 / (1 + math.exp(-(a * v + b))) for v in x]
        ga, gb = sum((u - t) * v for u, t, v in zip(q, y, x, strict=True)) + 1e-6 * a, sum(u - t for u, t in zip(q, y, strict=True))
        haa, hab, hbb = sum(u * (1 - u) * v * v for u, v in zip(q, x, strict=True)) + 1e-6, sum(u * (1 - u) * v for u, v in zip(q, x, strict=True)), sum(u * (1 - u) for u in q)
        d = haa * hbb - hab * hab
        a, b = a - (ga * hbb - gb * hab) / d, b - (gb * haa - ga * hab) / d
    assert slope == pytest.approx(a, rel=1e-3) and intercept == pytest.approx(b, rel=1e-3, abs=1e-3)
    out = calibrate.crossfit_platt(df, 5)
    assert out.select("fold").distinct().count() == 3 and out.count() == 30
    with pytest.raises(ValueError):
        calibrate.crossfit_platt(df.where("lineage_id = 'g0'"))


def test_checked_join(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "id string, label int")
    good = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.1)], "id string, label int, probability double")
    assert calibrate.checked_join(good, rows).count() == 2
    for bad in ([("a", 0, 0.1)], [("a", 1, 0.1), ("b", 1, 0.5)], [("a", 0, 1.5), ("b", 1, 0.5)]):
        with pytest.raises(ValueError):
            calibrate.checked_join(spark.createDataFrame(bad, "id string, label int, probability double"), rows)


def test_what_checked_join_refuses(spark):
    """Repeated ids on either side, null labels, null ids, probabilities that are null or no number."""
    make = lambda rows: spark.createDataFrame(rows, "id string, label int, probability double")
    plain = [("a", 0, 0.1), ("b", 1, 0.5)]
    for left, right, told in (
        ([("a", 0, 0.1), ("a", 0, 0.1), ("b", None, 0.5)], plain, {("a", "repeated"), ("b", "label")}),
        (plain, [("a", 0, 0.1), ("b", 1, 0.5), ("b", 1, 0.5)], {("b", "repeated")}),
        ([("a", 0, 0.1), ("b", None, 0.5)], [("a", 0, 0.1), ("b", None, 0.5)], {("b", "label")}),
        ([("a", 0, 0.1), (None, 1, 0.5)], [("a", 0, 0.1), (None, 1, 0.5)], {(None, "missing"), (None, "foreign")}),
    ):
        rows = make(left).drop("probability")
        assert {tuple(r) for r in calibrate.join_problems(make(right), rows).collect()} == told
        with pytest.raises(ValueError):
            calibrate.checked_join(make(right), rows)
    for p in (None, float("nan"), -0.1):
        with pytest.raises(ValueError):
            calibrate.checked_join(make([("a", 0, p), ("b", 1, 0.5)]), make(plain).drop("probability"))


def test_positives_without_provenance_are_of_no_subtype(spark):
    df = spark.createDataFrame([(0, None, 0.1), (0, "x", 0.2), (1, "raw", 0.9), (1, None, 0.8)], "label int, provenance string, p double")
    assert sorted(tuple(r) for r in evaluate.subtype_frame(df).select("subtype", "label", "p").collect()) == [("raw", 0, 0.1), ("raw", 0, 0.2), ("raw", 1, 0.9)]


def test_all_folds_in_the_same_passes(spark):
    """Each fold's scaler is the Newton solution on the others; separable scores end too."""
    rng = __import__("random").Random(4)
    rows = [(f"g{i % 7}", int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(200)]
    rows = [(g, y, min(1.0, p + 0.2 * y)) for g, y, p in rows]
    out = calibrate.crossfit_platt(spark.createDataFrame(rows, "lineage_id string, label int, p double"), 4).collect()
    assert len(out) == 200
    for fold in range(4):
        held = {r["lineage_id"] for r in out if r["fold"] == fold}
        kept = spark.createDataFrame([r for r in rows if r[0] not in held], "lineage_id string, label int, p double")
        slope, intercept = calibrate.fit_platt(kept)
        for r in out:
            if r["fold"] == fold:
                x = min(max(r["p"], 1e-6), 1 - 1e-6)
                assert r["calibrated"] == pytest.approx(1 / (1 + math.exp(-(slope * math.log(x / (1 - x)) + intercept))), abs=1e-9)
    apart = spark.createDataFrame([(f"g{i}", i % 2, 0.9 if i % 2 else 0.1) for i in range(8)], "lineage_id string, label int, p double")
    assert calibrate.fit_platt(apart)[0] > 1


def test_windows(spark):
    f = lambda n: spark.range(1).selectExpr(f"transform(sequence(1, {n}), x -> cast(x as int)) i").select(numeric.pad_windows(__import__("pyspark").sql.functions.col("i"), 4).alias("w")).first()["w"]
    assert f(12) == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]
    assert f(2) == [[1, 2, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert numeric.warmup_cosine(0, 100, 10) == pytest.approx(0.1) and numeric.warmup_cosine(100, 100, 10) == pytest.approx(0)


def test_null_keys_are_groups(spark):
    """Rows whose source or label is null lose neither their metrics, nor their weights, nor their split."""
    from lexmill.operators import evaluate, sampling

    rows = [(f"r{i}", s, y, (i * 7 % 10) / 10) for i, (s, y) in enumerate([("a", 0), ("a", 1), ("a", 1), (None, 0), (None, 1), (None, 0), (None, 1)])]
    df = spark.createDataFrame(rows, "id string, source string, label int, p double")
    got = {r["source"]: r for r in evaluate.binary_metrics(df, ["source"]).collect()}
    assert set(got) == {"a", None} and got[None]["n"] == 4
    assert got[None]["roc_auc"] == 0.75  # .1 and .5 against .8 and .2: all pairs in order but (.5, .2)
    weights = {r["id"]: r["weight"] for r in sampling.source_label_weights(df).collect()}
    assert weights == {"r0": 1.0, "r1": 0.5, "r2": 0.5, "r3": 0.5, "r4": 0.5, "r5": 0.5, "r6": 0.5}
    odd = df.withColumn("label", F.when(F.col("id") != "r6", F.col("label")))
    assert sampling.stratified_split(odd, 1).count() == sampling.group_split(odd, 1, "source").count() == len(rows)
    mass = sampling.hierarchical_weights(df, {"x": 1.0}, F.lit("x"), "source").collect()
    assert len(mass) == len(rows) and abs(sum(r["weight"] for r in mass) - 1) < 1e-12


def test_group_folds_are_greedy(spark):
    """Against the plain loop: descending size, ties by descending name, each group to the lightest fold."""
    import random

    rng = random.Random(3)
    sizes = {f"g{i:03}": rng.choice([1, 1, 1, 2, 2, 3, 5, 9]) for i in range(90)} | {None: 2}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    load, want = [0] * 4, {}
    for g, n in sorted(sizes.items(), key=lambda x: (x[1], x[0] is not None, x[0] or ""), reverse=True):
        want[g] = load.index(min(load))
        load[want[g]] += n
    got = calibrate.group_folds(df, 4, "g", chunk=7).collect()
    assert len(got) == len(want) and {r["g"]: r["fold"] for r in got} == want
    assert calibrate.group_folds(df.limit(0), 4, "g").count() == 0
