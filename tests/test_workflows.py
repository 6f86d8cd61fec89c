"""Assemblies, input checks, saved models, token windows and the feature cache."""

import json

import pytest
from pyspark.sql import functions as F
from test_records_audit import rec

from lexmill.functions.stylometry import NAMES
from lexmill.operators import audit, evaluate, features, models, records, sampling
from lexmill.plans import workflows
from lexmill.sources import files
from lexmill.streaming.argmin import Progress


def corpus(spark, n=120):
    rng = __import__("random").Random(3)
    rows = []
    for i in range(n):
        y = i % 2
        words = " ".join(rng.choice(["Rain!", "walk", "we", "said."] if y == 0 else ["moreover,", "delve", "tapestry", "intricate"]) for _ in range(14))
        kind = "human" if y == 0 else ["raw_ai", "expert_edited_ai", "llm_edited_ai"][i % 3]
        rows.append({"id": f"b{i}", "lineage_id": f"g{i}", "text": f"{words} number{i}", "label": y, "provenance": kind, "source": f"s{i % 2}", "split": ["train", "development", "calibration"][i * 3 // n]})
    return rec(spark, *rows)


def test_subtype_report(spark):
    rows = [("human", 0, 0.1), ("human", 0, 0.2), ("human", 0, 0.9), ("raw_ai", 1, 0.95), ("raw_ai", 1, 0.3), ("edit", 1, 0.15), (None, 1, 0.5)]
    df = spark.createDataFrame(rows, "provenance string, label int, p double")
    got = {r["subtype"]: r for r in evaluate.subtype_report(df, ["raw_ai", "edit"]).collect()}
    assert got["raw_ai"]["n"] == 5 and got["raw_ai"]["tpr_at_cap"] == 0.5 and got["raw_ai"]["false_positives"] == 0
    assert got["edit"]["tpr_at_cap"] == 0 and got["edit"]["threshold"] > 0.9
    with pytest.raises(ValueError, match="none"):
        evaluate.subtype_report(df, ["raw_ai", "none"])
    made = spark.createDataFrame([("raw_ai", 0.9, 0.8), ("edit", 0.5, 0.4), ("other", 0.7, 0.6)], "subtype string, roc_auc double, partial_auc double")
    assert evaluate.selection_metrics(made, ["edit", "other"]).first() == pytest.approx((0.6, 0.5))


def test_token_windows_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", "one two", "Ünïcode <|endoftext|> 漢字", "word " * 40, None]
    df = spark.createDataFrame([(str(i), x, i % 2) for i, x in enumerate(texts)], "id string, text string, label int")
    stats = spark.createDataFrame([(n, 1.0, 2.0) for n in NAMES], "feature string, mean double, scale double")
    style = {r["id"]: r for r in features.stylometric_features(df).collect()}
    got = {r["id"]: r for r in features.encoded_windows(df, path, 8, stats).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        starts = sorted({0, max(0, len(ids) - 8) // 2, max(0, len(ids) - 8)})
        want = [(ids[s : s + 8] + [0] * 8)[:8] for s in starts]
        assert got[str(i)]["windows"] == (want + [[0] * 8] * 3)[:3] and got[str(i)]["label"] == i % 2
        if x is not None:
            assert got[str(i)]["features"] == pytest.approx([(style[str(i)][n] - 1) / 2 for n in NAMES])


def test_feature_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = spark.createDataFrame([("a", "One two."), ("b", "Three!"), ("b", "Three!"), (None, None)], "id string, text string")
    flat = lambda d: sorted((tuple(r) for r in d.select("id", *NAMES).collect()), key=repr)
    first = features.cached_features(df, path)
    assert flat(first) == flat(features.stylometric_features(df)) and spark.read.option("recursiveFileLookup", True).parquet(f"{path}/rows").count() == 3
    more = df.unionByName(spark.createDataFrame([("a", "another text")], "id string, text string"))
    assert flat(features.cached_features(more, path)) == flat(features.stylometric_features(more)) and spark.read.option("recursiveFileLookup", True).parquet(f"{path}/rows").count() == 4
    assert flat(features.cached_features(more, path)) == flat(features.stylometric_features(more)) and len(files.names(f"{path}/commits")) == 2
    assert features.cached_features(df.limit(0), str(tmp_path / "empty")).count() == 0


def test_two_writers_of_one_cache(spark, tmp_path):
    """Both start before either commits: all rows are written twice, and read once."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(f"k{i}", f"Text number {i}. Again!") for i in range(50)], "id string, text string")
    met, inner = Barrier(2), features._snapshot
    seen = []

    def together(p):
        commits = inner(p)
        if len(seen) < 2:
            seen.append(1)
            met.wait(60)
        return commits

    features._snapshot = together
    try:
        with ThreadPoolExecutor(2) as pool:
            done = list(pool.map(lambda _: features.cached_features(df, path), range(2)))
    finally:
        features._snapshot = inner
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{path}/rows").count() == 100 and len(inner(path)) == 2
    want = sorted(tuple(r) for r in features.stylometric_features(df).select("id", *NAMES).collect())
    for frame in (*done, features.cached_features(df, path)):
        assert sorted(tuple(r) for r in frame.select("id", *NAMES).collect()) == want
    assert len(inner(path)) == 2
    left = spark.createDataFrame([("k1", "Text number 1. Again!")], "id string, text string")
    left.selectExpr("'half' _mark").write.parquet(f"{path}/rows/killed")  # a writer that never committed
    assert features.cached_features(left, path).count() == 1


def test_inputs_and_runs(spark, tmp_path):
    base, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = corpus(spark)
    mix, kinds = {"human": 0.5, "raw_ai": 0.2, "expert_edited_ai": 0.2, "llm_edited_ai": 0.1}, ["raw_ai", "expert_edited_ai", "llm_edited_ai"]
    with pytest.raises(FileNotFoundError):
        workflows.check_inputs(spark, base, out, mix, F.col("provenance"), kinds)
    files.write_roles(df, base, records.ROLES)
    got = workflows.check_inputs(spark, base, out, mix, F.col("provenance"), kinds)
    assert got["partition_counts"] == dict.fromkeys(records.ROLES, 40) and got["train_weight"] == pytest.approx(1)
    assert all(len(h) == 64 for role in got["partition_sha256"].values() for h in role.values())
    with pytest.raises(ValueError, match="unsupported"):
        workflows.check_inputs(spark, base, out, {"human": 1.0}, F.col("provenance"), kinds)
    workflows.start_run(out, got, {"epochs": 2})
    with pytest.raises(FileExistsError):
        workflows.start_run(out, got, {})
    with pytest.raises(FileExistsError):
        workflows.check_inputs(spark, base, out, mix, F.col("provenance"), kinds)
    history = spark.createDataFrame([(0, 0.5, 0.6), (1, 0.8, 0.5), (2, 0.8, 0.4)], "epoch int, macro_auc double, roc_auc double")
    assert workflows.finish_run(history, ["macro_auc", "roc_auc"], out) == {"best_epoch": 1, "completed_epoch": 2, "best_macro_auc": 0.8, "best_roc_auc": 0.5}
    assert files.read_json(f"{out}/summary.json")["best_epoch"] == 1 and files.read_json(f"{out}/run_manifest.json")["training_config"] == {"epochs": 2}
    files.append_history(history.where("epoch < 2"), f"{out}/history.jsonl")
    files.append_history(history.where("epoch = 2"), f"{out}/history.jsonl")
    assert files.read_jsonl(spark, f"{out}/history.jsonl", history.schema).count() == 3


def test_saved_model_and_fusion(spark, tmp_path):
    df = corpus(spark)
    x = df.join(features.stylometric_features(df), "id")
    train, rest = x.where("split = 'train'").persist(), x.where("split = 'calibration'").persist()
    folder = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        models.load_structural(spark, folder)
    flat = lambda d: {r["id"]: round(r["probability"], 9) for r in d.collect()}
    assert flat(models.train_structural(train, steps=20, save=folder)(rest)) == flat(models.load_structural(spark, folder)(rest))
    record = workflows.calibrate_saved(spark, df.where("split = 'calibration'"), folder)
    assert record["max_fpr"] == 0.05 and files.read_json(f"{folder}/calibration.json")["threshold"] == record["threshold"]
    with pytest.raises(ValueError, match="features"):
        models.load_structural(spark, folder, NAMES[::-1])
    for partition in ("train", "development", "calibration"):
        files.write_roles(df.where(F.col("split") == partition), str(tmp_path / "roles"), [partition])
    report = workflows.control_run(spark, str(tmp_path / "roles"), str(tmp_path / "control"), steps=20)
    assert report["development"]["n"] == 40 and files.read_predictions(spark, report["calibration_predictions"]).count() == 40
    outside = df.where("split = 'calibration'").select("text", (1 - F.col("label")).alias("binary_label"), F.lit("C").alias("test_split"), "source", F.lit("f").alias("scenario_family"), F.monotonically_increasing_id().alias("ord"))
    told = workflows.external_run(spark, outside.withColumnRenamed("source", "scenario"), folder)
    assert told["aggregate"]["n"] == 40 and set(told["per_scenario"]) == {"s0", "s1"} and files.read_json(f"{folder}/external_metrics.json")["calibrated_threshold"] == record["threshold"]
    with pytest.raises(FileNotFoundError):
        workflows.external_run(spark, outside, str(tmp_path / "control"))
    fused = models.train_fusion(train)(rest).selectExpr("label", "probability as p")
    assert evaluate.binary_metrics(fused).first()["roc_auc"] > 0.9


def test_mixed_dataset(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i, f"pair number {i} says {'x' * i}", i % 2) for i in range(40)], "ord long, idx long, sentence string, label int")
    said = lambda c: F.concat(F.lit(f"{c} "), F.md5(F.concat(F.lit(c), F.col("prompt_id").cast("string"))))
    groups = spark.range(12).select(F.col("id").cast("string").alias("prompt_id"), F.lit("[]").alias("llama-3.1-70b_edits"), F.lit("[]").alias("gpt-4o_edits"))
    groups = groups.withColumns({c: said(c) for c in ("human_output", "model_output", "human_edits")})
    base = str(tmp_path / "mixed")
    report = workflows.mixed_dataset(pairs, groups, base, 10, 5)
    assert report["groups"]["train"] + report["groups"]["development"] + report["groups"]["calibration"] == 12
    assert report["source_counts"]["development"]["padben"] == 0 and report["source_counts"]["train"]["padben"] == 20
    assert report["rows_checked"] == sum(report["split_counts"].values()) and sum(report["groups"].values()) > 0
    assert json.loads((tmp_path / "mixed" / "report.json").read_text()) == report
    assert spark.read.json(f"{base}/train.jsonl").count() == report["split_counts"]["train"]


def test_boundaries_cohort_progress(spark):
    apart = rec(spark, {"id": "a", "text": "one"}, {"id": "b", "text": "two", "split": "development", "lineage_id": "m"})
    assert audit.audit_boundaries(apart) == 2
    for text, found in ((" ", "blank"), ("one", "exact")):
        with pytest.raises(audit.AuditError, match=found):
            audit.audit_boundaries(rec(spark, {"id": "a", "text": "one"}, {"id": "b", "text": text, "split": "development", "lineage_id": "m"}))
    pool = rec(spark, *[{"id": f"c{i}", "label": i % 2, "text": f"t{i}", "lineage_id": f"l{i}"} for i in range(20)]).withColumn("text_sha256", F.sha2("text", 256))
    cohort = sampling.diagnostic_cohort(pool, pool.where("id in ('c0', 'c1')"), 5, 1).collect()
    assert len(cohort) == 10 and {r["split"] for r in cohort} == {"padben_diagnostic"} and not {"c0", "c1"} & {r["id"] for r in cohort}
    told = []
    p = Progress(10, told.append)
    for n in (4, 5, 3, 20):
        p.onQueryProgress(type("E", (), {"progress": type("P", (), {"numInputRows": n})}))
    assert told == ["12 rows", "32 rows"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    """The command line, on files, in the session of the tests."""
    monkeypatch.setattr("lexmill.session.get_session", lambda *a, **k: spark)
    base = str(tmp_path)
    df = corpus(spark)
    files.write_roles(df, f"{base}/roles", records.ROLES)
    df.write.parquet(f"{base}/rows")
    workflows.main(["audit", f"{base}/rows"])
    assert eval(capsys.readouterr().out) == dict.fromkeys(sorted(records.ROLES), 40)
    workflows.main(["manifest", f"{base}/roles"])
    assert sum(len(line.split()) == 3 for line in capsys.readouterr().out.splitlines()) >= 3
    workflows.main(["train", f"{base}/roles", f"{base}/model", "--steps", "10"])
    assert json.loads(capsys.readouterr().out)["n"] == 40
    workflows.main(["operating-point", f"{base}/rows", f"{base}/model"])
    assert "threshold" in capsys.readouterr().out
    outside = df.select("text", (1 - F.col("label")).alias("binary_label"), F.lit("C").alias("test_split"), F.col("source").alias("scenario"), F.lit("f").alias("scenario_family"))
    outside.write.parquet(f"{base}/outside")
    workflows.main(["external", f"{base}/outside", f"{base}/model"])
    assert json.loads(capsys.readouterr().out)["aggregate"]["n"] == 120
    df.selectExpr("id", "lineage_id", "label", "source", "0.2 + 0.5 * label + 0.1 * (length(text) % 3) as p").write.parquet(f"{base}/scored")
    workflows.main(["diagnose", f"{base}/scored", f"{base}/scored", "--iterations", "20"])
    assert json.loads(capsys.readouterr().out)["auc_gap"] == 0
    files.write_predictions(spark.read.parquet(f"{base}/scored").withColumn("probability", F.col("p").cast("double")), f"{base}/predictions")
    workflows.main(["calibrate", f"{base}/predictions", f"{base}/scored", f"{base}/out", "--folds", "3"])
    assert set(files.read_json(f"{base}/out/calibration.json")) == {"ranking", "platt", "crossfit", "operating_points"}
    with pytest.raises(SystemExit):
        workflows.main(["unknown"])


def test_token_ids_in_steps(spark):
    """Ids are the library's, null and empty texts included, however few characters go through it at once."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "A text.", "ééé \U0001f600 " * 50, "words and words " * 200, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    want = {i: features._tokenizer(path).encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for step in (1, 700, 1 << 18):
        assert {r["id"]: r["i"] for r in df.select("id", features.token_ids(F.col("text"), path, step).alias("i")).collect()} == want
