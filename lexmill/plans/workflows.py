"""Composite workflows: assemble and write datasets, seal cohorts, check inputs, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import audit, evaluate, records, sampling
from ..sources import adapters, files

SEALED_METADATA = ["source_locator", "revision", "row_selection_rule", "selection_seed", "sealed_at"]


def control_dataset(pairs: DataFrame, groups: DataFrame, per_class: int, seed: int, order: str = "ord") -> DataFrame:
    """Sentence pairs, balanced, all in train; prompt groups split whole into calibration, development, train."""
    sample = sampling.balanced_sample(adapters.sentence_pairs(pairs, order), per_class, seed)
    variants = sampling.group_split(adapters.edit_variants(groups), seed, "group_id", 0.15, 0.15, ("calibration", "development", "train"))
    return sample.unionByName(adapters.edit_records(variants.withColumnRenamed("split", "_split"), F.col("_split")))


def mixed_dataset(pairs: DataFrame, groups: DataFrame, base: str, per_class: int, seed: int, threshold: float = 0.85, sources: tuple[str, str] = ("padben", "beemo")) -> dict:
    """control_dataset, held to the boundary audit and written as one shuffled folder a role; reports rows, rows of each
    source (pairs, groups; 0 where there are none) and prompt groups of each role."""
    df = control_dataset(pairs, groups, per_class, seed).persist()  # the audit, the writer and the report each read it
    try:
        checked = audit.audit_boundaries(df.withColumn("ord", F.xxhash64("id")), threshold)
        files.write_roles(sampling.shuffled(df, seed), base, records.ROLES)
        by_source = {r["split"]: {s: r[s] for s in sources} for r in records.split_source_counts(df, list(sources)).collect()}
        rows = {r["split"]: r for r in records.assembly_report(df, sources[1]).collect()}
    finally:
        df.unpersist()
    zero = dict.fromkeys(sources, 0)
    report = {
        "seed": seed, "per_class": per_class, "rows_checked": checked,
        "split_counts": {r: rows[r]["n"] if r in rows else 0 for r in records.ROLES},
        "source_counts": {r: by_source.get(r, zero) for r in records.ROLES},
        "groups": {r: rows[r]["groups"] if r in rows else 0 for r in records.ROLES},
    }
    files.write_json(report, f"{base}/report.json")
    return report


def check_sealed_metadata(metadata: dict) -> None:
    missing = [k for k in SEALED_METADATA if not metadata.get(k)]
    if missing or not (metadata.get("raw_download_sha256") or metadata.get("source_snapshot_sha256")):
        raise ValueError(f"a sealed partition needs metadata: {missing or ['raw_download_sha256 or source_snapshot_sha256']}")


def write_dataset(df: DataFrame, base: str, metadata: dict, threshold: float = 0.85) -> dict:
    """Audits, writes one folder a role (every valid role, even if empty) and the text-free manifest."""
    df = df.persist()  # the audit, the writer and the manifest each read it
    try:
        counts = audit.audit(df, threshold)
        if counts.get("sealed_test"):
            check_sealed_metadata(metadata)
        files.write_roles(df.drop("ord"), base, audit.SPLITS)
        manifest = records.metadata_manifest(df.drop("ord"), metadata)
    finally:
        df.unpersist()
    manifest["manifest_sha256"] = records.digest(manifest)
    files.write_json(manifest, f"{base}/manifest.json")
    files.write_json({"split_counts": counts, "records": sum(counts.values())}, f"{base}/report.json")
    return manifest


def seal_cohort(rows: DataFrame, base: str, pairs: int, seed: int, metadata: dict) -> dict:
    """Best candidates, a digest of them in order, the first families in hash order, then write_dataset.
    Refuses to overwrite and to seal fewer families than asked for."""
    if files.exists(f"{base}/manifest.json"):
        raise FileExistsError(f"{base} is sealed already")
    best = adapters.best_candidates(rows).persist()
    snapshot = records.table_digest(best.select("source_id", "role", "row"), ["source_id", "role"])
    chosen = sampling.family_sample(adapters.family_pairs(best), pairs, seed)
    got = chosen.select("lineage_id").distinct().count()
    if got < pairs:
        raise ValueError(f"only {got} of {pairs} families")
    numbered = chosen.withColumn("ord", F.xxhash64("id"))
    return write_dataset(numbered, base, metadata | {"source_snapshot_sha256": snapshot, "selection_seed": seed})


def baseline_run(df: DataFrame, base: str, variant: str = "word", threshold: float = 0.5) -> dict:
    """Fits a TF-IDF baseline on train, evaluates development and stores text-free calibration predictions.
    df: records with a split; sealed rows are refused."""
    from ..operators import models

    if df.where("sealed").limit(1).count():
        raise ValueError("sealed rows may not be used to fit or score")
    score = models.train_tfidf(df.where("split = 'train'"), variant)
    development = score(df.where("split = 'development'")).select("id", "label", F.col("probability").alias("p"))
    metrics = evaluate.binary_metrics(development, None, threshold).first().asDict()
    files.write_predictions(score(df.where("split = 'calibration'")), f"{base}/calibration_predictions.jsonl")
    report = {"variant": variant, "development": metrics}
    files.write_json(report, f"{base}/report.json")
    return report


def calibration_report(predictions: DataFrame, rows: DataFrame, base: str, folds: int = 5, caps: tuple[float, ...] = (0.01, 0.02, 0.05)) -> dict:
    """Joins predictions to their rows (checked), and reports ranking metrics, the Platt scaler, cross-fitted
    calibration by lineage and the operating points with source-level false-positive rates."""
    from ..operators import calibrate

    joined = calibrate.checked_join(predictions, rows).withColumn("p", F.col("probability")).persist()
    try:
        slope, intercept = calibrate.fit_platt(joined)
        crossfit = calibrate.crossfit_platt(joined, folds)
        report = {
            "ranking": evaluate.binary_metrics(joined).first().asDict(),
            "platt": {"slope": slope, "intercept": intercept},
            "crossfit": evaluate.binary_metrics(crossfit.select("label", F.col("calibrated").alias("p"))).first().asDict(),
            "operating_points": calibrate.operating_points(joined, list(caps)),
        }
    finally:
        joined.unpersist()
    files.write_json(report, f"{base}/calibration.json")
    return report


def check_inputs(spark: SparkSession, base: str, out: str, mix: dict[str, float], stratum: Column, required_positive: list[str], resume: bool = False) -> dict:
    """What a training run must know first, without a look at sealed data: every role is there, no lineage is in two,
    evaluation roles have both labels and every required positive provenance, the weights of the first step can be
    made, and the output is empty (unless resumed). Counts by role and the SHA-256 of each role's files."""
    for role in records.ROLES:
        if not files.exists(f"{base}/{role}.jsonl"):
            raise FileNotFoundError(f"{base}/{role}.jsonl is missing")
    if not resume and files.exists(f"{out}/run_manifest.json"):
        raise FileExistsError(f"{out} holds a run already")
    parts = files.read_partitions(spark, base)
    rows = parts["train"]
    for role in records.ROLES[1:]:
        rows = rows.unionByName(parts[role])
    counts = audit.preflight(rows, required_positive)
    weighted = sampling.hierarchical_weights(parts["train"], mix, stratum)  # raises for strata that do not fit the mix
    mass = weighted.agg(F.sum("weight")).first()[0]
    hashes = {role: {r["path"]: r["sha256"] for r in files.file_manifest(spark, f"{base}/{role}.jsonl").collect()} for role in records.ROLES}  # one row a file
    return {"partition_counts": counts, "partition_sha256": hashes, "train_weight": mass}


def start_run(base: str, inputs: dict, config: dict) -> None:
    """Writes what a run is made from; a second run into the same folder is an error."""
    if files.exists(f"{base}/run_manifest.json"):
        raise FileExistsError(f"{base} holds a run already")
    files.write_json({"preflight": inputs, "training_config": config}, f"{base}/run_manifest.json")


def finish_run(history: DataFrame, keys: list[str], base: str) -> dict:
    """Summary of a run's history: the best epoch with its metrics, and the last one."""
    best = evaluate.best_epoch(history, keys).first().asDict()
    summary = {"best_epoch": best["epoch"], "completed_epoch": history.agg(F.max("epoch")).first()[0]} | {f"best_{k}": best[k] for k in keys}
    files.write_json(best, f"{base}/development_metrics.json")
    files.write_json(summary, f"{base}/summary.json")
    return summary


def calibrate_saved(spark: SparkSession, rows: DataFrame, folder: str, max_fpr: float = 0.05, partition: str = "calibration") -> dict:
    """Scores calibration rows with a saved model whose features are checked, and stores its operating threshold."""
    from ..operators import calibrate, features, models

    score = models.load_structural(spark, folder)
    flat = rows.join(features.stylometric_features(rows), "id")
    scored = score(flat).withColumn("p", F.col("probability")).persist()
    try:
        record = calibrate.operating_points(scored, [max_fpr])[0] | {"partition": partition, "variant": "structural"}
    finally:
        scored.unpersist()
    files.write_json(record, f"{folder}/calibration.json")
    return record


def fit_diagnostics(train: DataFrame, development: DataFrame, iterations: int = 1000, seed: int = 0) -> dict:
    """Train and development AUC, their gap, the resolution of the human rate, and the bootstrap interval."""
    from ..operators import models

    dev = evaluate.binary_metrics(development).withColumn("humans", F.lit(development.where("label = 0").count()))
    gap = models.fit_gap(evaluate.binary_metrics(train), dev).first().asDict()
    return gap | {"bootstrap": evaluate.bootstrap_auc(development, iterations, seed).first().asDict()}


def external_report(scored: DataFrame, threshold: float) -> dict[str, DataFrame]:
    """Metrics at a frozen threshold: aggregate, by scenario and by scenario family."""
    return {
        "aggregate": evaluate.binary_metrics(scored, None, threshold), "scenario": evaluate.binary_metrics(scored, ["scenario"], threshold),
        "scenario_family": evaluate.binary_metrics(scored, ["scenario_family"], threshold),
    }


def train_run(spark: SparkSession, base: str, out: str, hidden: int = 48, steps: int = 100, seed: int = 17, threshold: float = 0.5) -> dict:
    """Fits the structural model on the train role, stores it with its normaliser, and reports the development role, which must have both labels."""
    from ..operators import features, models

    parts = files.read_partitions(spark, base)
    flat = {r: parts[r].join(features.stylometric_features(parts[r]), "id").persist() for r in ("train", "development")}
    try:
        if flat["development"].select("label").distinct().count() < 2:
            raise ValueError("the development role needs both labels")
        score = models.train_structural(flat["train"], hidden, seed, steps, save=out)
        scored = score(flat["development"]).withColumn("p", F.col("probability"))
        report = evaluate.binary_metrics(scored, None, threshold).first().asDict()
    finally:
        for df in flat.values():
            df.unpersist()
    files.write_json(report, f"{out}/development_metrics.json")
    return report


def control_run(spark: SparkSession, base: str, out: str, **settings) -> dict:
    """train_run, then text-free predictions of the calibration role by the model as it was stored."""
    from ..operators import features, models

    report = train_run(spark, base, out, **settings)
    rows = files.read_partition(spark, base, "calibration")
    files.write_predictions(models.predictions(models.load_structural(spark, out)(rows.join(features.stylometric_features(rows), "id"))), f"{out}/calibration_predictions.jsonl")
    return {"variant": "structural", "model": f"{out}/model", "development": report, "calibration_predictions": f"{out}/calibration_predictions.jsonl"}


def external_run(spark: SparkSession, rows: DataFrame, folder: str, order: str = "ord") -> dict:
    """An outside benchmark scored by a stored model at its stored threshold; all parts of the model must be there."""
    from ..operators import features, models

    if not files.exists(f"{folder}/calibration.json"):
        raise FileNotFoundError(f"{folder}/calibration.json is missing")
    record = files.read_json(f"{folder}/calibration.json")
    score = models.load_structural(spark, folder)
    flat = adapters.external_rows(rows, order)
    scored = score(flat.join(features.stylometric_features(flat), "id")).withColumn("p", F.col("probability")).persist()
    try:
        tables = {k: [r.asDict() for r in v.collect()] for k, v in external_report(scored, record["threshold"]).items()}  # one row a scenario
    finally:
        scored.unpersist()
    report = {"variant": record["variant"], "calibrated_threshold": record["threshold"], "aggregate": tables["aggregate"][0], "per_scenario": {r.pop("scenario"): r for r in tables["scenario"]}, "per_scenario_family": {r.pop("scenario_family"): r for r in tables["scenario_family"]}}
    files.write_json(report, f"{folder}/external_metrics.json")
    return report


def main(argv: list[str] | None = None) -> None:
    """python -m lexmill.plans.workflows COMMAND ...: audit PATH, manifest PATH, baseline ROWS OUT, calibrate PREDICTIONS
    ROWS OUT, operating-point ROWS MODEL, external ROWS MODEL, train BASE OUT, control BASE OUT, diagnose TRAIN DEVELOPMENT,
    seal ROWS OUT METADATA. Tables are Parquet, predictions and the roles below a base JSON lines."""
    import argparse
    import json

    from ..session import get_session

    p = argparse.ArgumentParser()
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        return c

    command("audit", "path").add_argument("--threshold", type=float, default=0.85)
    command("manifest", "path")
    command("baseline", "rows", "out").add_argument("--variant", choices=["word", "char"], default="word")
    command("calibrate", "predictions", "rows", "out").add_argument("--folds", type=int, default=5)
    command("operating-point", "rows", "model").add_argument("--max-fpr", type=float, default=0.05)
    command("external", "rows", "model")
    for name in ("train", "control"):
        c = command(name, "base", "out")
        c.add_argument("--hidden", type=int, default=48)
        c.add_argument("--steps", type=int, default=100)
        c.add_argument("--seed", type=int, default=17)
    command("diagnose", "train", "development").add_argument("--iterations", type=int, default=1000)
    seal = command("seal", "rows", "out", "metadata")
    seal.add_argument("--pairs", type=int, default=2500)
    seal.add_argument("--seed", type=int, default=20260904)
    a = p.parse_args(argv)
    spark: SparkSession = get_session()
    table = spark.read.parquet
    if a.command == "audit":
        df = table(a.path)
        print(audit.audit(df if "ord" in df.columns else df.withColumn("ord", F.xxhash64("id")), a.threshold))
    elif a.command == "manifest":
        for r in files.file_manifest(spark, a.path).orderBy("path").toLocalIterator():
            print(r["sha256"], r["bytes"], r["path"])
    elif a.command == "baseline":
        print(baseline_run(table(a.rows), a.out, a.variant))
    elif a.command == "calibrate":
        print(calibration_report(files.read_predictions(spark, a.predictions), table(a.rows), a.out, a.folds))
    elif a.command == "operating-point":
        print(calibrate_saved(spark, table(a.rows), a.model, a.max_fpr))
    elif a.command == "external":
        rows = table(a.rows)
        print(json.dumps(external_run(spark, rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id()), a.model), indent=2))
    elif a.command in ("train", "control"):
        run = train_run if a.command == "train" else control_run
        print(json.dumps(run(spark, a.base, a.out, hidden=a.hidden, steps=a.steps, seed=a.seed), indent=2))
    elif a.command == "diagnose":
        print(json.dumps(fit_diagnostics(table(a.train), table(a.development), a.iterations), indent=2))
    else:
        print(seal_cohort(table(a.rows), a.out, a.pairs, a.seed, files.read_json(a.metadata))["manifest_sha256"])


if __name__ == "__main__":
    main()
