"""Ranking and threshold metrics of scored binary labels, per group, on distinct-score counts.

Everything starts from one partial aggregate, the counts of both labels at each distinct score of a
group. Running totals over descending scores are taken in two levels: range partitions of (group, score), which a sample
of the scores themselves cuts evenly wherever they lie, then the scores in one. No window holds all distinct scores
of a group, be they bunched, negative or unbounded. Null scores count as the least.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from . import ordering
from .ordering import null_safe


def score_counts(df: DataFrame, by: list[str], label: str = "label", score: str = "p") -> DataFrame:
    """by, score, tp, fp: labels 1 and 0 at each distinct score."""
    y = F.col(label)
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("tp"), F.sum(F.when(y == 1, 0).otherwise(1)).alias("fp"))


def cumulative(df: DataFrame, by: list[str], label: str = "label", score: str = "p") -> DataFrame:
    """score_counts with ctp and cfp (scores at least this one), pos and neg (whole group), and whether the
    point stays when collinear points of the curve are dropped."""
    counts = ordering.ranged(score_counts(df, by, label, score), by, [F.desc("score")])
    cell = [*by, "_cell"]
    # The point after the last of a cell is the first of the next one.
    per = counts.groupBy(*cell).agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"), F.min_by(F.struct("tp", "fp"), "_at").alias("first"))
    group = Window.partitionBy(*by)
    down = group.orderBy("_cell")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        per.withColumn("atp", F.coalesce(F.sum("btp").over(before), F.lit(0)))
        .withColumn("afp", F.coalesce(F.sum("bfp").over(before), F.lit(0)))
        .withColumn("pos", F.sum("btp").over(group))
        .withColumn("neg", F.sum("bfp").over(group))
        .withColumn("below", F.lead("first").over(down))
        .withColumn("top", F.row_number().over(down) == 1)
        .select(*cell, "atp", "afp", "pos", "neg", "below", "top")
    )
    inner = Window.partitionBy(*cell).orderBy("_at")
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("ctp", F.sum("tp").over(run)).withColumn("cfp", F.sum("fp").over(run))
        .withColumn("after", F.lead(F.struct("tp", "fp")).over(inner)).withColumn("head", F.row_number().over(inner) == 1)
    )
    joined = null_safe(placed, cells, cell)
    nxt = F.coalesce("after", "below")
    return joined.select(
        *by, "score", "tp", "fp", (F.col("atp") + F.col("ctp")).alias("ctp"), (F.col("afp") + F.col("cfp")).alias("cfp"), "pos", "neg",
        (nxt.isNull() | (F.col("top") & F.col("head")) | (nxt["tp"] != F.col("tp")) | (nxt["fp"] != F.col("fp"))).alias("corner"),
    )


def roc_points(frame: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, fpr, tpr of the kept points; the point (0, 0) has an infinite threshold."""
    kept = frame.where("corner and pos > 0 and neg > 0").select(*by, F.col("score").alias("threshold"), (F.col("cfp") / F.col("neg")).alias("fpr"), (F.col("ctp") / F.col("pos")).alias("tpr"))
    origin = frame.where("pos > 0 and neg > 0").select(*by).distinct() if by else frame.where("pos > 0 and neg > 0").select(F.lit(1).alias("_")).distinct().drop("_")
    return kept.unionByName(origin.select(*by, F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def _defined(value: Column) -> Column:
    return F.when((F.first("pos") > 0) & (F.first("neg") > 0), value)


def ranking(frame: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """by, roc_auc, pr_auc, tpr_at_1pct_fpr, partial_auc; null for groups of one class."""
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    pos, neg = F.when(both, F.col("pos").cast("double")), F.when(both, F.col("neg").cast("double"))
    x1, y1 = F.col("cfp") / neg, F.col("ctp") / pos
    x0, y0 = (F.col("cfp") - F.col("fp")) / neg, (F.col("ctp") - F.col("tp")) / pos
    m = F.lit(max_fpr)
    cut = (m - x0) * (2 * y0 + (y1 - y0) * (m - x0) / F.when(x1 > x0, x1 - x0)) / 2
    area = F.when(x0 >= m, F.lit(0.0)).when(x1 <= m, (x1 - x0) * (y0 + y1) / 2).otherwise(F.coalesce(cut, F.lit(0.0)))
    low, high = max_fpr * max_fpr / 2, max_fpr
    return frame.groupBy(*by).agg(
        _defined(F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2.0) / (pos * neg))).alias("roc_auc"),
        _defined(F.sum(F.col("tp") / pos * F.col("ctp") / (F.col("ctp") + F.col("cfp")))).alias("pr_auc"),
        _defined(F.coalesce(F.max(F.when(F.col("corner") & (x1 <= 0.01), y1)), F.lit(0.0))).alias("tpr_at_1pct_fpr"),
        _defined(0.5 * (1 + (F.sum(area) - low) / (high - low))).alias("partial_auc"),
    )


def calibration_bins(df: DataFrame, by: list[str], label: str = "label", score: str = "p", bins: int = 10) -> DataFrame:
    """by, bin, n, mean_score, mean_label over equal-width bins."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def expected_calibration_error(df: DataFrame, by: list[str], label: str = "label", score: str = "p", bins: int = 10) -> DataFrame:
    return calibration_bins(df, by, label, score, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


def confusion(df: DataFrame, by: list[str], threshold: float = 0.5, label: str = "label", score: str = "p") -> DataFrame:
    """by, n, tn, fp, fn, tp, brier; a score counts as positive from the threshold on."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"),
    )


def binary_metrics(df: DataFrame, by: list[str] | None = None, threshold: float = 0.5, label: str = "label", score: str = "p") -> DataFrame:
    """All metrics of each group, a null key being a group of its own. Ranking metrics are null for one class, human_fpr without negatives;
    precision, recall and F1 are 0 where undefined."""
    by = by or []
    key = by or ["_all"]
    df = df.select(*by, F.col(label).alias(label), F.col(score).cast("double").alias(score))
    src = df if by else df.withColumn("_all", F.lit(1))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    base = confusion(src, key, threshold, label, score).select(
        *key, "n", ((tp + tn) / F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(fp + tn > 0, fp / (fp + tn)).alias("human_fpr"), "brier",
    )
    out = null_safe(null_safe(base, ranking(cumulative(src, key, label, score), key), key), expected_calibration_error(src, key, label, score), key)
    return out if by else out.drop("_all")


def subtype_frame(df: DataFrame, label: str = "label", provenance: str = "provenance") -> DataFrame:
    """All negatives joined by each positive provenance: the rows of each subtype, in column ``subtype``. Positives without a
    provenance are of no subtype. Only the distinct provenances, a handful of values, are crossed with the negatives."""
    df = df.where((F.col(label) == 0) | F.col(provenance).isNotNull())
    kinds = df.where(F.col(label) == 1).agg(F.collect_set(provenance).alias("kinds"))
    subtype = F.explode("kinds").alias("subtype")
    negatives = df.where(F.col(label) == 0).join(F.broadcast(kinds)).select(*df.columns, subtype)  # one row of distinct values
    return negatives.unionByName(df.where(F.col(label) == 1).withColumn("subtype", F.col(provenance)))


def best_thresholds(df: DataFrame, caps: list[float], by: list[str] | None = None, label: str = "label", score: str = "p") -> DataFrame:
    """by, max_fpr, threshold, recall, fpr: for each cap the threshold with the best recall among those whose
    false-positive rate keeps to it; ties prefer the lower rate, then the lower threshold. The double over
    the highest score is always a candidate: it means to abstain."""
    by = by or []
    key = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(1))
    frame = cumulative(src, key, label, score)
    recall, fpr = ratio(F.col("ctp"), F.col("pos")), ratio(F.col("cfp"), F.col("neg"))
    seen = frame.select(*key, F.col("score").alias("threshold"), recall.alias("recall"), fpr.alias("fpr"))
    top = frame.groupBy(*key).agg(F.max("score").alias("top"))
    # The next double over x lies a unit in the last place away, which depends on the binade of |x|; half of it over a negative power of two.
    size = F.abs("top")
    e = F.floor(F.log2(size))
    e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    e = F.when((F.col("top") < 0) & (F.pow(F.lit(2.0), e) == size), e - 1).otherwise(e)
    over = F.when(F.col("top") == 0, F.lit(5e-324)).otherwise(F.col("top") + F.pow(F.lit(2.0), F.greatest(e - 52, F.lit(-1074))))
    every = seen.unionByName(top.select(*key, over.alias("threshold"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("fpr")))
    capped = every.withColumn("max_fpr", F.explode(F.array(*[F.lit(c) for c in caps]))).where("fpr <= max_fpr")
    best = F.max_by(F.struct("threshold", "recall", "fpr"), F.struct(F.col("recall").alias("a"), (-F.col("fpr")).alias("b"), (-F.col("threshold")).alias("c")))
    return capped.groupBy(*key, "max_fpr").agg(best.alias("b")).select(*by, "max_fpr", "b.threshold", "b.recall", "b.fpr")


def subtype_report(df: DataFrame, subtypes: list[str], max_fpr: float = 0.05, label: str = "label", score: str = "p", provenance: str = "provenance") -> DataFrame:
    """subtype, the metrics of binary_metrics over the negatives and the rows of that provenance, and at the best threshold
    within ``max_fpr``: threshold, tpr_at_cap, fpr_at_cap, false_positives. A subtype without both classes is an error."""
    kinds = F.filter(F.array(*[F.lit(s) for s in subtypes]), lambda s: (F.col(label) == 0) | (s == F.col(provenance)))
    frame = df.select(label, score, F.explode(kinds).alias("subtype"))
    classes = frame.groupBy("subtype").agg(F.count_distinct(label).alias("n"), F.count_if(F.col(label) == 0).alias("negatives"))
    seen = {r["subtype"]: r["n"] for r in classes.collect()}  # one row a subtype asked for
    lacking = [s for s in subtypes if seen.get(s, 0) != 2]
    if lacking:
        raise ValueError(f"subtypes without both classes: {lacking}")
    points = best_thresholds(frame, [max_fpr], ["subtype"], label, score).drop("max_fpr")
    at = points.join(classes, "subtype").select("subtype", "threshold", F.col("recall").alias("tpr_at_cap"), F.col("fpr").alias("fpr_at_cap"), F.round(F.col("fpr") * F.col("negatives")).cast("long").alias("false_positives"))
    return binary_metrics(frame, ["subtype"], 0.5, label, score).join(at, "subtype")


def selection_metrics(report: DataFrame, subtypes: list[str]) -> DataFrame:
    """One row: macro_auc and macro_partial_auc of a subtype_report over the subtypes that checkpoints are chosen by."""
    return report.where(F.col("subtype").isin(subtypes)).agg(F.avg("roc_auc").alias("macro_auc"), F.avg("partial_auc").alias("macro_partial_auc"))


def source_fpr(df: DataFrame, thresholds: DataFrame, source: str = "source", label: str = "label", score: str = "p") -> DataFrame:
    """max_fpr, source, human_fpr at each operating point (one row a point: bounded by the caps asked for)."""
    return (
        df.where(F.col(label) == 0).join(F.broadcast(thresholds.select("max_fpr", "threshold")))
        .groupBy("max_fpr", source).agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("human_fpr"))
    )


def best_epoch(history: DataFrame, keys: list[str], epoch: str = "epoch", by: list[str] | None = None) -> DataFrame:
    """The first of the best rows by descending keys, nulls as the least."""
    order = F.struct(*[F.coalesce(F.col(k), F.lit(-math.inf)).alias(f"k{i}") for i, k in enumerate(keys)], (-F.col(epoch)).alias("e"))
    return history.groupBy(*(by or [])).agg(F.max_by(F.struct(*[F.col(c) for c in history.columns]), order).alias("b")).select("b.*")


def early_stop(history: DataFrame, key: str, epoch: str = "epoch", least: int = 3, patience: int = 2) -> DataFrame:
    """history with best (so far), since (epochs since it improved) and stop."""
    w = Window.partitionBy(F.lit(0)).orderBy(epoch)  # one row an epoch
    prior = F.max(key).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("improved", prior.isNull() | (F.col(key) > prior))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return better.withColumn("since", F.col(epoch) - last).withColumn("stop", (F.col(epoch) >= least) & (F.col("since") >= patience))


def bootstrap_runs(df: DataFrame, iterations: int = 1000, seed: int = 0, label: str = "label", score: str = "p", cell: int = 4096) -> DataFrame:
    """run, auc of resamples within each class; without both classes no rows. Resampling n rows is a multinomial draw on
    the counts of distinct scores: a splitting tree deals a run's draws to cells of ``cell`` consecutive scores, each
    cell draws its scores for a block of runs, and the pairs of scores in different cells follow from the cells' totals."""
    places = ordering.ranked(score_counts(df, [], label, score), [], [F.asc("score")]).select(F.floor(F.col("rank") / cell).alias("_node"), "rank", "tp", "fp")
    sums = ordering.settled(places.groupBy("_node").agg(F.sum("tp").cast("double").alias("tp"), F.sum("fp").cast("double").alias("fp")))
    pos, neg = sums.agg(F.coalesce(F.sum("tp"), F.lit(0.0)), F.coalesce(F.sum("fp"), F.lit(0.0))).first()
    if not pos or not neg:
        return df.sparkSession.createDataFrame([], "run long, auc double")
    drawn = ordering.split_draws(sums, ["tp", "fp"], [int(pos), int(neg)], iterations, seed)

    def inside(key: tuple, scores: pa.Table, some: pa.Table) -> pa.Table:
        node, block = (k.as_py() for k in key)
        order, at = np.argsort(scores.column("rank").to_numpy()), np.argsort(some.column("_run").to_numpy())
        rng = np.random.default_rng([seed % 2**63, 1 << 20, node, block])
        got = []
        for name in ("tp", "fp"):
            p, n = scores.column(name).to_numpy()[order].astype(np.float64), some.column(name).to_numpy()[at]
            got.append(rng.multinomial(n, p / p.sum()) if p.sum() else np.zeros((len(n), len(p)), np.int64))
        t, f = got
        pairs = (t * (np.cumsum(f, axis=1) - f / 2)).sum(axis=1)
        return pa.table({"run": some.column("_run").to_numpy()[at], "node": np.full(len(at), node), "t": t.sum(axis=1), "f": f.sum(axis=1), "pairs": pairs})

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((iterations - 1) // ordering.RUNS).cast("long")))
    scores = places.select("*", blocks.alias("_block"))
    some = drawn.withColumn("_block", F.floor(F.col("_run") / ordering.RUNS))
    cells = scores.groupBy("_node", "_block").cogroup(some.groupBy("_node", "_block")).applyInArrow(inside, "run long, node long, t long, f long, pairs double")
    below = F.coalesce(F.sum("f").over(Window.partitionBy("run").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("_below", below).groupBy("run").agg((F.sum(F.col("pairs") + F.col("t").cast("double") * F.col("_below")) / (F.lit(float(pos)) * F.lit(float(neg)))).alias("auc"))


def bootstrap_auc(df: DataFrame, iterations: int = 1000, seed: int = 0, label: str = "label", score: str = "p") -> DataFrame:
    """low, median, high: 2.5, 50 and 97.5 percent points (linear between ranks) of the AUC of bootstrap_runs; nulls without both classes."""
    return bootstrap_runs(df, iterations, seed, label, score).agg(*[F.percentile("auc", F.lit(q)).alias(n) for n, q in (("low", 0.025), ("median", 0.5), ("high", 0.975))])
