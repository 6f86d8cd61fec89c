"""Platt scaling, grouped cross-fitting and operating-point reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import logit, sigmoid
from ..session import settled
from . import evaluate


def join_problems(predictions: DataFrame, rows: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """key and problem of every id that checked_join would refuse: missing (no prediction), foreign (no row; a null id is
    both), repeated (on either side), label (different, or null on either side)."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"_n{n}"), F.min(label).alias(f"_y{n}"))
    full = side(rows, "a").join(side(predictions, "b"), key, "full_outer")
    same = F.coalesce(F.col("_ya") == F.col("_yb"), F.lit(False))
    problem = F.when(F.col("_nb").isNull(), "missing").when(F.col("_na").isNull(), "foreign").when((F.col("_na") > 1) | (F.col("_nb") > 1), "repeated").when(~same, "label")
    return full.select(key, problem.alias("problem")).where("problem is not null")


def checked_join(predictions: DataFrame, rows: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """rows with probability; ids must be the same and unique on both sides, labels equal and not null, probabilities in [0, 1]."""
    outside = predictions.where(~F.coalesce(F.col("probability").between(0, 1), F.lit(False)))
    if outside.limit(1).count() or join_problems(predictions, rows, key, label).limit(1).count():
        raise ValueError("predictions and rows do not match")
    return rows.join(predictions.select(key, "probability"), key)


def _points(df: DataFrame, fold, label: str, score: str) -> DataFrame:
    """_f (fold), _x (logit), _y, _n: what the fits need, one row a distinct score of a fold."""
    return settled(df.groupBy(fold.alias("_f"), logit(F.col(score)).alias("_x"), F.col(label).cast("double").alias("_y")).agg(F.count("*").alias("_n")))


def _newton(points: DataFrame, models: list[int], l2: float = 1e-6, steps: int = 100) -> np.ndarray:
    """slope and intercept of each model, logistic regressions on all points but those of its own fold, the slope penalised
    by l2 / 2 of its square. One aggregate is a Newton step of all models: it sums loss, gradient and Hessian by model, and a
    step that does not lessen a model's loss is halved."""

    def sums(theta: np.ndarray) -> np.ndarray:
        table = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for m, (a, b) in zip(models, theta, strict=True)]))
        x, y, n = F.col("_x"), F.col("_y"), F.col("_n")
        z = F.col("_t.a") * x + F.col("_t.b")
        p = sigmoid(z)
        h = n * p * (1 - p)
        loss = n * (F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z))))
        parts = [loss, n * (p - y) * x, n * (p - y), h * x * x, h * x, h, n * y, n * (1 - y)]
        got = points.select("*", table.alias("_t")).where("_t.m <> _f").groupBy("_t.m").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(parts)]).collect()  # one row a model
        by = {r["m"]: list(r)[1:] for r in got}
        if any(m not in by or not by[m][6] or not by[m][7] for m in models):
            raise ValueError("a training part has one class only")
        out = np.array([by[m] for m in models], float)
        out[:, 0] += l2 * theta[:, 0] ** 2 / 2
        out[:, 1] += l2 * theta[:, 0]
        out[:, 3] += l2
        return out

    theta = np.zeros((len(models), 2))
    at = sums(theta)
    step = None
    for _ in range(steps):
        if step is None:
            det = at[:, 3] * at[:, 5] - at[:, 4] ** 2
            det = np.where(det > 0, det, np.finfo(float).tiny)
            step = np.stack([at[:, 5] * at[:, 1] - at[:, 4] * at[:, 2], at[:, 3] * at[:, 2] - at[:, 4] * at[:, 1]], 1) / det[:, None]
        if (np.abs(step) <= 1e-11 * (1 + np.abs(theta))).all():
            break
        new = sums(theta - step)
        worse = ~(new[:, 0] <= at[:, 0] + 1e-12 * (1 + np.abs(at[:, 0])))
        if worse.any():
            step = np.where(worse[:, None], step / 2, step)
        else:
            theta, at, step = theta - step, new, None
    return theta


def fit_platt(df: DataFrame, label: str = "label", score: str = "p") -> tuple[float, float]:
    """slope and intercept of a logistic regression on the logit of the score, with L2 strength 1 / 1e6."""
    slope, intercept = _newton(_points(df, F.lit(-1), label, score), [0])[0].tolist()
    return slope, intercept


def _shares(load: list[int], size: int, m: int) -> list[int]:
    """How many of m groups of one size each fold takes, if each group goes to the lightest fold so far, the first of ties."""
    under = lambda t: [max(0, -((x - t) // size)) for x in load]  # noqa: E731 - groups put where the fold was under t
    low, high = min(load), min(load) + size * m + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(under(mid)) <= m else (low, mid)
    out = under(low)
    rest = m - sum(out)
    for f, x in enumerate(load):
        if rest and x + out[f] * size == low:
            out[f], rest = out[f] + 1, rest - 1
    return out


def group_folds(df: DataFrame, folds: int, group: str, chunk: int = 100_000) -> DataFrame:
    """group, fold: groups by descending size (ties by descending name, null last), each to the lightest fold so far.
    The greedy rule is sequential, but among groups of one size it depends on their number only: the driver sees one
    row a size and range partition, and works out how many of a size each fold takes. The places of a fold in the order
    of a size follow from the loads before it, and groups are joined to them by size and rank."""
    spark, down = df.sparkSession, F.col("_g").desc_nulls_last()
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"))
    placed = settled(sizes.repartitionByRange(F.desc("_size"), down).withColumn("_p", F.spark_partition_id()))
    found = sorted(((r["_size"], r["_p"], r["count"]) for r in placed.groupBy("_size", "_p").count().collect()), key=lambda r: (-r[0], r[1]))
    starts, total = [], {}
    for size, p, n in found:
        starts.append((size, p, total.get(size, 0)))
        total[size] = total.get(size, 0) + n
    load, rows = [0] * folds, []
    for size, m in total.items():  # sizes descend
        take = _shares(load, size, m)
        for f, n in enumerate(take):
            rows += [(size, f, a, min(n, a + chunk) - 1, load, take) for a in range(0, n, chunk)]
        load = [x + n * size for x, n in zip(load, take, strict=True)]
    table = spark.createDataFrame(rows, "_size long, fold int, _a long, _z long, _load array<long>, _take array<long>")
    level = F.get("_load", F.col("fold")) + F.col("_j") * F.col("_size")  # of the fold when it takes its group j
    before = F.lit(0)
    for g in range(folds):
        gap = (level - F.get("_load", F.lit(g))) / F.col("_size")
        before = before + F.least(F.greatest(F.when(F.col("fold") > g, F.floor(gap) + 1).otherwise(F.ceil(gap)), F.lit(0)), F.get("_take", F.lit(g)))
    places = table.withColumn("_j", F.explode(F.sequence("_a", "_z"))).select("_size", "fold", before.alias("_rank"))
    rank = F.col("_s") + F.row_number().over(Window.partitionBy("_p", "_size").orderBy(down)) - 1
    ranked = placed.join(spark.createDataFrame(starts, "_size long, _p int, _s long"), ["_size", "_p"]).select("_g", "_size", rank.alias("_rank"))
    return ranked.join(places, ["_size", "_rank"]).select(F.col("_g").alias(group), "fold")


def crossfit_platt(df: DataFrame, folds: int = 5, group: str = "lineage_id", label: str = "label", score: str = "p") -> DataFrame:
    """df with fold and calibrated: each fold is scaled by a fit on the others, all fits in the same passes. Errors: under
    two groups, or a training part of one class."""
    k = df.select(group).distinct().limit(folds).count()
    if k < 2:
        raise ValueError("cross-fitting needs at least two groups")
    rows = settled(evaluate.null_safe(df, group_folds(df, k, group), [group]))
    theta = _newton(_points(rows, F.col("fold"), label, score), list(range(k)))
    slope, intercept = (F.get(F.array(*[F.lit(float(v)) for v in theta[:, i]]), F.col("fold")) for i in (0, 1))
    return rows.withColumn("calibrated", sigmoid(slope * logit(F.col(score)) + intercept))


def operating_points(df: DataFrame, caps: list[float] | None = None, source: str = "source", label: str = "label", score: str = "p") -> list[dict]:
    """For each cap: threshold, the metrics there, the human FPR by source and the worst source."""
    caps = caps or [0.01, 0.02, 0.05]
    points = evaluate.best_thresholds(df, caps, None, label, score)
    by = {}
    for r in evaluate.source_fpr(df, points, source, label, score).collect():  # caps x sources
        by.setdefault(r["max_fpr"], {})[r[source]] = r["human_fpr"]
    out = []
    for r in sorted(points.collect(), key=lambda r: r["max_fpr"]):
        m = evaluate.binary_metrics(df, None, r["threshold"], label, score).first().asDict()
        rates = dict(sorted(by.get(r["max_fpr"], {}).items()))
        out.append({"max_fpr": r["max_fpr"], "threshold": r["threshold"], "metrics": m, "source_human_fpr": rates, "worst_source": max(rates, key=rates.get) if rates else None})
    return out
