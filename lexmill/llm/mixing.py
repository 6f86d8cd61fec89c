"""Mixing sources to target weights by entropy balancing.

Sources get token targets by their weights, none over ``most`` times its size. Of all document rates r that meet a
source's target, sum of size * r = target with 0 <= r <= most, the one of greatest entropy relative to rate 1 (least sum of
r ln r - r) is an exponential tilt by size, r = min(most, exp(lambda * size)), lambda being the source's dual variable.
The dual is convex with one variable a source, and its Hessian diagonal, so one aggregate by source is a Newton step
of all sources. Documents of one source and size share their rate: the steps run on the counts of each (source, size).

    h(lambda) = sum of size * min(most, exp(lambda * size)) is solved for the target by Newton steps on ln h, kept
    inside a bracket: the root lies between 0 and ln(target / size of the source), as no size is under 1.

Rates become whole copies by carrying the rounding error from document to document, longest first, in runs of CHUNK
documents of a source: a run is off by about half its shortest document, or by up to half its longest where the others, at
``most`` copies each, do not make up for it. All sums are of integers or decimals and places
follow from sizes and ids, so results do not depend on partitioning: reruns agree.

Semantics: a null text has no words; documents without words are taken 0 times whatever their rate. A null source is one of its own,
the last. Repeated rows are documents of their own, and null ids come first among equal sizes. Texts are counted whole. A source
without words has target 0. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, group_order

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 512


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source in order, null last), size (words of the whole text)."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int, scratch: Scratch) -> DataFrame:
    """key, source_size, target: ``share`` of all sizes by weight (repeating over the sources in order), where none gets
    over ``most`` times its size and the excess is shared anew by weight until none is above."""
    total = scratch.save(sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit("")))
    ranked = group_order(total, "_one", ["key"], scratch)
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights)).cast("int"))
    sources = scratch.save(ranked.select("key", "source_size", weight.alias("weight")))
    whole = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, capped = most * F.col("source_size"), 0.0, -1
    while True:  # the capped sources grow until none is added
        over = cap < F.lit(level) * F.col("weight")
        full, free, n = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == capped or not free:
            break
        capped, level = n, (whole - (full or 0)) / free
    return sources.select("key", "source_size", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def _rate(most: int, lam: str = "lam", size: str = "size"):
    return F.least(F.lit(float(most)), F.exp(F.least(F.col(lam) * F.col(size), F.lit(math.log(most) + 1))))


def balance(counts: DataFrame, wanted: DataFrame, most: int, scratch: Scratch, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """wanted (key, source_size, target) with lam, the dual variable of each source with words."""
    state = wanted.where("source_size > 0 and target > 0").select(
        "*", F.least(F.lit(0.0), F.ln(F.col("target") / F.col("source_size"))).alias("lo"), F.greatest(F.lit(0.0), F.ln(F.col("target") / F.col("source_size"))).alias("hi"),
        F.lit(0.0).alias("lam"), F.lit(False).alias("done"),
    )
    state = scratch.save(state)
    for _ in range(rounds):
        words = F.col("n") * F.col("size") * _rate(most)
        slope = F.when(F.col("lam") * F.col("size") < math.log(most), words * F.col("size")).otherwise(F.lit(0.0))
        sums = counts.join(state.where("not done").select("key", "lam"), "key").groupBy("key").agg(F.sum(words.cast("decimal(38,6)")).cast("double").alias("h"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("d"))
        met = F.abs(F.col("h") - F.col("target")) <= F.lit(tolerance) * F.col("target")
        lo, hi = F.when(F.col("h") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("h") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") + (F.ln("target") - F.ln("h")) * F.col("h") / F.when(F.col("d") > 0, F.col("d"))
        moved = state.where("not done").join(sums, "key").select("key", "source_size", "target", lo.alias("lo"), hi.alias("hi"), F.when(met, F.col("lam")).otherwise(step).alias("_step"), "lam", met.alias("done"))
        inside = F.col("_step").isNotNull() & (F.col("_step") > F.col("lo")) & (F.col("_step") < F.col("hi"))
        middle = (F.col("lo") + F.col("hi")) / 2
        stuck = ~F.col("done") & (F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.abs("lo"), F.abs("hi")))  # neighbouring doubles
        moved = moved.select("key", "source_size", "target", "lo", "hi", F.when(F.col("done") | inside, F.col("_step")).otherwise(middle).alias("lam"), (F.col("done") | stuck).alias("done"))
        state = scratch.save(state.where("done").unionByName(moved))
        if not state.where("not done").limit(1).count():
            break
    return state.select("key", "source_size", "target", "lam")


def _copies(most: int):
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("at", kind="stable")
        carry, out = 0.0, []
        for size, rate in zip(chunk["size"].tolist(), chunk["rate"].tolist(), strict=True):
            if not size:
                out.append(0)
                continue
            n = min(most, max(0, math.floor(rate + carry / size + 0.5)))
            carry += (rate - n) * size
            out.append(n)
        return chunk[["doc_id", "size", "source_size", "target", "rate"]].assign(copies=np.array(out, np.int32))

    return run


def mix(docs: DataFrame, weights: list[int], share: float, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies (0 to ``most``) and taken (words, copies counted) of every document."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(document_sizes(docs))
    wanted = scratch.save(targets(sizes, weights, share, most, scratch))
    counts = scratch.save(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    dual = balance(counts, wanted, most, scratch).select("key", "lam")
    known = wanted.join(dual, "key", "left")
    placed = group_order(sizes.withColumn("_down", -F.col("size")), "key", ["_down", "doc_id"], scratch)
    placed = scratch.save(placed.select("key", F.floor(F.col("at") / CHUNK).alias("chunk"), "at", "doc_id", "size"))
    heads = placed.where(F.col("at") % CHUNK == 0).select("key", "chunk").join(known, "key")  # sources meet runs, not documents
    rated = placed.join(heads, ["key", "chunk"]).withColumn("rate", F.coalesce(_rate(most), F.lit(0.0)))
    made = rated.groupBy("key", "chunk").applyInPandas(_copies(most), "doc_id long, size long, source_size long, target double, rate double, copies int")
    return made.withColumn("taken", F.col("copies") * F.col("size"))
