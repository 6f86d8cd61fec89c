"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi-join; labels never pass through one task or the
driver. The frame that the loop ends with is a forest of depth one, so the number of steps is
logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _star(edges: DataFrame, mins: DataFrame) -> DataFrame:
    return edges.join(mins, "u")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) long edges to (id, component): the least id reachable, for every id in an edge that joins
    two different ids. Repeated edges, loops and nulls are allowed and change nothing; no edges, no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = scratch.save(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.save(_star(both, mins).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = _star(large, low)
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = scratch.save(small)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(mins, large, low, e)
        e = nxt
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
