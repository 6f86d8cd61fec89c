"""Global order without a global task: places and hash trees over range partitions, and exact draws by a splitting tree.

A table is dealt into range partitions, sorted and settled; what is global (where a partition starts, what lies below it) follows
from one row for each key and partition. No window, group or row ever holds all rows of a key.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import settled

#: Children of a node of the trees, and runs that are drawn for at once.
FAN, RUNS = 256, 128


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right on columns whose nulls are equal to each other; the columns once."""
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in on]
    found = left.alias("_l").join(right.alias("_r"), reduce(and_, same))
    return found.select(*[F.col(f"_l.{c}") for c in left.columns], *[F.col(f"_r.{c}") for c in right.columns if c not in on])


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df, settled, in range partitions by (by, order), with ``_cell``, the partition, and ``_at``, a number that rises in it."""
    keys = [*[F.col(c) for c in by], *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return settled(placed).withColumn("_cell", F.shiftright("_at", 33))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with ``name`` (0, 1, ... within ``by``, whose nulls are a value of their own) and ``total`` (rows of the value)."""
    cells = ranged(df, by, order)
    each = cells.groupBy(*by, "_cell").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumn("_start", before).withColumn("total", F.sum("_n").over(whole)).drop("_n")
    return null_safe(cells, starts, [*by, "_cell"]).withColumn(name, F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_cell", "_first", "_start")


def hash_tree(df: DataFrame, order: list[Column], leaf: Column, fan: int = 4096) -> str | None:
    """The root (hex) of a SHA-256 tree over the leaves (hex digests) in order: ``fan`` consecutive nodes become the digest of
    their digests, until one is left; the same whatever the partitions. Only nodes' counts and the root reach the driver."""
    rows = df.select(leaf.alias("_d"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    nodes = ranked(rows, [], [*[F.col(f"_o{i}") for i in range(len(order))], F.col("_d")], "_i").select("_i", "_d")
    while True:
        runs = nodes.groupBy(F.floor(F.col("_i") / fan).alias("_i")).agg(F.sort_array(F.collect_list(F.struct("_i", "_d"))).alias("_run"))
        nodes = settled(runs.select("_i", F.sha2(F.array_join(F.transform("_run", lambda x: x["_d"]), ""), 256).alias("_d")))
        n = nodes.count()
        if n <= 1:
            return nodes.first()["_d"] if n else None


# --- exact draws by a splitting tree ----------------------------------------------------------------------


def node_sums(df: DataFrame, node: Column, weights: list[str]) -> DataFrame:
    """_node and the sums of the weights, correctly rounded in any order."""
    schema = T.StructType([T.StructField("_node", T.LongType()), *[T.StructField(w, T.DoubleType()) for w in weights]])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"_node": pa.array([key[0].as_py()], pa.int64()), **{w: pa.array([math.fsum(t.column(w).to_pylist())], pa.float64()) for w in weights}})

    return df.select(node.cast("long").alias("_node"), *[F.col(w).cast("double").alias(w) for w in weights]).groupBy("_node").applyInArrow(add, schema)


def split_draws(nodes: DataFrame, weights: list[str], totals: list[int], runs: int, seed: int) -> DataFrame:
    """_run, _node and one column of counts a weight: for each of ``runs`` runs, totals[i] draws with replacement over all nodes
    in proportion to weights[i], multinomially exact. nodes: _node (0, 1, ...) and the weights. The draws of a node are
    split among its FAN children by a chain of binomials, one key (block of runs, node) each, from the root down; a node or
    run of no draws is left out. What is drawn depends on the seed and the nodes only."""
    spark = nodes.sparkSession
    levels = [settled(nodes)]
    top = levels[0].agg(F.max("_node")).first()[0]
    while top is not None and top >= FAN:
        levels.append(settled(node_sums(levels[-1], F.floor(F.col("_node") / FAN), weights)))
        top //= FAN
    schema = T.StructType([T.StructField("_run", T.LongType()), T.StructField("_node", T.LongType()), *[T.StructField(w, T.LongType()) for w in weights]])
    drawn = spark.range(runs).select(F.col("id").alias("_run"), F.lit(0).cast("long").alias("_node"), *[F.lit(t).cast("long").alias(w) for w, t in zip(weights, totals, strict=True)])
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((runs - 1) // RUNS).cast("long")))

    def splitter(height: int):
        def split(key: tuple, kids: pa.Table, some: pa.Table) -> pa.Table:
            up, block = (k.as_py() for k in key)
            order, at = np.argsort(kids.column("_node").to_numpy()), np.argsort(some.column("_run").to_numpy())
            run, node = some.column("_run").to_numpy()[at], kids.column("_node").to_numpy()[order]
            out = []
            for i, w in enumerate(weights):
                p, n = kids.column(w).to_numpy()[order], some.column(w).to_numpy()[at]
                rng = np.random.default_rng([seed % 2**63, height, up, block, i])
                out.append(rng.multinomial(n, p / p.sum()) if len(p) and p.sum() > 0 else np.zeros((len(n), len(p)), np.int64))
            r, c = np.nonzero(sum(out))
            return pa.table({"_run": pa.array(run[r], pa.int64()), "_node": pa.array(node[c], pa.int64()), **{w: pa.array(m[r, c], pa.int64()) for w, m in zip(weights, out, strict=True)}})

        return split

    for height in range(len(levels) - 1, -1, -1):
        kids = levels[height].select("*", F.floor(F.col("_node") / FAN).alias("_up"), blocks.alias("_block"))
        some = drawn.select("*", F.col("_node").alias("_up"), F.floor(F.col("_run") / RUNS).alias("_block"))
        drawn = kids.groupBy("_up", "_block").cogroup(some.groupBy("_up", "_block")).applyInArrow(splitter(height), schema)
    return drawn
