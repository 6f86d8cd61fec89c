"""Merkle manifest of a document table, reduced by superblocks.

Leaves are numbered in each language by ascending id. A superblock holds the FANOUT**LEVELS consecutive nodes below
one node LEVELS higher: grouped by (language, index div FANOUT**LEVELS), each collapses on its own to that node, and
every member keeps its lower proof, the siblings at each level to its left and right. The block roots are numbered by
their blocks already, so they are reduced the same way until one node a language is left; the languages' roots, in
order, are the leaves of one more such tree. Then proofs are joined from the top down: a node's proof is its own
lower proof followed by that of its block.

No group holds more than FANOUT**LEVELS nodes, whatever the share of a language; nothing but the number of nodes
still to reduce reaches the driver. Proofs are folded in the JVM.

Semantics: a null in any column is a field of its own (``-``). Null ids come first among the leaves of a language and are never
tampered with; rows of one id are ordered by their digests, and equal rows have equal leaves at places of their own.
A null language is one of its own, before all others. An empty text is a field of 0 bytes; texts are hashed whole. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, group_order

FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "key string, block long, at long, doc_id long, leaf binary, own binary, lefts array<binary>, rights array<binary>, root binary, total long"


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column | None = None) -> Column:
    """Lowercase hex SHA-256 of the fields of a row; ``text`` takes the place of the text."""
    return F.sha2(F.concat(*[_field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS]), 256)


def _climb(block: pd.DataFrame) -> pd.DataFrame:
    """LEVELS levels of one superblock: for each member the siblings on its path, and the node they lead to."""
    block = block.sort_values("at", kind="stable")
    nodes, total = list(block["digest"]), int(block["total"].iloc[0])
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    place = list(range(len(nodes)))
    for _ in range(LEVELS):
        if total <= 1:
            break
        beside = []
        for p in range(len(nodes)):
            first = p - p % FANOUT
            beside.append((b"".join(nodes[first:p]), b"".join(nodes[p + 1 : first + FANOUT])))
        for i, p in enumerate(place):
            lefts[i].append(beside[p][0])
            rights[i].append(beside[p][1])
        nodes = [hashlib.sha256(b"".join(nodes[a : a + FANOUT]).hex().encode()).digest() for a in range(0, len(nodes), FANOUT)]
        place = [p // FANOUT for p in place]
        total = -(-total // FANOUT)
    out = block[["key", "block", "at", "doc_id", "leaf", "own"]].copy()
    out["lefts"], out["rights"], out["root"], out["total"] = lefts, rights, nodes[0], total
    return out


def ascend(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The levels of superblocks over nodes (key, at, total, digest, doc_id, leaf, own), the last with one node a key."""
    levels = []
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("at") / FANOUT**LEVELS).cast("long"))
        levels.append(scratch.save(blocks.groupBy("key", "block").applyInPandas(_climb, _NODE)))
        most = levels[-1].agg(F.max("total")).first()[0]
        if most is None or most <= 1:
            return levels
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("leaf", "binary"), ("own", "binary"))]
        tops = levels[-1].groupBy("key", "block").agg(F.first("root").alias("digest"), F.first("total").alias("total"))
        nodes = tops.select("key", F.col("block").alias("at"), "total", "digest", *nothing)


def descend(levels: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """The lowest nodes with their whole proofs, root (of their key) and, given ``top`` (the tree over the keys' roots,
    whose ``own_key`` is the key), its proof behind their own and its root as ``above``. Keys meet ``top`` at the
    highest level, where one has a block of nodes at most."""
    path = levels[-1]
    if top is not None:
        path = path.join(top.select(F.col("own_key").alias("key"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"), F.col("root").alias("above")), "key")
        path = path.withColumn("lefts", F.concat("lefts", "_l")).withColumn("rights", F.concat("rights", "_r")).drop("_l", "_r")
    else:
        path = path.withColumn("above", F.lit(None).cast("binary"))
    for lower in reversed(levels[:-1]):
        upper = path.select("key", F.col("at").alias("block"), F.col("lefts").alias("_l"), F.col("rights").alias("_r"), F.col("root").alias("_root"), "above")
        path = lower.join(upper, ["key", "block"]).withColumn("lefts", F.concat("lefts", "_l")).withColumn("rights", F.concat("rights", "_r")).withColumn("root", F.col("_root")).drop("_l", "_r", "_root")
    return path


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root (binary) that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda acc, s: F.unhex(F.sha2(_hex(F.concat(s["l"], acc, s["r"])), 256)))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of a proof's siblings as hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda s: _hex(F.concat(s["l"], s["r"]))), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, claimed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, lefts, rights, own: the proof of every row, and the leaf that is to be checked
    against it: the row's own, or where ``tampered`` holds that of the row with the text ``claimed``."""
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = F.unhex(leaf_digest())
    own = leaf if tampered is None else F.when(tampered, F.unhex(leaf_digest(claimed))).otherwise(leaf)
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("lang").cast("string")))  # null before all, the rest by bytes
    leaves = scratch.save(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), own.alias("own")))
    placed = group_order(leaves, "key", ["doc_id", "leaf"], scratch)
    levels = ascend(placed.select("key", "at", "total", F.col("leaf").alias("digest"), "doc_id", "leaf", "own"), scratch)
    roots = scratch.save(levels[-1].groupBy(F.col("key").alias("own_key")).agg(F.first("root").alias("digest")).withColumn("key", F.lit("")))
    ordered = scratch.save(group_order(roots, "key", ["own_key"], scratch))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("leaf", "binary"), ("own", "binary"))]
    upper = descend(ascend(ordered.select("key", "at", "total", "digest", *nothing), scratch))
    top = scratch.save(upper.select("at", "lefts", "rights", "root").join(ordered.select("at", "own_key"), "at"))
    return descend(levels, top).select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("root")).alias("subroot"), _hex(F.col("above")).alias("root"), "lefts", "rights", "own")


def verify(proofs: DataFrame) -> DataFrame:
    """proofs with proof_sha256, folded_root and verified (whether it is the root)."""
    done = proofs.withColumn("proof_sha256", proof_digest(F.col("lefts"), F.col("rights"))).withColumn("folded_root", _hex(fold(F.col("own"), F.col("lefts"), F.col("rights"))))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
