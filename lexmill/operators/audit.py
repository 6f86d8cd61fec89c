"""Integrity audits: rule violations as rows, exact near-duplicate joins, and pre-flight checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical, shingles, strip
from ..session import give_back, settled, spread

SPLITS = ["train", "development", "calibration", "sealed_test"]
#: Rules in the order of their ranks.
RULES = {
    1: "duplicate_id", 2: "unknown_split", 3: "sealed_test_flags", 4: "sealed_elsewhere", 5: "lineage_crosses_splits", 6: "blank_text",
    7: "exact_duplicate", 8: "near_duplicate", 9: "missing_parent", 10: "parent_crosses_splits",
}


class AuditError(ValueError):
    pass


def _violation(rule: int, df: DataFrame, other: Column | None = None, other_split: Column | None = None, score: Column | None = None) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return df.select(
        F.lit(RULES[rule]).alias("rule"), F.lit(rule).alias("rule_rank"), F.col("ord").cast("long").alias("ord"), F.col("id"), (null("string") if other is None else other).alias("other_id"),
        F.col("split"), (null("string") if other_split is None else other_split).alias("other_split"), (null("double") if score is None else score).cast("double").alias("score"),
    )


#: Buckets of the frequency sketch by which shingles are ordered, and 64-bit words of the bitmaps that sets are compared by.
SKETCH, WORDS = 1 << 17, 8
#: Shingles that are worked on at once, one set at least.
SHINGLES = 1 << 17


def _hashed_sets(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """key and g, the 64-bit hashes of the distinct shingles of the canonical text."""
    return spread(df).select(*[c for c in df.columns if c != text], F.array_distinct(F.transform(shingles(canonical(F.col(text)), n), lambda x: F.xxhash64(x))).alias("g"))


def near_pairs(df: DataFrame, threshold: float = 0.85, across: bool = True, key: str = "id", text: str = "text", split: str = "split") -> DataFrame:
    """a, b, split_a, split_b, jaccard of all pairs (of different splits, if ``across``) whose 5-word shingles
    reach the threshold. Exact, by filters that lose none: sets are ordered rarest first (by a sketch of constant size, any common order will do),
    a pair that links shares one of the first n - ceil(t n) + 1 shingles, at the first of which enough of both sets is
    still to come; and as bitmaps of the parities of both sets differ in no more bits than the sets in shingles, pairs whose
    bitmaps differ too much are not looked at. Only prefixes are shuffled; survivors are checked on whole sets."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    sets = settled(_hashed_sets(df.select(F.col(key).alias("k"), F.col(split).alias("s"), F.col(text).alias("t")), "k", "t").where(F.size("g") > 0))
    often = np.zeros(SKETCH, np.int64)
    for b, n in sets.select(F.explode(F.transform("g", lambda x: F.pmod(x, F.lit(SKETCH)))).alias("b")).groupBy("b").count().collect():  # at most SKETCH rows
        often[b] = n

    def slices(batches):
        for batch in batches:
            off, a = batch.column(2).offsets.to_numpy().astype(np.int64), 0
            while a < batch.num_rows:
                z = max(a + 1, int(np.searchsorted(off, off[a] + SHINGLES, side="right")) - 1)
                yield batch.slice(a, z - a)
                a = z
            give_back()

    def prefixes(batches):
        for batch in slices(batches):
            row, left, size, hashes, maps = [], [], [], [], []
            for i, g in enumerate(batch.column(2)):
                h = g.values.to_numpy()
                count = often[h % SKETCH]
                first = np.lexsort((h, count))[: len(h) - math.ceil(len(h) * threshold - 1e-9) + 1]
                live = count[first] > 1  # others are in this set alone
                at = np.flatnonzero(live)
                bits = np.bincount((h % (64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
                row.append(np.full(len(at), i))
                left.append(len(h) - at)
                size.append(np.full(len(at), len(h)))
                hashes.append(h[first][live])
                maps.append(np.repeat(np.packbits(bits.astype(np.uint8)).view("<i8")[None, :], len(at), axis=0))
            if row:
                m = np.concatenate(maps)
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(left)), pa.array(np.concatenate(size)), pa.array(np.concatenate(hashes)), *[pa.array(np.ascontiguousarray(m[:, w])) for w in range(WORDS)]],
                    names=["k", "s", "left", "n", "h", *[f"m{w}" for w in range(WORDS)]],
                )

    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    heads = sets.select("k", "s", "g").mapInArrow(prefixes, f"k {kinds['k']}, s {kinds['s']}, left long, n long, h long, " + ", ".join(f"m{w} long" for w in range(WORDS)))
    a, b = heads.alias("a"), heads.alias("b")
    needed = (F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - 1e-6  # shared shingles of a pair that links
    apart = sum((F.bit_count(F.col(f"a.m{w}").bitwiseXOR(F.col(f"b.m{w}"))) for w in range(1, WORDS)), F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))))
    pairs = a.join(b, "h").where((F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(threshold) - 1e-9) & (F.least("a.left", "b.left") >= needed) & ((F.col("a.n") + F.col("b.n") - apart) / 2 >= needed))
    if across:
        pairs = pairs.where(F.col("a.s") != F.col("b.s"))
    pairs = pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    side = lambda n: sets.select(F.col("k").alias(n), F.col("s").alias(f"split_{n}"), F.col("g").alias(f"g_{n}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("g_a", "g_b"))
    score = both / (F.size("g_a") + F.size("g_b") - both)
    return whole.select("a", "b", "split_a", "split_b", score.alias("jaccard")).where(F.col("jaccard") >= threshold)


def exact_pairs(df: DataFrame, key: str = "id", text: str = "text", split: str = "split") -> DataFrame:
    """Rows whose canonical text occurs in more than one split, with the first row of that text (by ord)."""
    d = spread(df).withColumn("_c", F.sha2(canonical(F.col(text)), 256))
    groups = d.groupBy("_c").agg(F.min_by(F.struct(F.col(key).alias("id"), F.col(split).alias("split")), "ord").alias("first"), F.count_distinct(split).alias("_n")).where("_n > 1")
    return d.join(groups.drop("_n"), "_c").where(F.col(split) != F.col("first.split"))


def contamination(corpus: DataFrame, benchmark: DataFrame, key: str, item: str, text: str = "text", n: int = 5, most: int = 1 << 20) -> DataFrame:
    """key, item, shared: distinct word shingles that a document shares with a benchmark item. A benchmark of at most ``most``
    shingles goes to the documents, which then are not shuffled before their shingles are counted; a larger one is joined by hash."""
    s = lambda df, k: _hashed_sets(df.select(F.col(k).alias(k), F.col(text).alias("t")), k, "t", n).select(k, F.explode("g").alias("h"))
    items = settled(s(benchmark, item))
    found = s(corpus, key).join(F.broadcast(items) if items.count() <= most else items, "h")  # 16 bytes a shingle
    return found.groupBy(key, item).agg(F.count("*").alias("shared"))


def lineage_overlap(df: DataFrame, lineage: str = "lineage_id", role: str = "split") -> DataFrame:
    """Lineages that occur in more than one role, with their roles."""
    return df.groupBy(lineage).agg(F.sort_array(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)


def parents(df: DataFrame) -> DataFrame:
    """Children with the split of their parent, null if there is none."""
    p = df.select(F.col("id").alias("_p"), F.col("split").alias("parent_split")).dropDuplicates(["_p"])
    return df.where("parent_id is not null").join(p, F.col("parent_id") == F.col("_p"), "left").drop("_p")


def violations(df: DataFrame, threshold: float = 0.85, near: bool = True) -> DataFrame:
    """All violations of the ten rules as rows. df: canonical records with an input ordinal ``ord``. What is null keeps no rule:
    a null split is unknown, a null flag is the wrong one, and a null text is blank."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    first_id = df.groupBy("id").agg(F.min("ord").alias("_o"), F.count("*").alias("_n")).where("_n > 1")
    first_split = df.groupBy("lineage_id").agg(F.min_by(F.struct("id", "split"), "ord").alias("_f"), F.count_distinct("split").alias("_n")).where("_n > 1")
    sealed = F.coalesce(F.col("split") == "sealed_test", F.lit(False))
    lineage = df.join(first_split, "lineage_id").where(F.col("split") != F.col("_f.split"))
    exact = exact_pairs(df)
    child = parents(df)
    out = [
        _violation(1, df.join(first_id, "id").where("ord > _o"), F.col("id")),
        _violation(2, df.where(~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)))),
        _violation(3, df.where(sealed & ~F.coalesce(F.col("sealed") & ~F.col("train_eligible"), F.lit(False)))),
        _violation(4, df.where(~sealed & F.coalesce("sealed", F.lit(True)))),
        _violation(5, lineage, F.col("_f.id"), F.col("_f.split")),
        _violation(6, df.where(strip(F.col("text")) == "")),
        _violation(7, exact, F.col("first.id"), F.col("first.split")),
        _violation(9, child.where("parent_split is null"), F.col("parent_id")),
        _violation(10, child.where("parent_split <> split"), F.col("parent_id"), F.col("parent_split")),
    ]
    if near:
        pairs = near_pairs(df, threshold)
        o = df.select(F.col("id"), F.col("ord")).groupBy("id").agg(F.min("ord").alias("ord"))
        late = pairs.join(o.select(F.col("id").alias("a"), F.col("ord").alias("oa")), "a").join(o.select(F.col("id").alias("b"), F.col("ord").alias("ob")), "b")
        swap = F.col("oa") > F.col("ob")
        pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
        flat = late.select(pick("a", "b").alias("id"), pick("b", "a").alias("_other"), pick("split_a", "split_b").alias("split"), pick("split_b", "split_a").alias("_os"), pick("oa", "ob").alias("ord"), "jaccard")
        out.append(_violation(8, flat, F.col("_other"), F.col("_os"), F.col("jaccard")))
    result = out[0]
    for v in out[1:]:
        result = result.unionByName(v)
    return result


def first_violation(found: DataFrame):
    """The violation that a row-by-row audit would stop at: by phase (parents last), then row, then rule."""
    phase = F.when(F.col("rule_rank") >= 9, 1).otherwise(0)
    return found.orderBy(phase, "ord", "rule_rank", "other_id").first()


def audit(df: DataFrame, threshold: float = 0.85) -> dict[str, int]:
    """Counts by split; raises AuditError at the first violation. Cheap rules run before the near-duplicate join."""
    for near in (False, True):
        v = first_violation(violations(df, threshold, near))
        if v is not None:
            raise AuditError(f"{v['rule']}: {v['id']} ({v['split']})" + (f" and {v['other_id']} ({v['other_split']})" if v["other_id"] else ""))
    return {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).orderBy("split").collect()}


def audit_boundaries(df: DataFrame, threshold: float = 0.85) -> int:
    """Blank, exact and near duplicates across splits only; the number of rows checked."""
    if df.where(strip(F.col("text")) == "").limit(1).count():
        raise AuditError("blank_text")
    if exact_pairs(df).limit(1).count():
        raise AuditError("exact_duplicate")
    if near_pairs(df, threshold).limit(1).count():
        raise AuditError("near_duplicate")
    return df.count()


def preflight(df: DataFrame, required_positive: list[str], provenance: str = "provenance") -> dict:
    """Checks of role inputs: no lineage in two roles, both labels in every evaluation role, and every required
    positive provenance in it. Raises on the first that fails; else counts by role."""
    cross = lineage_overlap(df).limit(1).collect()
    if cross:
        raise AuditError(f"lineage crosses roles: {cross[0][0]}")
    seen = df.groupBy("split").agg(F.collect_set("label").alias("labels"), F.collect_set(F.when(F.col("label") == 1, F.col(provenance))).alias("positive"), F.count("*").alias("n")).collect()
    for r in seen:
        if r["split"] != "train" and set(r["labels"]) != {0, 1}:
            raise AuditError(f"{r['split']} lacks a label")
        missing = set(required_positive) - set(r["positive"])
        if missing:
            raise AuditError(f"{r['split']} lacks positive provenances: {sorted(missing)}")
    return {r["split"]: r["n"] for r in seen}
