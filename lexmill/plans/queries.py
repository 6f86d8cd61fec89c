"""Every operator as a query over the corpus tables, with the SQL an independent engine checks it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numeric, text as tx
from ..functions.stylometry import FUNCTION_WORDS, NAMES, PER_100
from ..operators import audit, calibrate, evaluate, features, models, records, sampling
from ..session import broadcast_up_to, shared_folder, written
from ..sources import adapters, files
from ..streaming.argmin import BestRowStore, source_revision
from .fixtures import CONV_SQL, CORPUS_SQL, LABELLED_SQL, PROMPTS_SQL, SCORED_SQL, SEED, UNIT, canon_sql, conversations, corpus, labelled, prompts, scored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _round(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to six places, for comparison across engines."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# --- records and text ------------------------------------------------------------------------------


@query(f"WITH {LABELLED_SQL} SELECT id, id AS lineage_id, replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, sha256(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256, label, source, domain, provenance, CASE WHEN label = 0 THEN 'human' ELSE 'unknown' END AS generator_family, 'none' AS editor_family, 'none' AS transformation_family, 'train' AS split, false AS sealed, true AS train_eligible FROM labelled")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.records(labelled(spark, sf_dir), lineage_id=F.col("id"), split="train", generator_family=F.when(F.col("label") == 0, "human").otherwise("unknown"))
    return df.drop("parent_id", "source_fields")


@query("SELECT doc_id, replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS normalized FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {canon_sql()} AS canonical FROM documents")
def text_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.canonical(F.col("text")).alias("canonical"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_sha256"))


@query("SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS stripped FROM conversations")
def text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip(F.col("text")).alias("stripped"))


_SHINGLES = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"


@query(f"WITH c AS (SELECT doc_id, string_split({canon_sql()}, ' ') AS w FROM documents) SELECT doc_id, len({_SHINGLES})::INT AS n_shingles FROM c")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.shingles(tx.canonical(F.col("text")))).alias("n_shingles"))


@query(f"WITH c AS (SELECT conv_id, turn, string_split({canon_sql()}, ' ') AS w FROM conversations), s AS (SELECT conv_id, turn, {_SHINGLES} AS g FROM c) SELECT a.conv_id, a.turn, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS jaccard FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def turn_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.shingles(tx.canonical(F.col("text"))).alias("g"))
    b = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return _round(s.join(b, ["conv_id", "turn"]).select("conv_id", "turn", tx.jaccard(F.col("g"), F.col("h")).alias("jaccard")))


@query("SELECT count(*) AS input_rows, count(*) FILTER (trim(text) = '') AS blank_rows, count(text) - count(DISTINCT text) AS duplicate_rows, count(*) FILTER (quality = 0) AS human_rows, count(*) FILTER (quality = 1) AS ai_rows FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def prepare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.prepare_report(labelled(spark, sf_dir))


# --- dedup, sampling, splits --------------------------------------------------------------------------


def _rank_sql(key: str) -> str:
    return f"sha256('{SEED}:' || {key})"


@query(f"SELECT min(doc_id) AS doc_id, {canon_sql()} AS canonical FROM documents WHERE {canon_sql()} <> '' GROUP BY 2")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.canonical(F.col("text")).alias("canonical")).where("canonical <> ''")
    return sampling.first_wins(d, F.col("canonical"), "doc_id")


@query(f"WITH {LABELLED_SQL} SELECT id, label FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_rank_sql('id')}, id) <= 8")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balanced_sample(labelled(spark, sf_dir).select("id", "label"), 8, SEED)


_SPLIT = "CASE WHEN r <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN '{0}' WHEN r <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) + greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN '{1}' ELSE '{2}' END"


@query(f"WITH {LABELLED_SQL}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_rank_sql('id')}, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM labelled) SELECT id, label, {_SPLIT.format('test', 'validation', 'train')} AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(labelled(spark, sf_dir).select("id", "label"), SEED)


@query(f"WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY {_rank_sql('conv_id')}, conv_id) AS r, count(*) OVER () AS n FROM g), s AS (SELECT conv_id, {_SPLIT.format('calibration', 'development', 'train')} AS split FROM r) SELECT c.conv_id, turn, split FROM conversations c JOIN s ON c.conv_id = s.conv_id")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_split(table(spark, sf_dir, "conversations").select("conv_id", "turn"), SEED, "conv_id", 0.15, 0.15, ("calibration", "development", "train"))


@query(f"WITH f AS (SELECT DISTINCT conv_id FROM conversations ORDER BY {_rank_sql('conv_id')}, conv_id LIMIT 25) SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (FROM f)")
def top_k_family_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.family_sample(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 25, SEED, "conv_id")


@query(f"WITH {LABELLED_SQL}, c AS (SELECT id, sha256(text) AS h FROM labelled WHERE label = 0) SELECT 'doc:' || doc_id AS id FROM documents WHERE 'doc:' || doc_id NOT IN (SELECT id FROM c) AND sha256(text) NOT IN (SELECT h FROM c)")
def unused_rows_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), tx.text_hash(F.col("text")).alias("text_sha256"))
    control = labelled(spark, sf_dir).where("label = 0").select("id", tx.text_hash(F.col("text")).alias("text_sha256"))
    return sampling.unused_rows(d, control).select("id")


@query(f"WITH {LABELLED_SQL} SELECT id, source, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY source, label), 9) AS weight FROM labelled")
def source_label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.source_label_weights(labelled(spark, sf_dir).select("id", "source", "label"))
    return d.select("id", "source", "label", F.round("weight", 9).alias("weight"))


#: The mix of machine-text strata in each curriculum step.
CURRICULUM = [
    {"expert_edited_ai": 0.25, "llm_edited_ai": 0.50, "raw_ai": 0.25},
    {"expert_edited_ai": 0.40, "llm_edited_ai": 0.35, "raw_ai": 0.25},
    {"expert_edited_ai": 0.50, "llm_edited_ai": 0.30, "raw_ai": 0.20},
]


@query(f"WITH {CONV_SQL}, m AS (SELECT * FROM (VALUES ('human', 0.5::DOUBLE), ('raw_ai', 0.25::DOUBLE), ('llm_edit', 0.25::DOUBLE)) t(s, mass)), l AS (SELECT provenance AS s, count(DISTINCT group_id) AS n FROM conv GROUP BY 1) SELECT group_id, ord, provenance AS stratum, round(mass / l.n / count(*) OVER (PARTITION BY provenance, group_id), 9) AS weight FROM conv JOIN m ON m.s = provenance JOIN l ON l.s = provenance")
def hierarchical_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.hierarchical_weights(conversations(spark, sf_dir), {"human": 0.5, "raw_ai": 0.25, "llm_edit": 0.25}, F.col("provenance"), "group_id")
    return d.select("group_id", "ord", "stratum", F.round("weight", 9).alias("weight"))


_STRATUM = "CASE provenance WHEN 'human' THEN 'expert_edited_ai' WHEN 'raw_ai' THEN 'raw_ai' ELSE 'llm_edited_ai' END"
_MIX_SQL = ", ".join(f"({e}, '{k}', {v}::DOUBLE)" for e in range(1, 5) for k, v in CURRICULUM[min(e, 3) - 1].items())


@query(f"WITH {CONV_SQL}, m(epoch, s, mass) AS (VALUES {_MIX_SQL}), c AS (SELECT group_id, {_STRATUM} AS s FROM conv), l AS (SELECT s, count(DISTINCT group_id) AS n, count(*) AS rows FROM c GROUP BY s), w AS (SELECT epoch, c.s, mass / l.n / count(*) OVER (PARTITION BY epoch, c.s, group_id) AS w FROM c JOIN l USING (s) JOIN m ON m.s = c.s) SELECT epoch::INT AS epoch, s AS stratum, count(*) AS n, round(sum(w), 6) AS mass, round(max(w), 9) AS heaviest FROM w GROUP BY epoch, s")
def curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mass and heaviest row of each stratum of the conversations in each epoch of the curriculum."""
    c, out = conversations(spark, sf_dir), None
    for epoch in range(1, 5):
        w = sampling.hierarchical_weights(c, sampling.curriculum_mix(epoch, CURRICULUM), F.expr(_STRATUM), "group_id")
        n = w.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("mass"), F.round(F.max("weight"), 9).alias("heaviest")).withColumn("epoch", F.lit(epoch))
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {LABELLED_SQL} SELECT id, row_number() OVER (ORDER BY {_rank_sql('id')}, id)::INT AS position FROM labelled")
def deterministic_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).select("id").withColumn("_one", F.lit(1))
    return sampling.numbered(d, [sampling.hash_rank(SEED, F.col("id")), F.col("id")], ["_one"]).select("id", F.col("rank").cast("int").alias("position"))


@query()
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_draw(sampling.source_label_weights(labelled(spark, sf_dir)), 1000, SEED)


# --- groups, parents, pairs -------------------------------------------------------------------------------


@query(f"WITH {PROMPTS_SQL} SELECT group_id, text, label, variant, provenance, ordinal FROM variants")
def variant_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.edit_variants(prompts(spark, sf_dir))


@query(f"WITH {PROMPTS_SQL}, r AS (SELECT *, 'beemo:' || group_id || ':' || variant || ':' || ordinal AS id FROM variants) SELECT id, 'beemo:' || group_id AS lineage_id, label, provenance, CASE WHEN provenance IN ('expert_edited_ai', 'llm_edited_ai') THEN min(id) FILTER (provenance = 'raw_ai') OVER (PARTITION BY group_id) END AS parent_id FROM r")
def parent_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.edit_records(adapters.edit_variants(prompts(spark, sf_dir)), F.lit("train")).select("id", "lineage_id", "label", "provenance", "parent_id")


@query(f"WITH {LABELLED_SQL} SELECT 'gradtex:' || (row_number() OVER (ORDER BY ord) - 1) AS id, 1 - label AS label, source AS scenario, CASE WHEN ord % 3 = 0 THEN 'human' ELSE 'model' || ord % 3 END AS generator_model FROM labelled WHERE domain = 'en'")
def label_remap_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).select(
        "ord", "text", F.col("label").alias("binary_label"), F.when(F.col("domain") == "en", "C").otherwise("A").alias("test_split"), F.col("source").alias("scenario"), F.col("domain").alias("scenario_family"),
        F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit("model"), (F.col("ord") % 3).cast("string"))).alias("generator_model"),
    )
    return adapters.external_rows(d, "ord").select("id", "label", "scenario", "generator_model")


def _raid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    model = F.when(F.col("event_id") % 3 == 0, "human").otherwise(F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")))
    attack = F.when(F.col("event_id") % 2 == 0, "none").otherwise("paraphrase")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_id"), F.lit("").alias("adv_source_id"), model.alias("model"), attack.alias("attack"),
        F.col("event_type").alias("domain"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("generation"),
    )


_RAID_SQL = "raid AS (SELECT event_id::VARCHAR AS id, 'f' || user_id AS source_id, CASE WHEN event_id % 3 = 0 THEN 'human' ELSE 'm' || event_id % 5 END AS model, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'paraphrase' END AS attack, event_type AS domain FROM events), ok AS (SELECT *, CASE WHEN model = 'human' THEN 'human' ELSE 'paraphrase' END AS role FROM raid WHERE (model = 'human' AND attack = 'none') OR (model <> 'human' AND attack = 'paraphrase')), best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source_id, role ORDER BY CASE WHEN role = 'human' THEN '' ELSE model END, id) = 1)"


@query(f"WITH {_RAID_SQL} SELECT source_id, role, id, model FROM best")
def argmin_pair_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.best_candidates(_raid(spark, sf_dir)).select("source_id", "role", "row.id", "row.model")


@query(f"WITH {_RAID_SQL} SELECT 'raid:' || id AS id, 'raid:' || source_id AS lineage_id, CASE WHEN role = 'human' THEN 0 ELSE 1 END AS label, model AS generator_family, CASE WHEN role <> 'human' THEN 'raid:' || max(id) FILTER (role = 'human') OVER (PARTITION BY source_id) END AS parent_id FROM best WHERE source_id IN (SELECT source_id FROM best GROUP BY 1 HAVING count(*) = 2)")
def pair_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.family_pairs(adapters.best_candidates(_raid(spark, sf_dir))).select("id", "lineage_id", "label", "generator_family", "parent_id")


# --- audits ---------------------------------------------------------------------------------------------------


def _audit(rule: int, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.violations(corpus(spark, sf_dir), near=False).where(F.col("rule_rank") == rule).select(*columns)

    return run


_AUDITS = {
    "audit_duplicate_id": (1, ["ord", "id"], "SELECT ord, id FROM corpus QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) > 1"),
    "audit_unknown_split": (2, ["id", "split"], "SELECT id, split FROM corpus WHERE split = 'other'"),
    "audit_sealed_flags": (3, ["id"], "SELECT id FROM corpus WHERE split = 'sealed_test' AND (NOT sealed OR train_eligible)"),
    "audit_sealed_elsewhere": (4, ["id", "split"], "SELECT id, split FROM corpus WHERE split <> 'sealed_test' AND sealed"),
    "audit_lineage_cross": (5, ["ord", "id", "other_split"], "SELECT ord, id, f AS other_split FROM (SELECT *, first_value(split) OVER (PARTITION BY lineage_id ORDER BY ord) AS f FROM corpus) WHERE split <> f"),
    "audit_blank": (6, ["id"], "SELECT id FROM corpus WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = ''"),
    "audit_exact_dup": (7, ["ord", "id", "other_id", "other_split"], f"SELECT ord, id, fi AS other_id, f AS other_split FROM (SELECT *, first_value(split) OVER w AS f, first_value(id) OVER w AS fi FROM corpus WINDOW w AS (PARTITION BY {canon_sql()} ORDER BY ord)) WHERE split <> f"),
    "audit_parent": (9, ["ord", "id", "other_id"], "SELECT ord, id, parent_id AS other_id FROM corpus WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM corpus)"),
}
for _name, (_rule, _columns, _sql) in _AUDITS.items():
    QUERIES[_name] = _audit(_rule, *_columns)
    ORACLE[_name] = f"WITH {CORPUS_SQL} {_sql}"


@query(f"WITH {CORPUS_SQL}, p AS (SELECT id, min(split) AS ps FROM corpus GROUP BY id) SELECT c.ord, c.id, c.split <> p.ps AS crosses FROM corpus c JOIN p ON c.parent_id = p.id WHERE p.id NOT IN (SELECT id FROM corpus GROUP BY id HAVING count(DISTINCT split) > 1)")
def audit_parent_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    unclear = c.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("id").alias("parent_id"))
    return audit.parents(c).join(unclear, "parent_id", "left_anti").where("parent_split is not null").select("ord", "id", (F.col("split") != F.col("parent_split")).alias("crosses"))


_NEAR_SQL = f"""c AS (SELECT doc_id, split, string_split({canon_sql()}, ' ') AS w FROM nd), g AS (SELECT doc_id, split, {_SHINGLES} AS g FROM c),
 s AS (SELECT doc_id, split, len(g) AS n, unnest(g) AS x FROM g), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND a.split <> b.split GROUP BY ALL)"""


@query(f"WITH {CORPUS_SQL}, nd AS (SELECT ord AS doc_id, split, text FROM corpus WHERE trim(text, chr(32) || chr(10)) <> ''), {_NEAR_SQL} SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM p WHERE c / (na + nb - c)::DOUBLE >= 0.85")
def audit_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(audit.near_pairs(corpus(spark, sf_dir), 0.85, key="ord").select("a", "b", "jaccard"))


@query(f"WITH {CORPUS_SQL} SELECT split, count(*) AS n FROM corpus GROUP BY split")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.split_counts(corpus(spark, sf_dir))


@query(f"WITH {CORPUS_SQL} SELECT lineage_id, list_sort(list_distinct(list(split))) AS roles FROM corpus GROUP BY 1 HAVING count(DISTINCT split) > 1")
def lineage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lineage_overlap(corpus(spark, sf_dir))


@query(f"WITH c AS (SELECT 'd' || doc_id AS k, string_split({canon_sql()}, ' ') AS w FROM documents UNION ALL SELECT 'b' || item_id, string_split({canon_sql()}, ' ') FROM benchmark), s AS (SELECT k, unnest({_SHINGLES}) AS x FROM c) SELECT substr(a.k, 2)::BIGINT AS doc_id, substr(b.k, 2)::BIGINT AS item_id, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.k[1] = 'd' AND b.k[1] = 'b' GROUP BY ALL")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"WITH {CORPUS_SQL} SELECT split, source, count(corpus.ord) AS n FROM (SELECT DISTINCT split FROM corpus) CROSS JOIN (SELECT DISTINCT source FROM corpus) LEFT JOIN corpus USING (split, source) GROUP BY split, source")
def split_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    sources = sorted(r[0] for r in d.select("source").distinct().collect())  # columns of the report
    wide = records.split_source_counts(d, sources)
    return wide.select("split", F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"`{s}`").cast("long").alias("n")) for s in sources])))


@query(f"WITH {CORPUS_SQL} SELECT split, count(*) AS n, count(DISTINCT lineage_id) FILTER (source = 'src0') AS groups FROM corpus GROUP BY split")
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.assembly_report(corpus(spark, sf_dir), "src0")


@query(f"WITH {CORPUS_SQL} SELECT ord, id, lineage_id, source, split, sealed, train_eligible, parent_id FROM corpus")
def metadata_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.public_rows(corpus(spark, sf_dir))


@query(f"""WITH {CORPUS_SQL}, leaves AS (SELECT id, sha256('{{"id":"' || id || '","lineage_id":"' || lineage_id || '","ord":' || ord || ',"split":"' || split || '"}}') AS d FROM corpus),
placed AS (SELECT d, row_number() OVER (ORDER BY id, d) - 1 AS i FROM leaves), runs AS (SELECT i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM placed GROUP BY 1)
SELECT (SELECT count(*) FROM leaves) AS records, CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS record_digest FROM runs""")
def record_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the hash tree over the rows in the order of their ids."""
    d = corpus(spark, sf_dir).select("split", "ord", "id", "lineage_id")
    return d.agg(F.count("*").alias("records")).withColumn("record_digest", F.lit(records.table_digest(d, ["id"])))


# --- metrics ----------------------------------------------------------------------------------------------------


def _metrics_sql(by: str, rows: str = "scored", threshold: str = "0.5") -> str:
    """Ranking metrics by windows over distinct scores, the rest by filters; by: comma-separated columns."""
    return f"""s AS (SELECT {by}, p, sum(label)::DOUBLE AS tp, sum(1 - label)::DOUBLE AS fp FROM {rows} GROUP BY {by}, p),
c AS (SELECT *, sum(tp) OVER d AS ctp, sum(fp) OVER d AS cfp, sum(tp) OVER (PARTITION BY {by}) AS pos, sum(fp) OVER (PARTITION BY {by}) AS neg,
  lead(tp) OVER (PARTITION BY {by} ORDER BY p DESC) AS ntp, lead(fp) OVER (PARTITION BY {by} ORDER BY p DESC) AS nfp, row_number() OVER (PARTITION BY {by} ORDER BY p DESC) AS rn
  FROM s WINDOW d AS (PARTITION BY {by} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT {by}, CASE WHEN min(pos) > 0 AND min(neg) > 0 THEN sum(fp * (ctp - tp / 2) / (pos * neg)) END AS roc_auc,
  CASE WHEN min(pos) > 0 AND min(neg) > 0 THEN sum(tp / pos * ctp / (ctp + cfp)) END AS pr_auc,
  CASE WHEN min(pos) > 0 AND min(neg) > 0 THEN coalesce(max(ctp / pos) FILTER (cfp / neg <= 0.01 AND (ntp IS NULL OR rn = 1 OR ntp <> tp OR nfp <> fp)), 0) END AS tpr_at_1pct_fpr,
  CASE WHEN min(pos) > 0 AND min(neg) > 0 THEN 0.5 * (1 + (sum(CASE WHEN (cfp - fp) / neg >= 0.05 THEN 0 WHEN cfp / neg <= 0.05 THEN fp / neg * (2 * ctp - tp) / pos / 2
    ELSE (0.05 - (cfp - fp) / neg) * (2 * (ctp - tp) / pos + tp / pos * (0.05 - (cfp - fp) / neg) / (fp / neg)) / 2 END) - 0.00125) / 0.04875) END AS partial_auc
  FROM c GROUP BY {by}),
m AS (SELECT {by}, count(*) AS n, avg(CASE WHEN (p >= {threshold}) = (label = 1) THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy,
  count(*) FILTER (p >= {threshold} AND label = 1)::DOUBLE AS t, count(*) FILTER (p >= {threshold})::DOUBLE AS k, sum(label)::DOUBLE AS y,
  CASE WHEN count(*) FILTER (label = 0) > 0 THEN count(*) FILTER (p >= {threshold} AND label = 0)::DOUBLE / count(*) FILTER (label = 0) END AS human_fpr, avg((p - label) ** 2) AS brier
  FROM {rows} GROUP BY {by}),
b AS (SELECT {by}, least(floor(p * 10), 9) AS bin, count(*)::DOUBLE AS bn, avg(p) AS bp, avg(label) AS byy FROM {rows} GROUP BY ALL),
e AS (SELECT {by}, sum(bn * abs(bp - byy)) / sum(bn) AS ece FROM b GROUP BY {by})"""


_METRIC_COLUMNS = "n, round(accuracy, 6) AS accuracy, round(CASE WHEN k = 0 THEN 0 ELSE t / k END, 6) AS \"precision\", round(CASE WHEN y = 0 THEN 0 ELSE t / y END, 6) AS recall, round(CASE WHEN k + y = 0 THEN 0 ELSE 2 * t / (k + y) END, 6) AS f1, round(human_fpr, 6) AS human_fpr, round(brier, 6) AS brier, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(tpr_at_1pct_fpr, 6) AS tpr_at_1pct_fpr, round(partial_auc, 6) AS partial_auc, round(ece, 6) AS ece"


@query(f"WITH {SCORED_SQL}, one AS (SELECT 1 AS z, * FROM scored), {_metrics_sql('z', 'one')} SELECT {_METRIC_COLUMNS} FROM m JOIN r USING (z) JOIN e USING (z)")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL}, {_metrics_sql('source')} SELECT source, {_METRIC_COLUMNS} FROM m JOIN r USING (source) JOIN e USING (source)")
def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(scored(spark, sf_dir), ["source"]))


@query(f"WITH {SCORED_SQL}, {_metrics_sql('source, domain')} SELECT source, domain, {_METRIC_COLUMNS} FROM m JOIN r USING (source, domain) JOIN e USING (source, domain)")
def metrics_by_source_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(scored(spark, sf_dir), ["source", "domain"]))


@query(f"WITH {SCORED_SQL}, sub AS (SELECT provenance AS subtype, * FROM scored WHERE label = 1 UNION ALL SELECT k.provenance, s.* FROM scored s, (SELECT DISTINCT provenance FROM scored WHERE label = 1) k WHERE label = 0), {_metrics_sql('subtype', 'sub')} SELECT subtype, {_METRIC_COLUMNS} FROM m JOIN r USING (subtype) JOIN e USING (subtype)")
def subtype_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(evaluate.subtype_frame(scored(spark, sf_dir)), ["subtype"]))


@query(f"WITH {SCORED_SQL}, sub AS (SELECT provenance AS subtype, * FROM scored WHERE label = 1 UNION ALL SELECT k.provenance, s.* FROM scored s, (SELECT DISTINCT provenance FROM scored WHERE label = 1) k WHERE label = 0), {_metrics_sql('subtype', 'sub')} SELECT round(avg(roc_auc), 6) AS macro_auc, round(avg(partial_auc), 6) AS macro_partial_auc FROM r")
def macro_subtype_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = evaluate.cumulative(evaluate.subtype_frame(scored(spark, sf_dir)), ["subtype"])
    return _round(evaluate.ranking(frame, ["subtype"]).agg(F.avg("roc_auc").alias("macro_auc"), F.avg("partial_auc").alias("macro_partial_auc")))


@query(f"""WITH {SCORED_SQL}, sub AS (SELECT k.subtype, s.* FROM scored s, (VALUES ('expert_edit'), ('raw_ai')) k(subtype) WHERE label = 0 OR provenance = k.subtype), {_metrics_sql('subtype', 'sub')},
pts AS (SELECT subtype, ctp / pos AS tpr, cfp / neg AS fpr, neg, p AS cap FROM c WHERE cfp / neg <= 0.05 UNION ALL SELECT subtype, 0.0, 0.0, max(neg), 2.0 FROM c GROUP BY subtype),
best AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY subtype ORDER BY tpr DESC, fpr, cap) = 1)
SELECT subtype, {_METRIC_COLUMNS}, round(tpr, 6) AS tpr_at_cap, round(fpr, 6) AS fpr_at_cap, round(fpr * neg)::BIGINT AS false_positives FROM m JOIN r USING (subtype) JOIN e USING (subtype) JOIN best USING (subtype)""")
def development_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.subtype_report(scored(spark, sf_dir), ["expert_edit", "raw_ai"]).drop("threshold"))


@query(f"WITH {SCORED_SQL} SELECT count(*) FILTER (label = 0 AND p < 0.5) AS tn, count(*) FILTER (label = 0 AND p >= 0.5) AS fp, count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 1 AND p >= 0.5) AS tp FROM scored")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(scored(spark, sf_dir), []).select("tn", "fp", "fn", "tp")


@query(f"WITH {SCORED_SQL} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM scored GROUP BY 1")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.calibration_bins(scored(spark, sf_dir), []))


@query(f"WITH {SCORED_SQL}, one AS (SELECT 1 AS z, * FROM scored), {_metrics_sql('z', 'one')} SELECT round(cfp / neg, 6) AS fpr, round(ctp / pos, 6) AS tpr FROM c WHERE ntp IS NULL OR rn = 1 OR ntp <> tp OR nfp <> fp UNION ALL SELECT 0.0, 0.0")
def roc_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).withColumn("z", F.lit(1))
    return _round(evaluate.roc_points(evaluate.cumulative(d, ["z"]), ["z"]).select("fpr", "tpr"))


@query(f"WITH {SCORED_SQL}, {_metrics_sql('domain')} SELECT domain, round(partial_auc, 6) AS partial_auc FROM r")
def partial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.ranking(evaluate.cumulative(scored(spark, sf_dir), ["domain"]), ["domain"]).select("domain", "partial_auc"))


_POINTS_SQL = SCORED_SQL + """, s AS (SELECT p, sum(label)::DOUBLE AS tp, sum(1 - label)::DOUBLE AS fp FROM scored GROUP BY p),
c AS (SELECT p, sum(tp) OVER d / sum(tp) OVER () AS recall, sum(fp) OVER d / sum(fp) OVER () AS fpr FROM s WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT max(p) + 1e-9, 0, 0 FROM s),
points AS (SELECT cap AS max_fpr, p AS threshold, recall, fpr FROM c, (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) v(cap) WHERE fpr <= cap
  QUALIFY row_number() OVER (PARTITION BY cap ORDER BY recall DESC, fpr, p) = 1)"""


@query(f"WITH {_POINTS_SQL} SELECT max_fpr, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM points")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.best_thresholds(scored(spark, sf_dir), [0.01, 0.02, 0.05]))


@query(f"WITH {_POINTS_SQL} SELECT max_fpr, source, round(avg(CASE WHEN s.p >= threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS human_fpr FROM scored s, points WHERE label = 0 GROUP BY ALL")
def source_human_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    return _round(evaluate.source_fpr(d, evaluate.best_thresholds(d, [0.01, 0.02, 0.05])))


@query(f"WITH {_POINTS_SQL}, f AS (SELECT max_fpr, source, avg(CASE WHEN s.p >= threshold THEN 1.0::DOUBLE ELSE 0 END) AS h FROM scored s, points WHERE label = 0 GROUP BY ALL) SELECT max_fpr, round(max(h), 6) AS worst_fpr FROM f GROUP BY 1")
def worst_source_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    return _round(evaluate.source_fpr(d, evaluate.best_thresholds(d, [0.01, 0.02, 0.05])).groupBy("max_fpr").agg(F.max("human_fpr").alias("worst_fpr")))


@query(f"WITH {SCORED_SQL}, {_metrics_sql('domain', threshold='0.6')} SELECT domain, {_METRIC_COLUMNS} FROM m JOIN r USING (domain) JOIN e USING (domain)")
def threshold_external_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(scored(spark, sf_dir), ["domain"], 0.6))


@query(f"WITH lines AS (SELECT l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(({UNIT.format('l_orderkey || chr(58) || l_linenumber')} + CASE WHEN l_returnflag = 'R' THEN 0.6::DOUBLE ELSE 0 END) / 1.6::DOUBLE, 4) AS p FROM lineitem), {_metrics_sql('grp', 'lines')} SELECT grp, {_METRIC_COLUMNS} FROM m JOIN r USING (grp) JOIN e USING (grp)")
def binary_metrics_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    u = numeric.unit_hash(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), hit.alias("label"), F.round((u + F.when(hit == 1, 0.6).otherwise(0.0)) / 1.6, 4).alias("p"))
    return _round(evaluate.binary_metrics(d, ["grp"]))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scored outside 0 to 1 (prices, of either sign) and, in a second column, all scores bunched within a millionth over 0."""
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    p = F.col("l_extendedprice") - 30000 + 5000 * hit
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), hit.alias("label"), p.alias("p"), (F.pow(F.lit(2.0), F.lit(-40.0)) * (p + 40000)).alias("q"))


_WIDE_SQL = "lines AS (SELECT l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice - 30000 + 5000 * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS p0 FROM lineitem)"
_RANKING = "round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(tpr_at_1pct_fpr, 6) AS tpr_at_1pct_fpr, round(partial_auc, 6) AS partial_auc"


@query(f"WITH {_WIDE_SQL}, wide AS (SELECT *, p0 AS p FROM lines), {_metrics_sql('grp', 'wide')} SELECT grp, {_RANKING} FROM r")
def ranking_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.ranking(evaluate.cumulative(_wide(spark, sf_dir), ["grp"]), ["grp"]))


@query(f"WITH {_WIDE_SQL}, wide AS (SELECT *, (p0 + 40000) * 2.0::DOUBLE ** -40 AS p FROM lines), {_metrics_sql('grp', 'wide')} SELECT grp, {_RANKING} FROM r")
def ranking_bunched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.ranking(evaluate.cumulative(_wide(spark, sf_dir), ["grp"], score="q"), ["grp"]))


@query(f"""WITH {_WIDE_SQL}, s AS (SELECT p0 AS p, sum(label)::DOUBLE AS tp, sum(1 - label)::DOUBLE AS fp FROM lines GROUP BY 1),
c AS (SELECT p, sum(tp) OVER d / sum(tp) OVER () AS recall, sum(fp) OVER d / sum(fp) OVER () AS fpr FROM s WINDOW d AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT max(p) + 1e-9, 0, 0 FROM s),
points AS (SELECT cap AS max_fpr, p AS threshold, recall, fpr FROM c, (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) v(cap) WHERE fpr <= cap QUALIFY row_number() OVER (PARTITION BY cap ORDER BY recall DESC, fpr, p) = 1)
SELECT max_fpr, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM points""")
def operating_points_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.best_thresholds(_wide(spark, sf_dir), [0.0, 0.01, 0.05]))


@query(f"WITH {SCORED_SQL} SELECT id, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) AS logit, round(1 / (1 + exp(-p)), 6) AS sigmoid, round(label * 0.9::DOUBLE + 0.05, 6) AS smoothed FROM scored")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    return _round(d.select("id", numeric.logit(F.col("p")).alias("logit"), numeric.sigmoid(F.col("p")).alias("sigmoid"), numeric.smooth_label(F.col("label"), 0.1).alias("smoothed")))


@query(f"WITH {SCORED_SQL}, lb AS (SELECT *, least(floor(length(text) / 1000), 5)::INT AS bucket FROM scored), {_metrics_sql('bucket', 'lb')} SELECT bucket, {_METRIC_COLUMNS} FROM m JOIN r USING (bucket) JOIN e USING (bucket)")
def metrics_by_length_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).withColumn("bucket", F.least(F.floor(F.length("text") / 1000), F.lit(5)).cast("int"))
    return _round(evaluate.binary_metrics(d, ["bucket"]))


@query(f"WITH {SCORED_SQL}, d AS (SELECT *, doc_rank % 3 AS part FROM (SELECT *, ord AS doc_rank FROM scored)), {_metrics_sql('part', 'd')} SELECT round(a.roc_auc, 6) AS train_auc, round(b.roc_auc, 6) AS dev_auc, round(a.roc_auc - b.roc_auc, 6) AS auc_gap, n AS humans, round(1.0::DOUBLE / n, 6) AS fpr_resolution FROM r a, r b, (SELECT count(*) AS n FROM d WHERE part = 1 AND label = 0) WHERE a.part = 0 AND b.part = 1")
def fit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    train, dev = d.where("ord % 3 = 0"), d.where("ord % 3 = 1")
    humans = dev.where("label = 0").agg(F.count("*").alias("humans"))
    return _round(models.fit_gap(evaluate.binary_metrics(train), evaluate.binary_metrics(dev).join(F.broadcast(humans))))  # one row


#: A history of epochs from the corpus: the metrics of each sixth of the scored documents.
_HISTORY_SQL = f"""{SCORED_SQL}, ep AS (SELECT 1 + ord % 6 AS epoch, * FROM scored), {_metrics_sql("epoch", "ep")}, h AS (SELECT epoch, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(human_fpr, 6) AS human_fpr FROM r JOIN m USING (epoch))"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.binary_metrics(scored(spark, sf_dir).withColumn("epoch", 1 + F.col("ord") % 6), ["epoch"]))


@query(f"WITH {_HISTORY_SQL} SELECT epoch, roc_auc FROM h ORDER BY h.roc_auc DESC NULLS LAST, pr_auc DESC NULLS LAST, human_fpr NULLS LAST, epoch LIMIT 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir).withColumn("kept", -F.col("human_fpr"))
    return _round(evaluate.best_epoch(h, ["roc_auc", "pr_auc", "kept"]).select("epoch", "roc_auc"))


@query(f"WITH {_HISTORY_SQL}, hp AS (SELECT *, max(pr_auc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM h), i AS (SELECT epoch, prior IS NULL OR pr_auc > prior AS improved FROM hp), hs AS (SELECT epoch, epoch - max(epoch) FILTER (improved) OVER (ORDER BY epoch) AS since FROM i) SELECT epoch, since, epoch >= 3 AND since >= 2 AS stop FROM hs")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.early_stop(_history(spark, sf_dir), "pr_auc").select("epoch", "since", "stop")


@query(f"WITH {SCORED_SQL}, a AS (SELECT id, label FROM scored WHERE ord % 11 <> 0), b AS (SELECT id, CASE WHEN ord % 17 = 0 THEN 1 - label ELSE label END AS label FROM scored WHERE ord % 7 <> 0) SELECT id, CASE WHEN b.label IS NULL THEN 'missing' WHEN a.label IS NULL THEN 'foreign' ELSE 'label' END AS problem FROM a FULL JOIN b USING (id) WHERE a.label IS NULL OR b.label IS NULL OR a.label <> b.label")
def prediction_join_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir)
    left = d.where("ord % 11 <> 0").select("id", "label")
    right = d.where("ord % 7 <> 0").select("id", F.when(F.col("ord") % 17 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return calibrate.join_problems(right, left)


# --- features -----------------------------------------------------------------------------------------------------

_WORD = "[A-Za-z]+(?:''[A-Za-z]+)?"
_LEN = "list_transform({0}, lambda x: len(regexp_extract_all(x, '" + _WORD + "'))::DOUBLE)"
_STD = "CASE WHEN len({0}) < 2 THEN 0 ELSE list_aggregate({0}, 'stddev_pop') END"
_FUNC = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
_STYLE_SQL = f"""base AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) AS w,
  {_LEN.format("list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> '')")} AS s,
  {_LEN.format("list_filter(string_split_regex(text, chr(10) || '[ ' || chr(9) || chr(10) || chr(13) || ']*' || chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> '')")} AS pg,
  list_transform(range(0, greatest(length(text), 1), 128), lambda i: substring(text, i + 1, 128)) AS win FROM documents),
chars AS (SELECT doc_id, wi, c, count(*)::DOUBLE AS k FROM (SELECT doc_id, wi, unnest(string_split(t, '')) AS c FROM (SELECT doc_id, unnest(win) AS t, generate_subscripts(win, 1) AS wi FROM base)) GROUP BY ALL),
ent AS (SELECT doc_id, avg(e) AS em, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(e) END AS es FROM (SELECT doc_id, wi, -sum(k / t * log2(k / t)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id, wi) AS t FROM chars) GROUP BY ALL) GROUP BY 1),
hap AS (SELECT doc_id, count(*) FILTER (k = 1) AS h, count(*) AS types FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM base) GROUP BY ALL) GROUP BY 1),
style AS (SELECT b.doc_id, len(w)::DOUBLE AS word_count, len(s)::DOUBLE AS sentence_count, coalesce(list_avg(s), 0) AS sentence_length_mean, {_STD.format("s")} AS sentence_length_std,
  CASE WHEN {_STD.format("s")} = 0 THEN 0 ELSE list_avg(list_transform(s, lambda x: ((x - list_avg(s)) / list_aggregate(s, 'stddev_pop')) ** 3)) END AS sentence_length_skew,
  len(pg)::DOUBLE AS paragraph_count, {_STD.format("pg")} AS paragraph_length_std, coalesce(types, 0) / greatest(len(w), 1)::DOUBLE AS type_token_ratio, coalesce(h, 0) / greatest(len(w), 1)::DOUBLE AS hapax_rate,
  coalesce(list_avg(list_transform(w, lambda x: length(x)::DOUBLE)), 0) AS word_length_mean, CASE WHEN len(w) < 2 THEN 0 ELSE list_aggregate(list_transform(w, lambda x: length(x)::DOUBLE), 'stddev_pop') END AS word_length_std,
  1 - coalesce(types, 0) / greatest(len(w), 1)::DOUBLE AS repeated_token_rate, len(list_filter(w, lambda x: contains(x, ''''))) / greatest(len(w), 1)::DOUBLE AS contraction_rate,
  len(list_filter(w, lambda x: x IN ({_FUNC}))) / greatest(len(w), 1)::DOUBLE AS function_word_ratio,
  {", ".join(f"100.0::DOUBLE * (length(text) - length(replace(text, chr({ord(c)}), ''))) / greatest(len(w), 1) AS {n}" for n, c in PER_100.items())},
  em AS character_entropy_mean, es AS character_entropy_std FROM base b LEFT JOIN hap USING (doc_id) JOIN ent USING (doc_id))"""


def _style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stylometric_features(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {_STYLE_SQL} SELECT doc_id, {', '.join(f'round({n}, 5) AS {n}' for n in NAMES)} FROM style")
def stylometric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _style(spark, sf_dir).select("doc_id", *[F.round(n, 5).alias(n) for n in NAMES])


@query(f"WITH {_STYLE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 5) AS mean, round(CASE WHEN stddev_pop({n}) = 0 THEN 1 ELSE stddev_pop({n}) END, 5) AS scale FROM style" for n in NAMES))
def feature_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fit_normalizer(_style(spark, sf_dir)).select("feature", F.round("mean", 5).alias("mean"), F.round("scale", 5).alias("scale"))


@query(f"WITH {_STYLE_SQL} SELECT doc_id, {', '.join(f'round(({n} - avg({n}) OVER ()) / (CASE WHEN stddev_pop({n}) OVER () = 0 THEN 1 ELSE stddev_pop({n}) OVER () END), 4) AS {n}' for n in NAMES)} FROM style")
def feature_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = written(_style(spark, sf_dir))  # read twice, 23 numbers a text
    z = features.normalize_features(f, features.fit_normalizer(f))
    return z.select("doc_id", *[F.round(n, 4).alias(n) for n in NAMES])


_TFIDF = """tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w"""


@query(f"WITH x AS (SELECT item_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda v: length(v) > 1) AS w FROM benchmark), t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x), {_TFIDF}")
def word_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(features.tfidf(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), features.word_ngrams(F.col("text"))))


@query(f"WITH x AS (SELECT item_id AS id, unnest(list_filter(string_split_regex(lower(text), '[\\x09-\\x0D ]+'), lambda v: v <> '')) AS v FROM benchmark), y AS (SELECT id, ' ' || v || ' ' AS v FROM x), t AS (SELECT id, unnest(list_concat(CASE WHEN length(v) <= 3 THEN [v] ELSE list_transform(range(1, length(v) - 1), lambda i: substring(v, i, 3)) END, CASE WHEN length(v) >= 4 THEN list_transform(range(1, length(v) - 2), lambda i: substring(v, i, 4)) ELSE [] END, CASE WHEN length(v) >= 5 THEN list_transform(range(1, length(v) - 3), lambda i: substring(v, i, 5)) ELSE [] END)) AS term FROM y), {_TFIDF}")
def char_wb_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(features.tfidf(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), features.char_ngrams(F.col("text"))))


@query("WITH w AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \\n]+'), lambda x: length(x)::INT) AS i FROM documents), s AS (SELECT doc_id, i, greatest(len(i) - 16, 0) AS m FROM w), t AS (SELECT doc_id, i, unnest(list_distinct([0, m // 2, m])) AS a FROM s) SELECT doc_id, count(*)::INT AS n_windows, sum(list_sum(i[a + 1:a + 16]))::BIGINT AS total FROM t GROUP BY 1")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "[ \n]+"), lambda w: F.length(w)).alias("i"))
    total = F.aggregate(F.flatten("w"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    w = d.select("doc_id", F.size(numeric.window_starts(F.col("i"), 16)).alias("n"), numeric.pad_windows(F.col("i"), 16).alias("w")).select("doc_id", "n", total.alias("total"))
    return w.groupBy("doc_id").agg(F.sum("n").cast("int").alias("n_windows"), F.sum("total").alias("total"))


@query("WITH w AS (SELECT doc_id, list_transform(string_split_regex(text, '[ \\n]+'), lambda x: length(x)::INT) AS i FROM documents), s AS (SELECT doc_id, i, greatest(len(i) - 16, 0) AS m FROM w), t AS (SELECT doc_id, i, list_distinct([0, m // 2, m]) AS a FROM s), u AS (SELECT doc_id, i, unnest(list_sort(a)) AS a, generate_subscripts(a, 1) AS g FROM t), z AS (SELECT doc_id, g, list_resize(i[a + 1:a + 16], 16, 0) AS w FROM u UNION ALL SELECT doc_id, g, list_resize([]::INT[], 16, 0) FROM t, (VALUES (2), (3)) v(g) WHERE g > len(a)) SELECT doc_id, g::INT AS window_no, array_to_string(w, ' ') AS ids FROM z")
def token_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three windows of 16 themselves, a word's id being its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "[ \n]+"), lambda w: F.length(w)).alias("i"))
    w = d.select("doc_id", F.posexplode(numeric.pad_windows(F.col("i"), 16)).alias("at", "w"))
    return w.select("doc_id", (F.col("at") + 1).cast("int").alias("window_no"), F.array_join(F.transform("w", lambda x: x.cast("string")), " ").alias("ids"))


_DOC_TFIDF = _TFIDF.replace("FROM benchmark", "FROM documents")


@query(f"WITH x AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda v: length(v) > 1) AS w FROM documents), t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM x), {_DOC_TFIDF}")
def word_tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(features.tfidf_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "word"))


@query(f"WITH x AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[\\x09-\\x0D ]+'), lambda v: v <> '')) AS v FROM documents), y AS (SELECT id, ' ' || v || ' ' AS v FROM x), t AS (SELECT id, unnest(list_concat(CASE WHEN length(v) <= 3 THEN [v] ELSE list_transform(range(1, length(v) - 1), lambda i: substring(v, i, 3)) END, CASE WHEN length(v) >= 4 THEN list_transform(range(1, length(v) - 2), lambda i: substring(v, i, 4)) ELSE [] END, CASE WHEN length(v) >= 5 THEN list_transform(range(1, length(v) - 3), lambda i: substring(v, i, 5)) ELSE [] END)) AS term FROM y), {_DOC_TFIDF}")
def char_wb_tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(features.tfidf_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "char"))


# --- models, streams, files: no SQL form -----------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents with their split, which is worked out on ids and labels alone."""
    d = labelled(spark, sf_dir)
    return d.join(broadcast_up_to(sampling.stratified_split(d.select("id", "label"), SEED).select("id", "split")), "id")


@query()
def tfidf_lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _split(spark, sf_dir)
    return models.predictions(models.train_tfidf(d.where("split = 'train'"))(d.where("split <> 'train'")))


def _with_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the features, which are worked out once; while few, they go to the texts, so that no texts are shuffled."""
    d = _split(spark, sf_dir)
    return d.join(broadcast_up_to(features.stylometric_features(d)), "id")


@query()
def encoded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token windows of 256 ids, z-scores and label of every labelled document."""
    import public_tokenizers

    d = labelled(spark, sf_dir).select("id", "label", "text")
    return features.encoded_windows(d, public_tokenizers.path("word_bpe_49k.json"), 256, features.fit_normalizer(features.stylometric_features(d)))


@query()
def fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _with_style(spark, sf_dir)
    return models.predictions(models.train_fusion(x.where("split = 'train'"))(x.where("split <> 'train'")))


@query()
def mlp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _with_style(spark, sf_dir)
    return models.predictions(models.train_structural(x.where("split = 'train'"))(x.where("split <> 'train'")))


_PLATT_SQL = f"""{SCORED_SQL}, sizes AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source DESC) AS i FROM scored GROUP BY source),
dealt(i, source, fold, loads) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT s.i, s.source, (list_position(d.loads, list_min(d.loads)) - 1)::INT, list_transform(d.loads, lambda x, j: x + CASE WHEN j = list_position(d.loads, list_min(d.loads)) THEN s.n ELSE 0 END)
  FROM dealt d JOIN sizes s ON s.i = d.i + 1),
pts AS (SELECT id, fold, label, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS x FROM scored JOIN dealt USING (source)),
step(k, m, a, b) AS (
  SELECT 0, m::INT, 0.0::DOUBLE, 0.0::DOUBLE FROM range(5) t(m)
  UNION ALL SELECT k + 1, m, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT k, m, a, b, sum((q - label) * x) + 1e-6 * a AS g0, sum(q - label) AS g1, sum(q * (1 - q) * x * x) + 1e-6 AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q)) AS h11
    FROM (SELECT k, m, a, b, x, label, 1 / (1 + exp(-(a * x + b))) AS q FROM step JOIN pts ON pts.fold <> step.m WHERE k < 25) GROUP BY k, m, a, b))
SELECT id, pts.fold, round(1 / (1 + exp(-(a * x + b))), 6) AS calibrated FROM pts JOIN step ON step.m = pts.fold AND k = 25"""


@query(f"WITH RECURSIVE {_PLATT_SQL}")
def platt_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = calibrate.crossfit_platt(scored(spark, sf_dir).select("id", "source", "label", "p"), 5, "source")
    return _round(d.select("id", "fold", "calibrated"))


@query()
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bootstrap_auc(scored(spark, sf_dir), 1000, SEED)


@query()
def bootstrap_auc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over as many distinct scores as there are prices."""
    return evaluate.bootstrap_auc(_wide(spark, sf_dir), 200, SEED)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1")
def stream_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    store = BestRowStore(spark, f"{shared_folder(spark)}/argmin-{uuid.uuid4().hex}", ["user_id", "event_type"], F.struct("value", "event_id"), ["event_id", "value"], source_revision(spark, sf_dir, "events.parquet"))
    return store.run(stream)


@query()
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_manifest(spark, sf_dir)
