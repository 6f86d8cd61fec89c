"""The corpus tables in the shapes that the operators take, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import unit_hash
from ..functions.text import canonical, normalize, text_hash

SEED = 20260904


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, text, label, source, domain, provenance of the labelled documents. Labels go to the documents while they are few, so
    that no texts are shuffled."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    human = F.col("label") == 0
    return d.join(F.broadcast(y) if y.count() <= 1 << 20 else y, "doc_id").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "text", "label", "source", F.col("lang").alias("domain"),
        F.when(human, "human").when(F.col("doc_id") % 2 == 0, "raw_ai").otherwise("expert_edit").alias("provenance"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled, with a reproducible score p that leans towards the label."""
    return labelled(spark, sf_dir).withColumn("p", F.round((unit_hash(F.col("id")) + 0.6 * F.col("label")) / 1.6, 2))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, text, lineage_id, split and flags of all documents: exact copies share a lineage, splits go by document,
    and some texts are blank, some ids repeat, some parents are missing, so that audits find something."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 89 == 5, F.lit(" \n")).otherwise(F.col("text")))
    u = unit_hash(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    split = F.when(u < 0.15, "calibration").when(u < 0.3, "development").when(u < 0.32, "sealed_test").when(u < 0.325, "other").otherwise("train")
    return d.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc:"), (F.col("doc_id") - F.when(F.col("doc_id") % 97 == 96, 1).otherwise(0)).cast("string")).alias("id"), "text",
        F.substring(text_hash(canonical(F.col("text"))), 1, 12).alias("lineage_id"), "source", split.alias("split"), (u < 0.315).alias("_s"), F.col("doc_id"),
    ).select(
        "ord", "id", "text", "lineage_id", "source", "split", ((F.col("split") == "sealed_test") & F.col("_s") | (F.col("doc_id") % 211 == 7)).alias("sealed"),
        (F.col("split") == "train").alias("train_eligible"),
        F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("doc:"), F.floor(F.col("doc_id") * 1.2).cast("string"))).alias("parent_id"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as variants of a group: conv_id is the group, the user human, the assistant raw machine text."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return c.select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("ord"), F.col("role").alias("variant"), "text",
        F.when(F.col("role") == "user", 0).otherwise(1).alias("label"), F.when(F.col("role") == "user", "human").when(F.col("turn") <= 2, "raw_ai").otherwise("llm_edit").alias("provenance"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as prompt groups: human and machine text, an expert edit, and models' edits as literals."""
    c = table(spark, sf_dir, "conversations")
    first = lambda role, t: F.coalesce(F.min(F.when((F.col("role") == role) & (F.col("turn") == t), F.col("text"))), F.lit(""))
    n = F.col("prompt_id").cast("string")
    d = c.groupBy(F.col("conv_id").alias("prompt_id")).agg(first("user", 0).alias("human_output"), first("assistant", 1).alias("model_output"), first("user", 2).alias("human_edits"))
    edits = F.concat(F.lit("[{'P1': 'first "), n, F.lit("', 'P2': ' '}, {'P3': 'third "), n, F.lit("'}]"))
    return d.withColumn("llama-3.1-70b_edits", F.when(F.col("prompt_id") % 2 == 0, edits).otherwise("no list")).withColumn("gpt-4o_edits", F.concat(F.lit("[{'P2': 'one "), n, F.lit("'}]")))


CANON = r"array_to_string(list_filter(string_split_regex(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}]+'), lambda x: x <> ''), ' ')"
UNIT = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def canon_sql(text: str = "text") -> str:
    return CANON.format(text)


LABELLED_SQL = """labelled AS (
  SELECT d.doc_id AS ord, 'doc:' || d.doc_id AS id, text, quality AS label, source, lang AS domain,
    CASE WHEN quality = 0 THEN 'human' WHEN d.doc_id % 2 = 0 THEN 'raw_ai' ELSE 'expert_edit' END AS provenance
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SCORED_SQL = LABELLED_SQL + f""", scored AS (
  SELECT *, round(({UNIT.format("id")} + 0.6::DOUBLE * label) / 1.6::DOUBLE, 2) AS p FROM labelled)"""
CORPUS_SQL = f"""corpus0 AS (
  SELECT * REPLACE (CASE WHEN doc_id % 89 = 5 THEN chr(32) || chr(10) ELSE text END AS text), {UNIT.format("'doc:' || doc_id")} AS u FROM documents),
corpus AS (
  SELECT doc_id AS ord, 'doc:' || (doc_id - CASE WHEN doc_id % 97 = 96 THEN 1 ELSE 0 END) AS id, text, substr(sha256({canon_sql()}), 1, 12) AS lineage_id, source,
    CASE WHEN u < 0.15 THEN 'calibration' WHEN u < 0.3 THEN 'development' WHEN u < 0.32 THEN 'sealed_test' WHEN u < 0.325 THEN 'other' ELSE 'train' END AS split,
    ((u >= 0.3 AND u < 0.315) OR doc_id % 211 = 7) AS sealed, u >= 0.325 AS train_eligible,
    CASE WHEN doc_id % 13 = 0 THEN 'doc:' || floor(doc_id * 1.2::DOUBLE)::BIGINT END AS parent_id
  FROM corpus0)"""
CONV_SQL = """conv AS (
  SELECT conv_id AS group_id, turn AS ord, role AS variant, text, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label,
    CASE WHEN role = 'user' THEN 'human' WHEN turn <= 2 THEN 'raw_ai' ELSE 'llm_edit' END AS provenance
  FROM conversations WHERE role IN ('user', 'assistant'))"""
PROMPTS_SQL = """prompts AS (
  SELECT conv_id AS p, coalesce(min(text) FILTER (role = 'user' AND turn = 0), '') AS h, coalesce(min(text) FILTER (role = 'assistant' AND turn = 1), '') AS m,
    coalesce(min(text) FILTER (role = 'user' AND turn = 2), '') AS e FROM conversations GROUP BY 1),
told AS (
  SELECT p, 0 AS seq, h AS text, 0 AS label, 'human' AS variant, 'human' AS provenance FROM prompts
  UNION ALL SELECT p, 1, m, 1, 'raw_ai', 'raw_ai' FROM prompts
  UNION ALL SELECT p, 2, e, 1, 'expert_edit', 'expert_edited_ai' FROM prompts
  UNION ALL SELECT p, 3, 'first ' || p, 1, 'llama-3.1-70b_P1', 'llm_edited_ai' FROM prompts WHERE p % 2 = 0
  UNION ALL SELECT p, 4, 'third ' || p, 1, 'llama-3.1-70b_P3', 'llm_edited_ai' FROM prompts WHERE p % 2 = 0
  UNION ALL SELECT p, 5, 'one ' || p, 1, 'gpt-4o_P2', 'llm_edited_ai' FROM prompts),
variants AS (
  SELECT p::VARCHAR AS group_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text, label::INT AS label, variant, provenance, (row_number() OVER (PARTITION BY p ORDER BY seq) - 1)::INT AS ordinal
  FROM told WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '')"""
