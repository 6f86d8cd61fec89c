"""Source rows of known shapes to canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import canonical, literal_variants_of, normalize, strip
from ..operators.records import COLUMNS, require, to_records
from ..operators.sampling import first_wins, hash_rank
from ..session import settled

#: Columns that hold models' edits, and the models.
EDITORS = {"llama-3.1-70b_edits": "llama-3.1-70b", "gpt-4o_edits": "gpt-4o"}


def records(df: DataFrame, **values: Column | str | bool) -> DataFrame:
    """Canonical records from df with the given columns filled in."""
    base = {"generator_family": "unknown", "editor_family": "none", "transformation_family": "none", "domain": "unknown", "sealed": False, "train_eligible": True, "parent_id": F.lit(None).cast("string")}
    filled = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (base | values).items() if k in values or k not in df.columns}
    return to_records(df.withColumns(filled))


def sentence_pairs(df: DataFrame, order: str, split: str = "train", unicode: bool = False) -> DataFrame:
    """Rows (idx, sentence, label) to records: label checked, blanks dropped, and the first of texts that agree
    after folding and collapsing kept, across labels. Human text is 0, paraphrased machine text 1."""
    require(df, ["idx", "sentence", "label"])
    checked = df.withColumn("label", F.when(F.col("label").cast("int").isin(0, 1), F.col("label").cast("int")).otherwise(F.raise_error(F.lit("label must be 0 or 1")).cast("int")))
    folded = canonical(F.col("sentence"), unicode)
    unique = first_wins(checked.withColumn("_c", folded).where("_c <> ''"), F.col("_c"), order).drop("_c")
    human = F.col("label") == 0
    return records(
        unique.withColumn("id", F.concat(F.lit("padben:"), F.col("idx").cast("string"))).withColumn("text", F.col("sentence")),
        lineage_id=F.col("id"), source="padben", provenance=F.when(human, "human").otherwise("ai_humanized"),
        generator_family=F.when(human, "human").otherwise("unknown"), editor_family=F.when(human, "none").otherwise("padben_humanizer"),
        transformation_family=F.when(human, "none").otherwise("deep_paraphrase"), split=split, source_fields=F.create_map(F.lit("padben_idx"), F.col("idx").cast("string")),
    )


def _edited_by(model: str):
    return lambda x: F.struct(x["text"].alias("text"), F.lit(1).alias("label"), F.concat(F.lit(f"{model}_"), x["variant"]).alias("variant"), F.lit("llm_edited_ai").alias("provenance"))


def edit_variants(df: DataFrame) -> DataFrame:
    """Prompt groups to text, label, group_id, variant, provenance and ordinal: human, raw machine text, expert
    edit, then each model's edits in order; blanks are dropped, ordinals count what is left."""
    require(df, ["prompt_id", "human_output", "human_edits", "model_output", *EDITORS])
    fixed = [("human_output", 0, "human", "human"), ("model_output", 1, "raw_ai", "raw_ai"), ("human_edits", 1, "expert_edit", "expert_edited_ai")]
    one = [F.struct(strip(F.col(f"`{c}`")).alias("text"), F.lit(y).alias("label"), F.lit(v).alias("variant"), F.lit(p).alias("provenance")) for c, y, v, p in fixed]
    kind = "array<struct<text:string,label:int,variant:string,provenance:string>>"
    many = [
        F.transform(literal_variants_of(F.col(f"`{c}`")), _edited_by(m)).cast(kind)
        for c, m in EDITORS.items()
    ]
    every = F.filter(F.concat(F.array(*one).cast(kind), *many), lambda x: strip(x["text"]) != "")
    return df.select(F.col("prompt_id").cast("string").alias("group_id"), F.posexplode(every).alias("ordinal", "v")).select("v.text", "v.label", "group_id", "v.variant", "v.provenance", "ordinal")


def edit_records(variants: DataFrame, split: Column) -> DataFrame:
    """Variants to records: edits of a group get the id of its first raw machine text as parent."""
    group = Window.partitionBy("group_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ids = variants.withColumn("id", F.concat_ws(":", F.lit("beemo"), F.col("group_id"), F.col("variant"), F.col("ordinal").cast("string")))
    parent = F.first(F.when(F.col("provenance") == "raw_ai", F.col("id")), ignorenulls=True).over(group)  # a group is one prompt
    edited = F.col("provenance").isin("expert_edited_ai", "llm_edited_ai")
    return records(
        ids.withColumn("_parent", parent), lineage_id=F.concat(F.lit("beemo:"), F.col("group_id")), source="beemo", split=split, parent_id=F.when(edited, F.col("_parent")),
        generator_family=F.when(F.col("label") == 0, "human").otherwise("unknown"),
        editor_family=F.when(F.col("provenance") == "expert_edited_ai", "human_expert").when(F.col("provenance") == "llm_edited_ai", "llm_editor").otherwise("none"),
        transformation_family=F.when(edited, "style_rewrite").otherwise("none"),
        source_fields=F.create_map(F.lit("beemo_prompt_id"), F.col("group_id"), F.lit("beemo_variant"), F.col("variant")),
    )


#: The columns of the paired source.
RAID = ["id", "source_id", "adv_source_id", "model", "attack", "domain", "generation"]


def eligible(df: DataFrame) -> DataFrame:
    """Human texts without an attack and machine texts under the paraphrase attack, needed columns only."""
    require(df, RAID)
    return df.select(*RAID).where(((F.col("model") == "human") & (F.col("attack") == "none")) | ((F.col("model") != "human") & (F.col("attack") == "paraphrase")))


def best_candidates(df: DataFrame) -> DataFrame:
    """One row a source family and role: the least (model, id). A partial aggregate, also over streams."""
    role = F.when(F.col("model") == "human", "human").otherwise("paraphrase")
    rank = F.struct(F.when(role == "human", F.lit("")).otherwise(F.col("model")).alias("m"), F.col("id").alias("i"))
    return eligible(df).groupBy("source_id", role.alias("role")).agg(F.min_by(F.struct(*[F.col(c) for c in RAID]), rank).alias("row"))


def family_pairs(best: DataFrame, split: str = "sealed_test") -> DataFrame:
    """Records of the families that have both roles; the machine text's parent is the human one."""
    h = best.where("role = 'human'").select("source_id", F.col("row").alias("h"))
    p = best.where("role = 'paraphrase'").select("source_id", F.col("row").alias("p"))
    both = h.join(p, "source_id").select(F.col("h.id").alias("human_id"), F.explode(F.array("h", "p")).alias("r")).select("human_id", "r.*")
    human = F.col("model") == "human"
    fields = [x for c in ("adv_source_id", "model", "attack", "domain") for x in (F.lit(f"raid_{c}"), F.col(c).cast("string"))]
    return records(
        both.withColumn("text", F.col("generation")).withColumn("id", F.concat(F.lit("raid:"), F.col("id"))).withColumn("label", F.when(human, 0).otherwise(1)),
        lineage_id=F.concat(F.lit("raid:"), F.col("source_id")), source="raid", provenance=F.when(human, "human").otherwise("ai_paraphrased"), generator_family=F.col("model"),
        editor_family=F.when(human, "none").otherwise("raid_adversarial_attack"), transformation_family=F.col("attack"),
        split=split, sealed=True, train_eligible=False, parent_id=F.when(human, F.lit(None)).otherwise(F.concat(F.lit("raid:"), F.col("human_id"))), source_fields=F.create_map(*fields),
    )


def external_rows(df: DataFrame, order: str, part: str = "C") -> DataFrame:
    """id, text, label, scenario, scenario_family, generator_model of one test part; the source marks human as
    1, here it is 0. Ids are ordinals among kept rows in input order, numbered by range partitions: one row a
    partition tells how many rows stand before it."""
    require(df, ["text", "binary_label", "test_split", "scenario", "scenario_family"])
    model = F.col("generator_model") if "generator_model" in df.columns else F.lit(None).cast("string")
    kept = settled(df.where(F.col("test_split") == part).repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = sorted((r["_p"], r["count"]) for r in kept.groupBy("_p").count().collect())
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    starts = df.sparkSession.createDataFrame(before or [(-1, 0)], "_p int, _s long")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return kept.withColumn("_i", inner).join(F.broadcast(starts), "_p").select(
        F.concat(F.lit("gradtex:"), (F.col("_s") + F.col("_i")).cast("string")).alias("id"), "text", (1 - F.col("binary_label").cast("int")).alias("label"),
        "scenario", "scenario_family", F.coalesce(F.nullif(model, F.lit("")), F.lit("human")).alias("generator_model"),
    )
