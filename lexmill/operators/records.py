"""Canonical provenance-tracked records: construction, validation, manifests and digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import normalize, text_hash
from .ordering import hash_tree

FIELDS = ["source", "domain", "provenance", "generator_family", "editor_family", "transformation_family", "split"]
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("lineage_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("text_sha256", T.StringType(), False),
        T.StructField("label", T.IntegerType(), False),
        *[T.StructField(n, T.StringType(), False) for n in FIELDS],
        T.StructField("sealed", T.BooleanType(), False),
        T.StructField("train_eligible", T.BooleanType(), False),
        T.StructField("parent_id", T.StringType(), True),
        T.StructField("source_fields", T.MapType(T.StringType(), T.StringType()), True),
    ]
)
COLUMNS = SCHEMA.fieldNames()
TEXT_KEYS = ["text", "generation", "prompt"]
ROLES = ["train", "development", "calibration"]


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"required fields are missing: {missing}")
    return df


def label_domain(label: Column) -> Column:
    return F.coalesce(label.isin(0, 1), F.lit(False))


def forbidden_keys(fields: Column) -> Column:
    return F.exists(F.map_keys(F.coalesce(fields, F.create_map().cast("map<string,string>"))), lambda k: F.lower(k).isin(TEXT_KEYS))


def to_records(df: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical records: text normalised, text_sha256 always computed from it, types cast. strict: a label
    outside 0 and 1 or a text-bearing source field raises when the row is computed."""
    require(df, [c for c in COLUMNS if c not in ("text_sha256", "source_fields")])
    fields = F.col("source_fields") if "source_fields" in df.columns else F.lit(None).cast("map<string,string>")
    for flag in ("sealed", "train_eligible"):
        if df.schema[flag].dataType != T.BooleanType():
            raise ValueError(f"{flag} must be boolean")
    out = df.withColumn("text", normalize(F.col("text").cast("string"))).withColumn("source_fields", F.coalesce(fields, F.create_map().cast("map<string,string>")))
    out = out.withColumn("text_sha256", text_hash(F.col("text")))
    if strict:
        bad_label = F.raise_error(F.concat(F.lit("label must be 0 or 1: "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))
        bad_field = F.raise_error(F.concat(F.lit("source_fields must not hold text: "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))
        out = out.withColumn("label", F.when(~label_domain(F.col("label")), bad_label.cast("int")).otherwise(F.col("label").cast("int")))
        out = out.withColumn("source_fields", F.when(forbidden_keys(F.col("source_fields")), bad_field.cast("map<string,string>")).otherwise(F.col("source_fields")))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])


def rejects(df: DataFrame) -> DataFrame:
    """id and reason of the rows that strict construction would stop at."""
    reason = F.when(~label_domain(F.col("label")), "label").when(forbidden_keys(F.col("source_fields")), "source_fields")
    return df.select("id", reason.alias("reason")).where("reason is not null")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def split_source_counts(df: DataFrame, sources: list[str]) -> DataFrame:
    """One column a source, 0 where a split has none."""
    return df.groupBy("split").agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])


def assembly_report(df: DataFrame, grouped: str, group: str = "lineage_id") -> DataFrame:
    """split, n, groups: rows of each split, and distinct groups among its rows of the source ``grouped``."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("source") == grouped, F.col(group))).alias("groups"))


def prepare_report(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row: input, blank, duplicate and class counts of raw labelled texts."""
    from ..functions.text import strip

    key = normalize(F.col(text), unicode=False)
    blank = strip(key) == ""
    kept = F.when(~blank, key)
    return df.agg(
        F.count("*").alias("input_rows"), F.count_if(blank).alias("blank_rows"), (F.count(kept) - F.count_distinct(kept)).alias("duplicate_rows"),
        F.count_if(~blank & (F.col(label) == 0)).alias("human_rows"), F.count_if(~blank & (F.col(label) == 1)).alias("ai_rows"),
    )


def public_rows(df: DataFrame) -> DataFrame:
    """Records without their text."""
    return df.drop("text")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    """SHA-256 of the canonical JSON: independent of key order."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_column(value: Column, kind: T.DataType) -> Column:
    """value with the fields of structs and the entries of maps in the order of their names, at every depth."""
    if isinstance(kind, T.StructType):
        fields = [canonical_column(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical_column(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical_column(e["value"], kind.valueType).alias("value")))))
    return value


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, its keys in order and nulls kept: independent of the order of columns, fields and entries."""
    row = F.struct(*[canonical_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, order: list[str]) -> str:
    """Digest of rows in order (rows that tie, by their own digests): the root of a hash tree over row_digest, the same at any
    number of partitions and in any order of the input; of no rows, the digest of nothing."""
    return hash_tree(df, [F.col(c) for c in order], row_digest(df)) or hashlib.sha256().hexdigest()


def metadata_manifest(df: DataFrame, metadata: dict) -> dict:
    """Text-free manifest: metadata, counts by split and a digest over the public rows."""
    counts = {r["split"]: r["n"] for r in split_counts(df).collect()}
    return {"metadata": metadata, "split_counts": dict(sorted(counts.items())), "record_digest": table_digest(public_rows(df), ["id"]), "records": sum(counts.values())}
