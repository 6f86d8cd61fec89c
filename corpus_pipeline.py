"""The corpus pipeline: quality, language, line and document deduplication, then packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again, so that no stage
is computed twice and a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import language_id, line_dedup, ngram_join, packing, quality
from lexmill.llm.common import Scratch, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.3; learns from the labelled rows it is given. Null and wordless texts score 0 and go;
    rows without an id are scored like others, and repeated rows stay or go together."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, 0.3)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts among them) or whose language no class is at least even odds for. Null languages
    are not learned from; repeated rows stay or go together."""
    return language_id.keep_known(docs, language_id.fit(docs), 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines out of the texts; no row goes. Null texts and rows without an id stay as they are; n_chars follows the text where it
    was cut, also to nothing."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the least id, of each group of near duplicates; texts without words and rows without an id all stay, of
    equal rows with an id one."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row it is given in sequences of 2,048 tokens; a null text is an end token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
