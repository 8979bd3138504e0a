"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Every stage takes and gives whole rows; all but the last give the columns of documents.  Rows without
an id go through the stages that judge a text by itself like any other; they are no duplicates of
anything, lose no passage, and are packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language_id, near_duplicates, packing, quality, substring_dedup
from corvane.llm.frames import Scratch, stored

#: Confidence below which the language stage rejects a document.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known with confidence; null and empty texts go, repeated rows stay."""
    return language_id.keep(docs, language_id.fit(docs.where(language_id.in_training())), LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules; null and empty texts go, repeated rows stay."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.keep(docs, trusted)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the least by its columns in their order; only those rows are shuffled whole."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    rest = [c for c in docs.columns if c != "doc_id"]
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("row")).select("doc_id", "row.*")
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(least.select(*docs.columns))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate component, and one row of an id.

    A text without words stays, as it is linked with nothing, and so does a row without an id.
    """
    stays = near_duplicates.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = _one_row_each(docs).join(stays, "doc_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that occur earlier in the corpus.

    Words are then joined by one space.  A null text stays null, an empty one empty.  Rows that repeat
    an id each keep their own text; the other columns are those of the least of them.
    """
    with Scratch(spark) as scratch:
        rows = substring_dedup.dedup(docs, scratch=scratch).select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
        kept = stored(rows, "kept")
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    other = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("row"), F.min(F.col("text").isNull()).alias("none"))
    whole = kept.join(other, "doc_id").withColumn("text", F.when(~F.col("none"), F.col("text"))).withColumn("n_chars", F.when(~F.col("none"), F.col("n_chars")))
    return whole.select("doc_id", "text", "n_chars", "row.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null or empty text is its end alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicate_join),
    ("passages", passages),
    ("packing", pack),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
