"""The registered queries of this subpackage: thin digests of the operators' own outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.bpe_codec import decode, encode

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode(encode(_documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffix_tree import score

    return score(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.substring_dedup import dedup

    return dedup(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.language_id import fit, in_training, predict

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(in_training()))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.withColumn("held_out", ~in_training()).select("doc_id", "held_out", "lang_pred", "score")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.tiff import from_texts, pages

    rows = pages(from_texts(_documents(spark, sf_dir)), keep=("doc_id", "n_bytes"))
    size = F.length("pixels")
    feature = F.format_string("%dx%dx%d %s p%d", "width", "height", "samples", "compression", "predictor")
    return rows.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature")
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.near_duplicates import join

    return join(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.license_scan import fit, scan

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    rows = scan(docs, fit(docs))
    return rows.select("doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_hits"), F.concat_ws(",", F.array_sort(F.array_distinct("hits.family"))).alias("families"), F.concat_ws(",", F.transform("hits", lambda h: F.format_string("%d-%d", h["start"], h["stop"]))).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import judge

    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return judge(_documents(spark, sf_dir), trusted)


#: An id that the rank file leaves free.
END_OF_DOCUMENT = 50256


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.token_counts import id_width, scan, token_blocks

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = scan(token_blocks(_documents(spark, sf_dir), ranks, pattern, END_OF_DOCUMENT), END_OF_DOCUMENT, id_width(ranks, pattern, END_OF_DOCUMENT))
    return rows.select(F.col("tag").alias("doc_id"), "n_tokens", "ended")


QUERIES = {f.__name__: f for f in (op1_suffix_tree, op2_substring_dedup, op3_language_id, op4_packing, op5_tiff, op6_jaccard_join, op7_license_scan, op8_quality_rules, op9_bpe_codec, op10_token_counts)}
