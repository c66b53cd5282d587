"""The registered queries of this folder, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, license_scan, line_dedup, media, mixing, neighbours, ngram_join, quality, sharding
from .shared import table


def tokenizer_path() -> str:
    """The tokenizer file; CHRONOLITH_TOKENIZER names another one."""
    if own := os.environ.get("CHRONOLITH_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path(bpe.TOKENIZER)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), n_grades=3)
    return quality.grade(docs, model).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = media.pack(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    d = media.media_columns(d, digests=True)
    return d.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media.feature().alias("feature"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["start"])
    base, more = F.transform("base", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)))
    return d.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_mixing, op3_bpe, op4_ann, op5_quality, op6_line_dedup, op7_media, op8_sharding, op9_license, op10_langid)}
ORACLE_SQL = {"op2_mixing": mixing.ORACLE_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL}
