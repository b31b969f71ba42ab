"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import sentencepiece  # noqa: F401  (what a task needs is missed here already)
import tiktoken  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_dedup, bpe, decontaminate, importance, jaccard_join, line_dedup, media, repeats, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode(tokens, ranks, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = media.write_archives(_table(spark, sf_dir, "documents"))
    found = media.decode(media.read_archives(spark, root))
    return found.select(
        F.col("id").cast("long").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    sample = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), good, fraction=0.7)
    return sample.select("doc_id", F.lit(True).alias("selected"), "log_ratio", "gumbel_key")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = suffix_dedup.remove_repeats(docs).select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return repeats.attach(docs, found)


def op7_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = block_dedup.remove_repeats(docs).select("key", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return repeats.attach(docs, found)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round(F.col("shared") / F.col("size"), 6).alias("containment"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_media_columns": op2_media_columns,
    "op3_token_counts": op3_token_counts,
    "op4_importance": op4_importance,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op7_block_dedup": op7_block_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}
