"""A corpus pipeline of five stages, each one operator on all that its predecessor kept.

Toxic documents go; near-copies of earlier lines go; one document of each class of near-copies stays; documents that
hold a benchmark item go; what is left is encoded.

Defined cases are those of the operators: null texts are empty, and stay null until they are encoded; repeated rows are copies, of which one stays; empty
tables give an empty result; all columns of ``documents`` pass through every stage but the last as they are, whatever their names (line dedup
alone changes text and n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from terrasift.llm.common import saved


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = ["__lines", "__removed"]
    while set(counts) & set(docs.columns):
        counts = [x + "_" for x in counts]
    return line_dedup.dedup(docs, counts=tuple(counts)).select(*docs.columns)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _lines),
    ("ngram_jaccard_join", _near_copies),
    ("benchmark_decontamination", _benchmark),
    ("byte_bpe", _tokens),
]

#: SQL can express neither the models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
