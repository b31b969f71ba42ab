"""Token counts through a digest cache.

Content is normalised (null to empty, UTF-8) and digested; a stored count belongs to a content digest and
a tokenizer digest, so another model file never meets old counts. Only distinct contents without a
stored count are encoded, and their counts are appended to the cache as Parquet. Distinct contents are
pre-aggregated in the map tasks, so a text that a third of the rows repeat reaches the shuffle once a task.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a very long text is encoded whole; repeated rows give repeated results; an empty
table gives an empty result and leaves the cache as it is; a cache with repeated digests (two jobs that
appended at once) is read as if each were there once; id and text columns may have any names, others aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, trimmed

CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    """For one worker: texts to token counts, as the library of the file's kind gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _encode(path: str):
    schema = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for part in slices(batch, "content", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("digest").cast(pa.binary()), pa.array(count(part.column("content").to_pylist()), pa.int64())], schema=schema)

    return run


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer, each digest once."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens). ``cache``: folder of the stored counts; a new one in the shared folder if None.

    The distinct misses are encoded and appended when this is called; the rows themselves are lazy.
    """
    spark = docs.sparkSession
    tokenizer, cache = tokenizer_digest(tokenizer_path), cache or shared_path(spark, "token-counts")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    distinct = rows.select("digest", "content").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    counts = misses.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens bigint")
    counts.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    sizes = rows.select("__id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sizes.join(read_cache(spark, cache, tokenizer), "digest").select(F.col("__id").alias(id_col), "n_bytes", "n_tokens")
