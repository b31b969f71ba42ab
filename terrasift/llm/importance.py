"""Quality selection by importance resampling.

Two generative models over hashed unigrams and bigrams, one of target text and one of raw text, give every document the
log ratio of its likelihoods; adding Gumbel noise and taking the k largest sums samples k documents
without replacement in proportion to that ratio. Model counts cover every document (the raw model) and every
target document. The noise is a function of a seed and the text's id, so a rerun draws the same sample.

The k-th largest sum is found by refining a histogram of fixed size, never by sorting all rows in one place.

Defined cases: null text is empty; a text without words has the ratio 0; a very long text is summed whole; ids may be of any type, and other columns aren't read; rows with a null id take part with the noise of the empty
string; equal sums are taken in id order; repeated rows are repeated draws of equal sums; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Packer, buckets, by_bucket, mix, offsets, saved, slices, trimmed
from .repeats import FOUND, TEXT
from .shingles import lower_words

#: Buckets of the hashed n-grams, the smoothing count of each, the bins of a histogram.
BUCKETS, SMOOTH, BINS = 10_000, 1.0, 4_096
#: Parts of the table of buckets in an exchange.
PARTS = 16
#: Rows under which the last histogram bin is sorted.
FEW = 10_000


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the unigrams and bigrams of all texts in a row; how many each text has."""
    found = lower_words(texts)
    n, flat = found.n, found.flat
    at, owner = offsets(n), np.repeat(np.arange(len(n)), n)
    inner = np.ones(len(flat), dtype=bool)  # places that have a successor in their text
    inner[at[1:][n > 0] - 1] = False
    where = np.flatnonzero(inner)
    pair = (flat[where] * np.uint64(0x9E3779B97F4A7C15)) ^ (flat[where + 1] >> np.uint64(7)) if len(where) else np.zeros(0, np.uint64)
    pair = pair * np.uint64(0xBF58476D1CE4E5B9)
    value = np.concatenate([(flat >> np.uint64(20)) % np.uint64(BUCKETS), (pair >> np.uint64(20)) % np.uint64(BUCKETS)]).astype(np.int64)
    order = np.argsort(np.concatenate([owner, owner[where]]), kind="stable")
    return value[order], n + np.maximum(n - 1, 0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed (slot, n) by part of the table of n-gram buckets."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            total += np.bincount(ngram_buckets(part.column("text").to_pylist())[0], minlength=BUCKETS)
    used, packer = np.flatnonzero(total), Packer()
    packer.add(used % PARTS, {"slot": used, "n": total[used]})
    yield from packer.batches()


def _packed(kind: int, n: int):
    """Packs rows by doc_id."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(kind)
        for batch in batches:
            for part in slices(batch, "text") if kind == TEXT else [batch]:
                ids = part.column("__hash").to_numpy()
                packer.add(mix(ids.view(np.uint64)) % np.uint64(n), {c: part.column(c) for c in part.schema.names if c != "__hash"})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return run


def _sums(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
    slot, back = np.unique(records[TEXT]["slot"].to_numpy(), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bincount(back, weights=records[TEXT]["n"].to_numpy()).astype(np.int64))], names=["slot", "n"])


def _target_counts(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
    if TEXT in records and FOUND in records:
        texts = records[TEXT].filter(pc.is_in(records[TEXT]["doc_id"], records[FOUND]["doc_id"].combine_chunks()))
        yield from _counts(iter(texts.select(["text"]).to_batches()))


def fit(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """Log ratio of each bucket. ``targets``: one column ``doc_id``, the documents of good quality."""
    key = F.col("doc_id").cast("string")
    hashed = [key.alias("doc_id"), F.xxhash64(key).alias("__hash")]  # ids may be of any type
    good = targets.where("doc_id is not null").select("doc_id").distinct()
    n = buckets(docs, 2.5)
    # packed, so that the exchange is alike at any size; a target's text meets its id in a bucket
    named = docs.where("doc_id is not null").select(*hashed, "text").mapInArrow(_packed(TEXT, n), PACKED).unionAll(good.select(*hashed).mapInArrow(_packed(FOUND, n), PACKED))
    sums = []
    for counts in (docs.select("text").mapInArrow(trimmed(_counts), PACKED), by_bucket(named, n, _target_counts, PACKED)):
        got = by_bucket(counts, PARTS, _sums, "slot bigint, n bigint").toPandas()  # BUCKETS rows at most
        sums.append(np.bincount(got.slot, weights=got.n, minlength=BUCKETS))
    raw, target = sums
    raw_p, target_p = ((x + SMOOTH) / (x.sum() + SMOOTH * BUCKETS) for x in (raw, target))
    return np.log(target_p) - np.log(raw_p)


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 17) -> DataFrame:
    """Rows (doc_id, log_ratio, gumbel_key)."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = pa.schema([("id", pa.string()), ("log_ratio", pa.float64())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, n = ngram_buckets(part.column("text").to_pylist())
                at = offsets(n)
                total = np.concatenate([[0.0], np.cumsum(sent.value[value])])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total[at[1:]] - total[at[:-1]])], schema=schema)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "id string, log_ratio double")
    even = (F.abs(F.xxhash64(F.lit(seed), F.coalesce("id", F.lit("")))) % F.lit(2**52) + 0.5) / F.lit(float(2**52))  # over 0 and under 1
    rows = rows.withColumn("log_ratio", F.round("log_ratio", 9))
    return rows.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "log_ratio", (F.col("log_ratio") - F.log(-F.log(even))).alias("gumbel_key"))


def top_k(rows: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest values, ties in ascending ``tie``; exact at any k. ``rows``: a stored table."""
    if k <= 0:
        return rows.limit(0)
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if n <= k:
        return rows
    above = 0  # rows over `hi`, all of them taken
    while True:
        inside = rows.where((F.col(column) >= lo) & (F.col(column) <= hi))
        if n <= FEW or lo == hi:
            break
        step = (hi - lo) / BINS
        number = F.least(F.greatest(F.floor((F.col(column) - F.lit(float(lo))) / F.lit(float(step))), F.lit(0)), F.lit(BINS - 1))
        bins = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}  # BINS at most
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                n, lo, hi = bins[b]
                break
            above += bins[b][0]
    over = rows.where(F.col(column) > hi)
    if n <= FEW:
        return over.unionAll(inside.orderBy(F.desc(column), tie).limit(k - above))
    # over FEW rows with one and the same value, which only repeats of one row have, as the noise depends on the id
    return over.unionAll(inside.orderBy(tie).limit(k - above))


def resample(docs: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 17) -> DataFrame:
    """The sample: ceil(fraction * rows) rows (doc_id, log_ratio, gumbel_key)."""
    scored = saved(score(docs, fit(docs, targets), seed), "importance")
    return top_k(scored, "gumbel_key", math.ceil(fraction * scored.count()), "doc_id")
