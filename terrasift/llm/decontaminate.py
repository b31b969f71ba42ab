"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least ``threshold`` of its distinct five-word shingles occur there. Items
are partitioned by their number of shingles n; a partition's MinHash sketch is the k(n) = n - ceil(threshold n) + 1
smallest hashed shingles. A document that contains an item misses at most n - ceil(threshold n) of them, so it
shares at least one sketch value whatever its own length: the search loses nothing. Documents that
share a value are verified by exact containment of all shingles.

Items are shingled on the executors into a stored table of their shingles, whose size is known before anything is sent. Up to ``BLOCK`` shingles
(16 MB of arrays) go to every executor, and documents are only scanned. A larger benchmark stays where it is: one scan of the documents sends the
shingles that a filter of fixed size lets through, and the sketches meet them by hash; candidates are counted by
(document, item) against all shingles in the same way. No size takes more than one scan a search.

Defined cases: null texts are empty; a text or item without words is never contained and contains nothing; an item of one to four words
is contained where these words follow each other, in a document of any length; a containment equal to the threshold counts; several items and repeated
rows each give their rows; very long documents are scanned whole; rows with a null id are kept and reported; ids may be of any type; other columns
may have any names; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, offsets, ranges, saved, slices, trimmed, windows, with_key
from .shingles import WIDTH, lower_words, sets

THRESHOLD = 0.8
#: Shingles of items that go to the executors at once; bits of the filter for larger benchmarks, as a power of two.
BLOCK, FILTER = 1_000_000, 27


def _shingles(texts: list[str | None], widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of all ``widths``, text by text, and how many each text has."""
    found = lower_words(texts)
    at, parts = offsets(found.n), []
    for w in widths:
        counts = np.maximum(found.n - w + 1, 0)
        own = np.repeat(np.arange(len(texts)), counts)
        parts.append((own, mix(windows(found.flat, w), 40 + w)[ranges(at[:-1][counts > 0], counts[counts > 0])]))
    own, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(own, kind="stable")
    return flat[order], np.bincount(own, minlength=len(texts))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, width, size, values): an item's distinct shingles, of as many words as it has if these are under five."""
    schema = pa.schema([("item", pa.string()), ("width", pa.int32()), ("size", pa.int64()), ("values", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text"):
            texts, items = part.column("text").to_pylist(), part.column("item").to_pylist()
            n = lower_words(texts).n
            for w in range(1, WIDTH + 1):
                some = np.flatnonzero(n >= w if w == WIDTH else n == w)
                if len(some):
                    flat, counts = sets(*_shingles([texts[i] for i in some], (w,)))
                    at = offsets(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in some], pa.string()), pa.array([w] * len(some), pa.int32()), pa.array(counts, pa.int64()), pa.array([flat[at[k] : at[k + 1]].tobytes() for k in range(len(some))], pa.binary())], schema=schema)


def _sketch(values: np.ndarray, threshold: float) -> np.ndarray:
    """The k(n) smallest of an item's sorted hashes."""
    n = len(values)
    return values[: n - math.ceil(threshold * n - 1e-9) + 1]


class _Items:
    """Sketches and shingle sets of items."""

    def __init__(self, rows: list, threshold: float):
        self.ids, self.widths = [r["item"] for r in rows], tuple(sorted({r["width"] for r in rows}))
        sets_ = [np.frombuffer(r["values"], dtype=np.uint64) for r in rows]
        self.values, self.at = np.concatenate([np.zeros(0, np.uint64), *sets_]), offsets(np.array([len(x) for x in sets_], dtype=np.int64))
        self.need = np.array([math.ceil(threshold * len(x) - 1e-9) for x in sets_], dtype=np.int64)
        sketches = [_sketch(x, threshold) for x in sets_]
        sketch, owner = np.concatenate([np.zeros(0, np.uint64), *sketches]), np.repeat(np.arange(len(sets_)), [len(x) for x in sketches])
        order = np.argsort(sketch, kind="stable")
        self.sketch, self.owner = sketch[order], owner[order]
        self.bits = np.zeros(1 << 20, dtype=bool)  # most documents' shingles stop here
        self.bits[(self.sketch >> np.uint64(44)).astype(np.int64)] = True

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of what is contained."""
        if not self.widths:
            return
        flat, counts = _shingles(texts, self.widths)
        at, own = offsets(counts), np.repeat(np.arange(len(counts)), counts)
        hit = np.flatnonzero(self.bits[(flat >> np.uint64(44)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.sketch, flat[hit], side) for side in ("left", "right"))
        items, who = self.owner[ranges(lo[hi > lo], (hi - lo)[hi > lo])], np.repeat(own[hit], hi - lo)
        for i, j in sorted(set(zip(who.tolist(), items.tolist(), strict=True))):
            shared = int(np.isin(self.values[self.at[j] : self.at[j + 1]], flat[at[i] : at[i + 1]]).sum())
            if shared >= self.need[j]:
                yield i, j, shared


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Stored rows (item, width, size, values) and the number of shingles of all."""
    rows = saved(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(trimmed(_item_rows), "item string, width int, size bigint, values binary"), "items")
    return rows, rows.agg(F.sum("size")).first()[0] or 0


def _search(sent):
    schema = pa.schema([("doc", pa.string()), ("item", pa.string()), ("shared", pa.int64()), ("size", pa.int64())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        size = np.diff(items.at)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(part.column("doc")[i].as_py(), items.ids[j], shared, int(size[j])) for i, j, shared in items.found(part.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _exchanged(docs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (__key, item, shared, size) for distinct texts of ``docs`` (__key, text), when the items are too many to send."""
    spark = docs.sparkSession
    widths = tuple(r.width for r in rows.select("width").distinct().orderBy("width").collect())  # five at most

    @trimmed
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, size, values in zip(*(batch.column(c).to_pylist() for c in ("item", "size", "values")), strict=True):
                h = np.frombuffer(values, dtype=np.uint64)
                head = len(_sketch(h, threshold))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(h)), pa.array([size] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(np.arange(len(h)) < head)], names=["item", "size", "h", "sketch"])

    wanted = saved(rows.mapInArrow(spread, "item string, size bigint, h bigint, sketch boolean"), "item-shingles")
    used = np.zeros(1 << FILTER, dtype=bool)  # of fixed size, whatever the benchmark's
    slot = F.shiftrightunsigned("h", 64 - FILTER)
    for part in wanted.select(F.expr(f"shiftrightunsigned(h, {64 - FILTER + 16})").cast("int").alias("page"), slot.alias("slot")).groupBy("page").agg(F.collect_set("slot").alias("slots")).toLocalIterator():
        used[np.array(part.slots, dtype=np.int64)] = True
    sent = spark.sparkContext.broadcast(np.packbits(used))

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = sets(*_shingles(part.column("text").to_pylist(), widths))
                own = np.repeat(np.arange(len(counts)), counts)
                yes = bits[(flat >> np.uint64(64 - FILTER)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("__key").cast(pa.binary()).take(pa.array(own[yes])), pa.array(flat[yes].view(np.int64))], names=["__key", "h"])

    probes = saved(docs.dropDuplicates(["__key"]).mapInArrow(scan, "__key binary, h bigint"), "probes")
    candidates = probes.join(wanted.where("sketch"), "h").select("__key", "item").distinct()
    counted = probes.join(wanted, "h").join(candidates, ["__key", "item"], "left_semi").groupBy("__key", "item", "size").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("size") - 1e-9)).select("__key", "item", "shared", "size")


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, item_id, shared, size): items of which a document holds at least ``threshold`` of the shingles."""
    items, total = _items(benchmark, item_col, item_text)
    rows = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    if total <= block:
        sent = docs.sparkSession.sparkContext.broadcast(_Items(items.collect(), threshold))  # ``block`` shingles at most
        found = rows.mapInArrow(_search(sent), "doc string, item string, shared bigint, size bigint")
    else:
        rows = with_key(rows)
        found = rows.select("doc", "__key").join(_exchanged(rows.select("__key", "text"), items, threshold), "__key")
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    return found.select(F.col("doc").cast(kinds[0]).alias(id_col), F.col("item").cast(kinds[1]).alias(item_col), "shared", "size")


def _clean(docs: DataFrame, items: _Items) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    from pyspark.sql.pandas.types import to_arrow_type

    sent = docs.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in docs.schema.fields])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[i for i, _, _ in sent.value.found(part.column("text").to_pylist())]] = False
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(part.filter(pa.array(keep)).columns, schema.types, strict=True)], schema=schema)

    return docs.mapInArrow(run, docs.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` that contain no item, with their columns."""
    items, total = _items(benchmark, "item_id", "text")
    if total <= block:
        return _clean(docs, _Items(items.collect(), threshold))
    name = "__key"
    while name in docs.columns:
        name += "_"
    found = _exchanged(with_key(docs.select("text")).select("__key", "text"), items, threshold).select(F.col("__key").alias(name)).distinct()
    return docs.withColumn(name, F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(found, name, "left_anti").select(*docs.columns)


__all__ = ["contained", "keep_clean"]
