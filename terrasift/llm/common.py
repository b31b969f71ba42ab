"""What the training-data operators share: the shared folder, packed exchanges, hashing.

Packed exchange. Operators that handle hundreds of millions of small records (window hashes,
set tokens) would spend most of their time on row objects. They pack the records of a map task by
bucket into zstd-compressed Arrow blobs, exchange ``(bucket, blob)`` rows with an ordinary Spark
shuffle, and unpack one bucket at a time. Buckets are hash ranges whose number grows with the input,
so that one bucket stays near ``BUCKET_BYTES`` at any size. Everything is recomputable from
its inputs: a lost executor costs its tasks only.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes that one bucket of a packed exchange should hold at most.
BUCKET_BYTES = 24 << 20
#: Text bytes that a Python worker turns into words or hashes at once.
SLICE_BYTES = 2 << 20
#: Records that a map task gathers before it packs them.
PACK_BYTES = 16 << 20
PACKED = "bucket int, kind int, data binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="terrasift-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``shared_path`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the files below a plan, as its optimised form estimates them; of the strings themselves if it can't tell."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found < 1 << 50:
        return found
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return df.select(F.sum(reduce(lambda a, b: a + b, texts, F.lit(0)))).first()[0] or 0


def buckets(df: DataFrame, expansion: float) -> int:
    """Buckets for a packed exchange of ``expansion`` raw bytes for each byte of input files."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, math.ceil(plan_bytes(df) * expansion / BUCKET_BYTES))


def release() -> None:
    """Gives freed memory back: a worker that waits for its next task shouldn't hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Decorator of a map task that releases memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def _blob(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=_IPC) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack(blobs: Iterable[bytes], whole: bool = True) -> pa.Table:
    """Records of a bucket; a chunk a blob unless ``whole``."""
    table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
    return table.combine_chunks() if whole else table


class Packer:
    """Gathers columns of records with their buckets; ``full()`` tells when to take ``batches()``."""

    def __init__(self, kind: int = 0):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, bucket: np.ndarray, columns: dict[str, object]) -> None:
        if not len(bucket):
            return
        batch = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
        self.parts.append((bucket.astype(np.int32), batch))
        self.size += batch.nbytes

    def full(self) -> bool:
        return self.size >= PACK_BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket = np.concatenate([b for b, _ in self.parts])
        table = pa.Table.from_batches([b for _, b in self.parts]).combine_chunks()
        self.parts, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, table = bucket[order], table.take(pa.array(order))
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ids, blobs, held = [], [], 0
        for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            ids.append(int(bucket[lo]))
            blobs.append(_blob(table.slice(lo, hi - lo).combine_chunks().to_batches()[0]))
            held += len(blobs[-1])
            if held > 8 << 20:
                yield _rows(ids, self.kind, blobs)
                ids, blobs, held = [], [], 0
        if ids:
            yield _rows(ids, self.kind, blobs)


def _rows(ids: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([kind] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], schema=_PACKED)


def by_bucket(packed: DataFrame, n: int, work: Callable[[int, dict[int, pa.Table]], Iterator[pa.RecordBatch]], schema: str, whole: bool = True) -> DataFrame:
    """Deals packed blobs out by bucket and calls ``work(bucket, {kind: records})`` for one bucket at a time."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != at and held:
                    yield from work(at, {k: unpack(v, whole) for k, v in held.items()})
                    held = {}
                at = bucket
                held.setdefault(kind, []).append(data.as_buffer())
        if held:
            yield from work(at, {k: unpack(v, whole) for k, v in held.items()})

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__key``: 16 bytes that stand for the text (null as empty)."""
    return docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has about ``limit`` bytes of text; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray([0 if x is None else x for x in pc.binary_length(col).to_pylist()], dtype=np.int64)
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if batch.num_rows > lo:
        yield batch.slice(lo)


def _inside(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Bytes that belong to words. UNSPACED: all but the six ASCII spaces. WORDS: ASCII letters, digits, underscore, and all of
#: characters beyond ASCII.
UNSPACED = _inside(lambda b: b != 32 and not 9 <= b <= 13)
WORDS = _inside(lambda b: b >= 128 or chr(b).isalnum() or b == 95)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Hashed:
    """The words of some texts as 64-bit hashes: ``flat`` in a row, ``n`` of each text, ``starts`` in ``data``.

    ``data`` holds the texts with a newline behind each; ``at`` are the texts' places in it. No word becomes a Python object.
    """

    def __init__(self, contents: list[bytes], inside: np.ndarray):
        padded = b"\n".join([*contents, b"\n" * 7])
        self.at = offsets(np.array([len(c) + 1 for c in contents], dtype=np.int64))
        self.data = np.frombuffer(padded, dtype=np.uint8)[: self.at[-1]]
        word = np.frombuffer(padded.translate(inside.tobytes()), dtype=bool)[: self.at[-1]]  # a newline, outside of words, is last
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[:1].any():
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.flat = string_hashes(padded, self.starts, self.ends)
        self.n = np.diff(np.searchsorted(self.starts, self.at))


def string_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings in ``data``, which goes on for 7 bytes behind the last one.

    A string is read in words of eight bytes; each is mixed with its place before they are added, so that neither the order of
    words nor regular patterns (as a polynomial modulo 2**64 would) cancel out. Strings of up to eight bytes never collide with their like.
    """
    at_any = np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    out = mix(at_any[starts] & _HEAD[np.minimum(size, 8)], seed)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # words after the first
        nth = ranges(np.ones(len(long), np.int64), more)
        place = np.repeat(starts[long], more) + 8 * nth
        left = np.repeat(ends[long], more) - place
        each = mix((at_any[place] & _HEAD[np.minimum(left, 8)]) ^ mix(nth.astype(np.uint64), seed + 1), seed + 2)
        out[long] += np.add.reduceat(each, np.concatenate([[0], np.cumsum(more)[:-1]]))
    return mix(out ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), seed + 3)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of pairs, first and second told apart."""
    x = a * np.uint64(0xC2B2AE3D27D4EB4F + 2 * seed) + b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25 + 2 * seed)
    return x ^ (x >> np.uint64(29))


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of ``width`` values, by doubling; mixed at each step, so that no pattern of values cancels out."""
    run, size, done, filled = values, 1, None, 0  # run: windows of `size`; done: windows of `filled`, the part of width taken so far
    if len(values) < width:
        return values[:0]
    while True:
        if width & size:
            if done is None:
                done, filled = run, size
            else:
                m = len(values) - filled - size + 1
                done, filled = joined(done[:m], run[filled : filled + m], seed + 64 + size), filled + size
        if filled == width:
            return done
        m = len(run) - size
        run, size = joined(run[:m], run[size : size + m], seed + size), size * 2


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` values, by doubling; the last ``width - 1`` places are void."""
    n = len(values)
    out = np.zeros(n, dtype=np.uint64)
    if n < width:
        return out
    power, run, size = base, values, 1  # run: hashes of windows of `size`
    done, filled = None, 0  # done: hashes of windows of `filled`, the part of width taken so far
    while True:
        if width & size:
            if done is None:
                done, filled = run, size
            else:  # the run goes behind what is there
                m = len(values) - filled - size + 1
                done = done[:m] * np.uint64(power) + run[filled : filled + m]
                filled += size
        if filled == width:
            break
        m = len(run) - size
        run = run[:m] * np.uint64(power) + run[size : size + m]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2
    out[: len(done)] = done
    return out


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + counts[i] - 1`` of all i in a row."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return at + np.arange(total)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans that neither overlap nor touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[first], ends[np.append(first[1:] - 1, len(starts) - 1)]
