"""Media columns over archives.

``write_archives`` packs payloads as 8-bit greyscale PNG members into ZIP archives in a folder that all executors
share. ``MediaArchives`` is a Spark data source over such a folder: the driver lists the archives and plans
byte ranges of them; a task reads an archive's directory, takes the members that start in its range, and
streams their payloads in Arrow batches. Every member is read by its offset and retried alone when a read
fails or its checksum differs. ``decode`` gives the samples back.

A task that runs twice writes another archive; only archives named in the committed manifest are read, so
retries and speculation leave the result unchanged.

Defined cases: null text is empty; an empty text has one row of padding; equal texts have equal members; a very long text is one member, however many
ranges it spans; rows with a null id are kept; repeated rows give repeated members; only id and text are read, so other columns may have any names; an
empty table gives an empty result.
"""

from __future__ import annotations

import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_path, slices, trimmed

#: Samples in a row of the image; payloads are padded to a multiple of it.
WIDTH = 192
#: Bytes of an archive after which the next one begins, of a planned range, and of a batch of payloads.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
TRIES, MOST_RANGES = 3, 100_000
MEMBERS = "name string, archive string, offset bigint, media binary, tries int, error string"


# ---------------------------------------------------------------- format


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Spaces up to a positive multiple of ``width``."""
    return data + b" " * (-len(data) % width if data else width)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, unpadded: int, width: int = WIDTH) -> bytes:
    """A greyscale image whose samples are the payload; its text chunk holds the unpadded length."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), dtype=np.uint8)  # filter 0 in front of each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0%d" % unpadded) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 5)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length."""
    at, body, size, length = 8, [], (0, 0), 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"tEXt" and data.startswith(b"length\0"):
            length = int(data[7:])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return raw[:, 1:].tobytes(), length


# ---------------------------------------------------------------- writing


def _writer(root: str):
    schema = pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        held, count = None, 0

        def close():
            archive.close()
            data = held.getvalue()
            name = f"{uuid.uuid4().hex}.zip"  # a task that runs again writes another one
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([len(data)], pa.int64())], schema=schema)

        for batch in batches:
            for part in slices(batch, "content", BATCH_BYTES):
                for key, content in zip(part.column("id").to_pylist(), part.column("content").to_pylist(), strict=True):
                    if held is None:
                        held, count = io.BytesIO(), 0
                        archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                    info = zipfile.ZipInfo(f"{count:08d}/{'' if key is None else key}", (1980, 1, 1, 0, 0, 0))
                    archive.writestr(info, to_png(pad(content), len(content)))
                    count += 1
                    if held.tell() >= ARCHIVE_BYTES:
                        yield close()
                        held = None
        if held is not None:
            yield close()

    return run


def write_archives(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes one member a row and returns the folder; its manifest names the archives that count."""
    root = root or shared_path(docs.sparkSession, "media")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    rows.mapInArrow(_writer(f"{root}/archives"), "archive string, members bigint, bytes bigint").write.parquet(f"{root}/manifest")
    return root


# ---------------------------------------------------------------- reading


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("path", folder)``; option ``range_bytes`` sets the split size.

    ``folder`` is what ``write_archives`` returns, or any folder of ZIP archives with stored members.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tries", TRIES)), self.options.get("on_error", "fail"))


class MediaReader(DataSourceReader):
    def __init__(self, root: str, range_bytes: int, tries: int, on_error: str):
        self.root, self.range_bytes, self.tries, self.on_error = root, range_bytes, tries, on_error

    def _archives(self) -> list[tuple[str, int]]:
        import pyarrow.dataset as ds

        store, folder = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(f"{folder}/manifest").type != fs.FileType.NotFound:
            found = ds.dataset(f"{folder}/manifest", filesystem=store, format="parquet").to_table(columns=["archive", "bytes"]).to_pydict()
            return sorted((f"{folder}/archives/{a}", n) for a, n in zip(found["archive"], found["bytes"], strict=True))
        return sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(folder, recursive=True)) if x.path.endswith(".zip"))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives, wider ones where there would be over ``MOST_RANGES``; only names and sizes come to the driver."""
        archives = self._archives()
        wide = max(self.range_bytes, sum(n for _, n in archives) // MOST_RANGES)
        return [ByteRange(a, at, at + wide) for a, n in archives for at in range(0, n, wide)] or [ByteRange("", 0, 0)]

    def _member(self, store, archive: str, info: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """One member by its offset; a failed or corrupt read is tried again, without its neighbours."""
        error = None
        for n in range(1, self.tries + 1):
            try:
                with store.open_input_file(archive) as f:
                    head = f.read_at(30, info.header_offset)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError("no member at this offset")
                    skip = 30 + sum(struct.unpack("<HH", head[26:30]))
                    data = f.read_at(info.compress_size, info.header_offset + skip)
                if zlib.crc32(data) != info.CRC:
                    raise OSError("checksum differs")
                return data, n, None
            except (OSError, struct.error) as e:
                error = str(e)
                time.sleep(0.05 * 2**n * (n < self.tries))
        if self.on_error == "fail":
            raise OSError(f"{archive} at {info.header_offset}: {error}")
        return None, self.tries, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        schema = pa.schema([("name", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            mine = [x for x in z.infolist() if partition.start <= x.header_offset < partition.end]
        rows, held = [], 0
        for info in mine:
            data, tries, error = self._member(store, partition.archive, info)
            rows.append((info.filename, partition.archive, info.header_offset, data, tries, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_archives(spark, root: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", root).options(**options).load()


def _features(samples: np.ndarray) -> str:
    """Mean, spread, entropy and the most frequent sample, all fixed to four places."""
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    mean = float(counts @ values) / n
    spread = max(0.0, float(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};mode={int(counts.argmax())}"


def decode(members: DataFrame) -> DataFrame:
    """Rows (id string, n_bytes, payload binary, media binary, feature string) from the stored bytes."""
    schema = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", BATCH_BYTES):
                rows = []
                for name, media in zip(part.column("name").to_pylist(), part.column("media").to_pylist(), strict=True):
                    payload, length = from_png(media)
                    rows.append((name.partition("/")[2] or None, length, payload, media, _features(np.frombuffer(payload, dtype=np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return members.select("name", "media").mapInArrow(run, "id string, n_bytes bigint, payload binary, media binary, feature string")


__all__ = ["MediaArchives", "decode", "from_png", "pad", "read_archives", "to_png", "write_archives"]
