"""Byte-level BPE by overlapping chunks.

Texts of at most ``chunk`` characters are encoded where they are. Longer ones are cut into overlapping
chunks that are pre-tokenised in parallel. Where two neighbours name the same pre-token boundary inside their
overlap they have resynchronised: the scan has no memory, so from a common boundary on both see the
same pre-tokens. Cutting there gives pieces that are encoded in parallel and put together by their order. Only boundaries behind a
character that isn't white space count: a run of spaces at the end of a piece would look ahead to the text's end instead of the next
word. A text with an overlap that never resynchronises (one endless run of letters) is encoded in one piece.

Defined cases: null text is empty; an empty text has no tokens; an empty table gives an empty result; a very long text is cut in one
pass and never encoded as a prefix; any columns of the input stay out of the way because only id and text are read; repeated rows
give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed

#: Characters of a chunk and of the overlap of two chunks.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=2)
def load(ranks: str, pattern: str):
    """The encoding of a rank file. The file must be reachable on every executor."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _encoder(ranks: str, pattern: str, keep: list[tuple[str, pa.DataType]]):
    schema = pa.schema([*keep, ("ids", pa.binary())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = [enc.encode_to_numpy(x, allowed_special=set(), disallowed_special=()).astype("<u4").tobytes() for x in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k).cast(t) for k, t in keep), pa.array(ids, pa.binary())], schema=schema)

    return run


def _boundaries(pattern: str, overlap: int):
    """For each chunk: boundaries near its start and near its end, as offsets in the text."""
    schema = pa.schema([("__row", pa.string()), ("__chunk", pa.int64()), ("__head", pa.list_(pa.int64())), ("__tail", pa.list_(pa.int64()))])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        scan, blank = regex.compile(pattern).finditer, regex.compile(r"[\s\x1c-\x1f]").match
        for batch in batches:
            head, tail = [], []
            for text, start, last in zip(*(batch.column(k).to_pylist() for k in ("__text", "__start", "__last")), strict=True):
                at = np.fromiter((m.start() for m in scan(text) if m.start() and not blank(text[m.start() - 1])), dtype=np.int64)
                head.append((at[at <= overlap] + start).tolist())
                tail.append([] if last else (at[at >= len(text) - overlap] + start).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__chunk"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], schema=schema)

    return run


def _cut(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping chunks of a text of ``n`` characters."""
    step = chunk - overlap
    return [(k * step, min(n, k * step + chunk)) for k in range((n - overlap - 1) // step + 1)]


def _parts(spans, columns: dict[str, pa.DataType], extra: list[str]):
    """Cuts texts in one pass over each: rows of ``columns``, made by ``spans(text, *extra)``."""
    schema = pa.schema(columns.items())

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row, text, *more in zip(*(batch.column(c).to_pylist() for c in ["__row", "__text", *extra]), strict=True):
                for k, (lo, hi, *rest) in enumerate(spans(text, *more)):
                    rows.append((row, k, *rest, text[lo:hi]))
                    held += hi - lo
                    if held > 2 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id, ``ids``): the token ids of each text as little-endian unsigned 32-bit integers."""
    id_type = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    arrow_id = _arrow(id_type)
    id_ddl = id_type.simpleString()
    size = F.length("__text")
    short = base.where(size <= chunk).mapInArrow(_encoder(ranks, pattern, [("__id", arrow_id)]), f"__id {id_ddl}, ids binary")

    long = base.where(size > chunk).withColumn("__row", F.concat_ws(":", F.md5("__text"), F.col("__id").cast("string")))
    once = long.dropDuplicates(["__row"])  # repeated rows have equal ids
    text = {"__row": pa.string(), "__chunk": pa.int64(), "__start": pa.int64(), "__last": pa.bool_(), "__text": pa.string()}
    spans = lambda t: [(lo, hi, lo, hi == len(t)) for lo, hi in _cut(len(t), chunk, overlap)]
    chunks = once.select("__row", "__text").mapInArrow(_parts(spans, text, []), "__row string, __chunk bigint, __start bigint, __last boolean, __text string").repartition("__row", "__chunk")
    seen = chunks.mapInArrow(_boundaries(pattern, overlap), "__row string, __chunk bigint, __head array<bigint>, __tail array<bigint>")
    # one row a text: the chunks in order, then the first common boundary of each two neighbours
    cuts = seen.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__chunk", "__head", "__tail"))).alias("c")).select(
        "__row",
        F.expr("transform(sequence(1, size(c) - 1), i -> array_min(array_intersect(c[i - 1].__tail, c[i].__head)))").alias("__cuts"),
    )
    pieces = (
        once.join(cuts, "__row")
        .withColumn("__cuts", F.when(F.exists("__cuts", lambda x: x.isNull()), F.array().cast("array<bigint>")).otherwise(F.col("__cuts")))
        .select("__row", "__text", "__cuts")
        .mapInArrow(_parts(lambda t, cuts: list(zip([0, *cuts], [*cuts, len(t)], strict=True)), {"__row": pa.string(), "__piece": pa.int64(), "__text": pa.string()}, ["__cuts"]), "__row string, __piece bigint, __text string")
        .repartition("__row", "__piece")
    )
    ids = pieces.mapInArrow(_encoder(ranks, pattern, [("__row", pa.string()), ("__piece", pa.int64())]), "__row string, __piece bigint, ids binary")
    whole = ids.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__piece", "ids"))).alias("p")).select("__row", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    put_together = long.select("__row", F.col("__id").alias(id_col)).join(whole, "__row").select(id_col, "ids")
    return short.withColumnRenamed("__id", id_col).unionByName(put_together)


def decode(tokens: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds ``bytes``: the raw bytes of the tokens, concatenated. Null ids give null."""
    fields = [f for f in tokens.schema.fields if f.name != out_col]
    arrow = pa.schema([*((f.name, _arrow(f.dataType)) for f in fields), (out_col, pa.binary())])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(ranks, pattern)
        for batch in batches:
            for part in slices(batch, ids_col):
                out = [None if x is None else enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).cast(arrow.field(f.name).type) for f in fields), pa.array(out, pa.binary())], schema=arrow)

    return tokens.select(*(f.name for f in fields)).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` binary"]))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
