"""The frame of both repeat removers: anchors, candidates, spans, kept text.

A long enough repeat contains an anchor that both of its places name alike. Scanning the texts yields anchor hashes; those
that occur once are done with. Around the others the method proper decides exactly which windows repeat. Texts are known by
16 bytes (``__key``): equal texts are one text with copies, and a copied text is a repeat as a whole.

Records travel as packed blobs (see ``common``) and only by hash or by key, so no place, source or copied text gathers rows
beyond what a map task has of it: a task sends an anchor of a copied text twice at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Packer, by_bucket, slices, trimmed, with_key

#: Kinds of records in an exchange by key: texts, and what was found about them.
TEXT, FOUND = 0, 1
#: Bits of an anchor's hash that travel; the bucket, of which there are more when there is more text, stands for others. Chance
#: agreements are few and cost a comparison each, never a wrong result.
ANCHOR = np.uint64((1 << 32) - 1)
Text = tuple[bytes, bytes, int]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return with_key(docs, text).select("__key", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"))


def key_parts(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def short(doc: np.ndarray | int) -> np.ndarray | int:
    """The 32 bits of a text's key that decide its bucket and go with anchors; what must tell texts apart carries 64 more."""
    return doc >> 32 if isinstance(doc, int) else (doc >> np.uint64(32)).astype(np.uint32)


def once(part: pa.RecordBatch, seen: dict[bytes, int]) -> Iterator[Text]:
    """Texts of a slice as (key, content, 1), each at most twice a task: more copies say nothing new."""
    for key, content in zip(part.column("__key").to_pylist(), part.column("content").to_pylist(), strict=True):
        n = seen.get(key, 0)
        if n < 2:
            seen[key] = n + 1
            yield key, content, 1


def anchors(texts: DataFrame, n: int, of: Callable[[list[Text]], tuple[np.ndarray, np.ndarray, np.ndarray]], may_match: Callable[[np.ndarray, np.ndarray], np.ndarray], by_key: int) -> DataFrame:
    """Packed (doc, h) by document: anchors that occur more than once, by ``ANCHOR`` bits of their hash.

    ``of(texts)`` gives anchor hashes, flags and the places of their texts; ``may_match(group, flag)`` tells by group of equal
    hashes whether its anchors are candidates.
    """

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(), {}
        for batch in batches:
            for part in slices(batch, "content"):
                if len(seen) > 200_000:
                    seen.clear()
                found = list(once(part, seen))
                if not found:
                    continue
                h, flag, owner = of(found)
                if len(h):
                    doc = short(key_parts([k for k, _, _ in found])[0])[owner]
                    packer.add((h >> np.uint64(40)) % np.uint64(n), {"h": (h & ANCHOR).astype(np.uint32), "flag": flag, "doc": doc})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    def match(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        r = records[0]
        h = r["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        group = np.cumsum(np.concatenate([[False], sorted_h[1:] != sorted_h[:-1]]))
        ok = may_match(group, r["flag"].to_numpy()[order])[group]
        at = order[ok]
        if not len(at):
            return
        packer, doc = Packer(FOUND), r["doc"].to_numpy()[at]
        packer.add(doc % np.uint32(by_key), {"doc": doc, "h": h[at]})
        yield from packer.batches()

    return by_bucket(texts.mapInArrow(scan, PACKED), n, match, PACKED)


def packed_texts(texts: DataFrame, by_key: int, least: int) -> DataFrame:
    """Packed (doc, key2, content) by key; texts of under ``least`` bytes stay out."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(TEXT), {}
        for batch in batches:
            for part in slices(batch, "content"):
                if len(seen) > 200_000:
                    seen.clear()
                found = [x for x in once(part, seen) if len(x[1]) >= least]
                if found:
                    k1, k2 = key_parts([k for k, _, _ in found])
                    packer.add(short(k1) % np.uint32(by_key), {"doc": k1, "key2": k2, "content": pa.array([c for _, c, _ in found], pa.binary())})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return texts.mapInArrow(run, PACKED)


def texts_of(records: dict[int, pa.Table]) -> Iterator[tuple[int, int, bytes, int]]:
    """(doc, key2, content, copies) of a bucket, each text once."""
    r = records.get(TEXT)
    if r is None:
        return
    doc, key2 = r["doc"].to_numpy(), r["key2"].to_numpy()
    order = np.lexsort((key2, doc))
    content, i = r["content"], 0  # in chunks: one array of a bucket's texts might not hold them all
    while i < len(order):
        j = i
        while j < len(order) and doc[order[j]] == doc[order[i]] and key2[order[j]] == key2[order[i]]:
            j += 1
        yield int(doc[order[i]]), int(key2[order[i]]), content[int(order[i])].as_py(), j - i
        i = j


def by_doc(records: dict[int, pa.Table], columns: list[str]) -> Callable[[int], list[np.ndarray]]:
    """Looks up the found records of a text in a bucket, by the ``short`` form of its key."""
    r = records.get(FOUND)
    if r is None:
        return lambda doc: [np.zeros(0, np.int64) for _ in columns]
    doc = r["doc"].to_numpy()
    order = np.argsort(doc, kind="stable")
    doc, held = doc[order], [r[c].to_numpy()[order] for c in columns]

    def look(d: int) -> list[np.ndarray]:
        lo, hi = np.searchsorted(doc, np.uint32(short(d)), "left"), np.searchsorted(doc, np.uint32(short(d)), "right")
        return [x[lo:hi] for x in held]

    return look


def key_of(doc: int, key2: int) -> bytes:
    return np.array([doc, key2], dtype=np.uint64).tobytes()


def attach(docs: DataFrame, results: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: its id and the result of its text; narrow rows, and a hot text splits as a skewed join."""
    ids = with_key(docs, text).select(F.col(id_col), F.col("__key"))
    return ids.join(results.withColumnRenamed("key", "__key"), "__key").drop("__key")
