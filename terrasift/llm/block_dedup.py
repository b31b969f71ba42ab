"""Substring dedup of words by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``block`` words of each text. A window of ``window`` >= 2 * block - 1
words contains a whole block of its own text, wherever it starts. Every rolling run of ``block`` words probes the blocks; a run
that meets a block elsewhere is a hit. Hits are extended word by word to both sides as far as a window that contains them
reaches; the windows on the way meet their like by 128 bits of two independent hashes of their words, and the repeated ones unite
to maximal exact repeats. The hashes are mixed at every step, so no pattern of letters or words makes unlike windows agree; chance
does with a probability of 1e-13 for all windows of 100 TB.

Defined cases: a null text has no words; texts shorter than a window keep everything; a text that occurs twice (in two
rows, or repeated rows) loses every word if it has a window at all; a repeat that touches or overlaps itself counts; very long
texts and words are handled whole; other columns of the table aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PACKED, UNSPACED, Hashed, Packer, buckets, by_bucket, offsets, ranges, string_hashes, windows
from .repeats import ANCHOR, FOUND, Text, anchors, by_doc, key_of, keyed, packed_texts, short, texts_of

WINDOW = 35
RESULT = "key binary, n_words bigint, n_removed bigint, kept binary"


def _probes(block: int, window: int):
    def of(texts: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = Hashed([c for _, c, _ in texts], UNSPACED)
        flat, n = found.flat, found.n
        counts = np.where(n >= window, n - block + 1, 0)
        at = ranges(offsets(n)[:-1], counts)
        inside = ranges(np.zeros(len(n), np.int64), counts)
        return windows(flat, block)[at], inside % block == 0, np.repeat(np.arange(len(n)), counts)

    return of


def _has_block_and_partner(group: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return (np.bincount(group) > 1) & (np.bincount(group, weights=flag) > 0)


def _windows(block: int, window: int, n: int):
    """Around hits: packed (w1, w2, doc, key2, start, copied)."""

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        hits, packer = by_doc(records, ["h"]), Packer()
        for doc, key2, content, copies in texts_of(records):
            wanted = hits(doc)[0]
            if not len(wanted):
                continue
            words = Hashed([content], UNSPACED)
            flat = words.flat
            places = len(flat) - window + 1
            if places < 1:
                continue
            h = windows(flat, block) & ANCHOR
            near = np.zeros(len(h) + 1, dtype=np.int64)  # windows that contain a hit start up to window - block before it
            at = np.flatnonzero(np.isin(h, wanted))
            np.add.at(near, np.maximum(at - (window - block), 0), 1)
            np.add.at(near, at + 1, -1)
            start = np.flatnonzero(np.cumsum(near)[:places] > 0)
            if not len(start):
                continue
            again = string_hashes(content + b"\n" * 8, words.starts, words.ends, 11)
            w1, w2 = windows(flat, window, 1)[start], windows(again, window, 2)[start]
            same = np.ones(len(start), dtype=np.uint64)
            packer.add(w1 % np.uint64(n), {"w1": w1, "w2": w2, "doc": np.full(len(start), short(doc), np.uint32), "key2": same * np.uint64(key2), "start": start.astype(np.uint32), "copied": np.full(len(start), copies > 1)})
            if packer.full():
                yield from packer.batches()
        yield from packer.batches()

    return work


def _repeated(by_key: int):
    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        r = records[0]
        w1, w2 = r["w1"].to_numpy(), r["w2"].to_numpy()
        order = np.lexsort((w2, w1))
        w1, w2 = w1[order], w2[order]
        group = np.cumsum(np.concatenate([[False], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
        ok = ((np.bincount(group) > 1) | (np.bincount(group, weights=r["copied"].to_numpy()[order]) > 0))[group]
        at = order[ok]
        if not len(at):
            return
        packer, doc = Packer(FOUND), r["doc"].to_numpy()[at]
        back = np.lexsort((r["start"].to_numpy()[at], doc))
        at, doc = at[back], doc[back]
        packer.add(doc % np.uint32(by_key), {"doc": doc, "second": r["key2"].to_numpy()[at], "start": r["start"].to_numpy()[at]})
        yield from packer.batches()

    return work


def _kept(window: int):
    schema = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        found, rows, size = by_doc(records, ["second", "start"]), [], 0
        for doc, key2, content, copies in texts_of(records):
            w = content.split()
            second, start = found(doc)
            start = start[second == np.uint64(key2)].astype(np.int64) if len(start) else start
            gone = np.zeros(len(w) + 1, dtype=np.int64)
            if copies > 1 and len(w) >= window:
                gone[0], gone[-1] = 1, -1
            elif len(start):
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            n = int(keep.sum())
            kept = b" ".join(w) if n == len(w) else b" ".join([w[i] for i in np.flatnonzero(keep)])
            rows.append((key_of(doc, key2), len(w), len(w) - n, kept))
            size += len(kept) + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return work


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (key, n_words, n_removed, kept), one a distinct text; ``repeats.attach`` gives them to the rows of ``docs``."""
    block = (window + 1) // 2
    texts = keyed(docs, text)
    n, by_key, wide = buckets(docs, 4.5), buckets(docs, 2.5), buckets(docs, 3)
    hits = anchors(texts, n, _probes(block, window), _has_block_and_partner, by_key)
    windows = by_bucket(packed_texts(texts, by_key, 2 * window - 1).unionAll(hits), by_key, _windows(block, window, wide), PACKED)
    starts = by_bucket(windows, wide, _repeated(by_key), PACKED)
    return by_bucket(packed_texts(texts, by_key, 0).unionAll(starts), by_key, _kept(window), RESULT)
