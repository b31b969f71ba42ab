"""Substring dedup of bytes by merging the suffix orders of shards.

A suffix array of every byte is out of reach of a shuffle (each refinement round would exchange the whole corpus), so the
suffixes are thinned first, without loss: every window of ``window`` bytes has a smallest hashed ``GRAM``-byte string (a
minimiser), both places of a repeat have it at the same offset, and minimisers that occur once can't be in a
repeat. The suffixes that start at the others take part:

* A shard is what a map task gathers. It sorts its suffixes once, by what follows and by what stands in front, and keeps the bytes
  in front of each (as a Burrows-Wheeler transform keeps one symbol, here as many as a window can take).
* Shards are merged by refining their interleave, eight bytes a round: rows of one block agree so far, a round orders each open
  block by the next symbol and splits it where symbols differ. Rows of a shard come in order, so a block is a few ascending
  runs that a stable sort merges; rows alone in their block are finished, and no suffix is compared from its start again.
* The depth at which two neighbours part is their longest common prefix. To the right it bounds how far a match goes
  on, to the left (the kept bytes in front) how far it reaches back.
* A window that takes l bytes in front of the minimiser repeats if another row shares the interval of l bytes to the
  left and the interval of the rest to the right: repeated intervals come from the two merged orders alone.

Rows of a shard whose whole surroundings agree are known to repeat there and then; one of them goes to the merge and the others take a
short way, so a passage that very many texts share costs its minimisers' blocks a row a shard.

The comparison is exact: blocks split on the bytes themselves.

Defined cases: a null text is empty; texts shorter than a window keep everything; a text that occurs twice loses
every byte if it has a window at all; repeats may overlap each other; very long texts are scanned in one piece by one task and never
cut; other columns of the table aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PACK_BYTES, PACKED, Packer, buckets, by_bucket, merge_spans, mix, offsets, rolling
from .repeats import ANCHOR, FOUND, Text, anchors, by_doc, key_of, keyed, packed_texts, short, texts_of

WINDOW, GRAM = 200, 40
_BASE = 0x9E6C63D0876A9A47
RESULT = "key binary, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


# ---------------------------------------------------------------- minimisers


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` values in a row, by block prefixes and suffixes."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    fold = np.minimum if least else np.maximum
    fill = x.dtype.type(np.iinfo(x.dtype).max if least else 0)
    blocks = np.full((-(-len(x) // width) + 1) * width, fill, dtype=x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    behind = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[:n], ahead[width - 1 : width - 1 + n])


def minimisers(flat: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the strings that are the smallest of some window; equal smallest ones all count."""
    n = len(flat)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix(rolling(flat.astype(np.uint64) + np.uint64(1), gram, _BASE))
    width = window - gram + 1
    least = _sliding(h, width, True)[: n - window + 1]
    ends = np.repeat(offsets(lengths)[1:], lengths)[: n - window + 1]
    least = np.where(np.arange(len(least)) + window <= ends, least, np.uint64(0))  # windows that leave their text
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(padded, width, False)  # over the windows that contain a place
    at = np.flatnonzero(most == h[: len(most)])
    at = at[h[at] != 0]
    return at, h[at]


def _scan(window: int, gram: int):
    def of(texts: list[Text]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        contents = [c if len(c) >= window else b"" for _, c, _ in texts]
        lengths = np.array([len(c) for c in contents], dtype=np.int64)
        at, h = minimisers(np.frombuffer(b"".join(contents), dtype=np.uint8), lengths, window, gram)
        return h, np.ones(len(h), dtype=bool), np.searchsorted(offsets(lengths), at, "right") - 1

    return of


def _repeats(group: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return np.bincount(group) > 1


#: Kinds of records of a shard: suffixes with their surroundings, and places that are known to repeat.
SUFFIX, KNOWN = 0, 1


def _strings(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that sort as such."""
    return np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel()


def _shard(rows: list[tuple], n: int, side: int) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of a shard, in both directions, and packs them by minimiser."""
    h, matrix, left, right, doc, key2, at = (np.concatenate(x) for x in zip(*rows, strict=True))
    big = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    order = np.argsort(_strings(np.concatenate([big, matrix[:, side:]], axis=1)), kind="stable")
    behind = np.empty(len(h), dtype=np.int32)
    behind[np.argsort(_strings(np.concatenate([big, matrix[:, :side][:, ::-1]], axis=1)), kind="stable")] = np.arange(len(h))
    whole = _strings(np.concatenate([big, matrix, left.astype(">i2").view(np.uint8).reshape(-1, 2), right.astype(">i2").view(np.uint8).reshape(-1, 2), np.ones((len(h), 1), np.uint8)], axis=1))
    _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    lone = np.zeros(len(h), dtype=bool)
    lone[first] = True
    known = np.flatnonzero(~lone & (left + right >= side))
    order = order[lone[order]]
    main, rest = Packer(SUFFIX), Packer(KNOWN)
    main.add((h[order] >> np.uint64(20)) % np.uint64(n), {
        "h": h[order], "context": pa.FixedSizeBinaryArray.from_buffers(pa.binary(matrix.shape[1]), len(order), [None, pa.py_buffer(np.ascontiguousarray(matrix[order]))]),
        "behind": behind[order], "left": left[order].astype(np.int16), "right": right[order].astype(np.int16), "more": (count[back.ravel()] > 1)[order], "doc": doc[order], "key2": key2[order], "at": at[order],
    })
    rest.add(doc[known] % np.uint32(n), {"doc": doc[known], "second": key2[known], "start": (at - left)[known], "end": (at + (matrix.shape[1] - 2 * side) + right)[known]})
    yield from main.batches()
    yield from rest.batches()


def _contexts(window: int, gram: int, n: int):
    """Suffixes at repeated minimisers, by shards."""
    side = window - gram

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        hits, rows, size = by_doc(records, ["h"]), [], 0
        for doc, key2, content, _ in texts_of(records):
            wanted = hits(doc)[0]
            if not len(wanted):
                continue
            flat = np.frombuffer(content, dtype=np.uint8)
            at, h = minimisers(flat, np.array([len(flat)]), window, gram)
            ok = np.isin(h & ANCHOR, wanted)
            at, h = at[ok], h[ok]
            padded = np.frombuffer(b"\0" * side + content + b"\0" * side, dtype=np.uint8)
            around = np.lib.stride_tricks.sliding_window_view(padded, 2 * side + gram)
            for lo in range(0, len(at), 20_000):
                a, hash_ = at[lo : lo + 20_000], h[lo : lo + 20_000]
                rows.append((hash_, around[a], np.minimum(a, side), np.minimum(len(flat) - gram - a, side), np.full(len(a), short(doc), np.uint32), np.full(len(a), key2, np.uint64), a.astype(np.int64)))
                size += len(a) * (2 * side + gram + 40)
                if size >= PACK_BYTES:
                    yield from _shard(rows, n, side)
                    rows, size = [], 0
        if rows:
            yield from _shard(rows, n, side)

    return work


# ---------------------------------------------------------------- merge


def interleave(block: np.ndarray, symbols: np.ndarray, runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of rows and the common prefix, in bytes, of each with the one before it (-1 between blocks).

    ``block``: rows of one block may be merged; ``symbols``: the rows' next bytes, as big-endian words; ``runs``: the rows, shard by shard in
    their shard's order (as they come if None). The rows of ``order`` stay in place from round to round except inside
    blocks that a round splits; there the shards' rows are ascending runs, which the stable sort merges.
    """
    runs = np.arange(len(block)) if runs is None else runs
    order = runs[np.argsort(block[runs], kind="stable")]
    b = block[order]
    lcp = np.full(len(order), 8 * symbols.shape[1], dtype=np.int64)
    new = np.concatenate([[True], b[1:] != b[:-1]])
    lcp[new] = -1
    for depth in range(symbols.shape[1]):
        begin = np.flatnonzero(lcp < 8 * depth) if depth else np.flatnonzero(lcp < 0)
        size = np.diff(np.append(begin, len(order)))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        number = np.repeat(np.arange(len(begin)), size)[at]
        symbol = symbols[order[at], depth]
        move = np.lexsort((symbol, number))
        order[at] = order[at[move]]
        symbol = symbol[move]
        inside = np.concatenate([[False], number[1:] == number[:-1]])
        apart = inside & np.concatenate([[False], symbol[1:] != symbol[:-1]])
        where = np.flatnonzero(apart)
        differ = symbol[where] ^ symbol[where - 1]
        lcp[at[where]] = 8 * depth + _leading_zero_bytes(differ)
    return order, lcp


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(x), dtype=np.int64), x.copy()
    for step in (4, 2, 1):
        zero = rest < (np.uint64(1) << np.uint64(64 - 8 * step))
        out[zero] += step
        rest = np.where(zero, rest << np.uint64(8 * step), rest)
    return out


def _words(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def repeated_windows(h: np.ndarray, matrix: np.ndarray, left: np.ndarray, right: np.ndarray, more: np.ndarray, behind: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how far its repeated windows reach to the left and to the right of the minimiser; (-1, -1) if none repeats.

    ``more``: rows that stand for others like them; ``behind``: the rows, in their shards' order of what stands in front.
    """
    side, n = window - gram, len(h)
    reach = np.full((2, n), -1, dtype=np.int64)
    _, block = np.unique(h, return_inverse=True)
    r_order, r_lcp = interleave(block, _words(matrix[:, side:]))
    # the interval of the minimiser itself, then its rows' left sides
    tie = np.zeros(n, dtype=np.int64)
    tie[r_order] = np.cumsum(r_lcp < gram)
    l_order, l_lcp = interleave(tie, _words(matrix[:, :side][:, ::-1]), behind)
    # rows that are equal as a whole: all of their windows repeat, and one of them stands for the rest
    whole = np.zeros((2, n), dtype=np.int64)
    whole[0][r_order] = np.cumsum(r_lcp < window)
    whole[1][l_order] = np.cumsum(l_lcp < side)
    # rows that end at a text's border are equal only if they end alike
    _, first, back, count = np.unique(np.stack([whole[0], whole[1], left, right]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    back = back.ravel()
    twin = (count > 1)[back] | more
    fits = left + right >= side
    reach[0][twin & fits], reach[1][twin & fits] = left[twin & fits], right[twin & fits]
    rows = first[np.isin(tie[first], np.flatnonzero(np.bincount(tie[first]) > 1))] if len(first) else first
    if len(rows) > 1:
        far = np.full((2, len(rows)), -1, dtype=np.int64)
        least = np.full(len(rows), side + 1, dtype=np.int64)
        r_name, l_name = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for l_bytes in range(side + 1):
            r_name[r_order] = np.cumsum(r_lcp < gram + side - l_bytes)
            l_name[l_order] = np.cumsum(l_lcp < l_bytes) if l_bytes else np.cumsum(l_lcp < 0)
            ok = np.flatnonzero((left[rows] >= l_bytes) & (right[rows] >= side - l_bytes))
            if len(ok) < 2:
                continue
            name = r_name[rows[ok]] * (n + 1) + l_name[rows[ok]]
            order = np.argsort(name, kind="stable")
            s = name[order]
            same = s[1:] == s[:-1]
            hit = ok[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
            far[0][hit] = l_bytes
            least[hit] = np.minimum(least[hit], l_bytes)
        far[1] = np.where(far[0] >= 0, side - least, -1)
        reach[:, rows] = np.maximum(reach[:, rows], far)
    return reach[0], reach[1]


def _merged(window: int, gram: int, by_key: int):
    """Packed spans (doc, second, start, end) by document."""
    side = window - gram

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        packer = Packer(FOUND)
        if KNOWN in records:
            known = records[KNOWN]
            packer.add(known["doc"].to_numpy() % np.uint32(by_key), {c: known[c].combine_chunks() for c in ("doc", "second", "start", "end")})
            yield from packer.batches()
        if SUFFIX not in records:
            return
        r = records[SUFFIX]
        h, size = r["h"].to_numpy(), 2 * side + gram
        raw = r["context"].combine_chunks() if r["context"].num_chunks != 1 else r["context"].chunk(0)
        matrix = np.frombuffer(raw.buffers()[1], dtype=np.uint8)[raw.offset * size :][: len(raw) * size].reshape(len(raw), -1)
        left, right, at, doc = r["left"].to_numpy().astype(np.int64), r["right"].to_numpy().astype(np.int64), r["at"].to_numpy(), r["doc"].to_numpy()
        shard = np.repeat(np.arange(r["h"].num_chunks), [len(c) for c in r["h"].chunks])
        back, on = repeated_windows(h, matrix, left, right, r["more"].to_numpy(), np.lexsort((r["behind"].to_numpy(), shard)), window, gram)
        ok = back >= 0
        if not ok.any():
            return
        packer.add(doc[ok] % np.uint32(by_key), {"doc": doc[ok], "second": r["key2"].to_numpy()[ok], "start": (at - back)[ok], "end": (at + gram + on)[ok]})
        yield from packer.batches()

    return work


def _kept(window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("spans", kind), ("kept", pa.binary())])

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        found, rows, size = by_doc(records, ["second", "start", "end"]), [], 0
        for doc, key2, content, copies in texts_of(records):
            second, start, end = found(doc)
            if copies > 1 and len(content) >= window:
                start, end = np.array([0]), np.array([len(content)])
            elif len(start):
                mine = second == np.uint64(key2)
                start, end = merge_spans(start[mine], end[mine])
            kept, at = [], 0
            for lo, hi in zip(start.tolist(), end.tolist(), strict=True):
                kept.append(content[at:lo])
                at = hi
            kept = b"".join([*kept, content[at:]])
            rows.append((key_of(doc, key2), len(content), [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)], kept))
            size += len(kept) + 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return work


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (key, n_bytes, spans, kept), one a distinct text; ``repeats.attach`` gives them to the rows of ``docs``.

    spans: the removed maximal runs of bytes. ``window`` and ``gram`` are multiples of eight.
    """
    texts = keyed(docs, text)
    n, by_key, wide = buckets(docs, 0.8), buckets(docs, 2.5), buckets(docs, 4)
    hits = anchors(texts, n, _scan(window, gram), _repeats, by_key)
    contexts = by_bucket(packed_texts(texts, by_key, window).unionAll(hits), by_key, _contexts(window, gram, wide), PACKED)
    spans = by_bucket(contexts, wide, _merged(window, gram, by_key), PACKED, whole=False)
    return by_bucket(packed_texts(texts, by_key, 0).unionAll(spans), by_key, _kept(window), RESULT)
