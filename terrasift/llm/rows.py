"""Rows of a table exchanged in packed form, and records that look for their rows.

A row is known by its id and 16 bytes of its text; hot ids or texts spread because both decide the bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Packer, mix, slices, trimmed
from .repeats import FOUND, TEXT, key_parts

#: Stands for a null id; ids come after all others with it.
NOBODY = np.int64(np.iinfo(np.int64).max)


def ids_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the largest) and text keys of the rows."""
    ids = pc.fill_null(part.column("doc_id").cast(pa.int64()), int(NOBODY)).to_numpy(zero_copy_only=False)
    return ids, *key_parts(part.column("__key").to_pylist())


def row_bucket(ids: np.ndarray, k1: np.ndarray, n: int) -> np.ndarray:
    return mix(ids.view(np.uint64) ^ k1, 2) % np.uint64(n)


def packed_rows(n: int):
    """Packs all columns of the rows by row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TEXT)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, k1, k2 = ids_of(part)
                packer.add(row_bucket(ids, k1, n), {**{f"c_{x}": part.column(x) for x in part.schema.names if x != "__key"}, "id": ids, "k1": k1, "k2": k2})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return run


def packed_found(n: int, columns: list[str]):
    """Packs records (doc_id, __key, ...) by their row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(FOUND)
        for batch in batches:
            ids, k1, k2 = ids_of(batch)
            packer.add(row_bucket(ids, k1, n), {"id": ids, "k1": k1, "k2": k2, **{c: batch.column(c) for c in columns}})
            if packer.full():
                yield from packer.batches()
        yield from packer.batches()

    return run


def by_row(table: pa.Table | None) -> Callable[[tuple[int, int, int]], np.ndarray]:
    """Looks up the places of a row's records."""
    if table is None:
        return lambda row: np.zeros(0, np.int64)
    ids, k1, k2 = (table[c].to_numpy() for c in ("id", "k1", "k2"))
    order = np.lexsort((k2, k1, ids))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
    at = np.flatnonzero(new)
    where = {(int(ids[order[a]]), int(k1[order[a]]), int(k2[order[a]])): order[a:b] for a, b in zip(at, np.append(at[1:], len(order)), strict=True)}
    return lambda row: where.get(row, np.zeros(0, np.int64))
