"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Texts become sets of five-word shingles; equal sets, by 128 bits of a digest, are one node, however many copies they have.
2. MinHash bands group nodes. ``BANDS`` bands of ``ROWS`` values miss a pair of similarity 0.8 with a probability under 3e-7.
3. Pairs of a band's nodes are compared as they come, by one bit of each of ``BITS`` further MinHash values, a word at a time; a pair is dropped when its
   posterior probability of reaching the threshold falls under a tolerance. The rest are edges, as few as connect the same nodes.
4. Components of the edges are tiled; a tile compares whole MinHash values incrementally in the same way (tolerance 1e-9) and verifies what is left
   exactly, whatever the component's size.
5. Components of the links are the classes.

Copies aren't expanded into pairs and hot groups never become rows: a tile returns a count a node and a forest. A band's group goes to one task, 48
bytes a distinct node; near-copies connect there after few comparisons. What grows with the square of a class of m distinct near-copies is
the counting of their links, m * m comparisons over m / 2,048 tasks.

Defined cases: a null text is empty; texts without words are equal to each other and link to nothing else; a text of one to
four words has one shingle; very long texts are one set; a similarity equal to the threshold is a link; ties between representatives go to the
smallest id, then the text's digest; a null id is an id like any other (last in order); repeated rows are copies; other columns
aren't read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import PACKED, Packer, buckets, by_bucket, mix, offsets, saved, slices, trimmed, with_key
from .neighbours import TOLERANCE, bucket_links, components, connect, forest, minhash, star_edges, tiled
from .repeats import FOUND, TEXT
from .rows import by_row, packed_found, packed_rows
from .shingles import sets, shingles

THRESHOLD = 0.8
BANDS, ROWS = 50, 6
#: One-bit MinHash values that the pairs of a band are compared by.
BITS = 256
_RNG = np.random.default_rng(7_1911)
_ODD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits come from values of the bands themselves: mixed, so that a band's agreement doesn't fix them.
_FROM = np.arange(BITS)


def digests(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each bag: sums of mixed values and the size, mixed; 0 for the empty one."""
    at, out = offsets(counts), []
    for seed in (3, 5):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat, seed), dtype=np.uint64)])
        value = mix((total[at[1:]] - total[at[:-1]]) ^ mix(counts.astype(np.uint64), seed), seed + 8)
        out.append(np.where(counts > 0, value, np.uint64(0)))
    return out[0], out[1]


def full_keys(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Both digests as 16 bytes."""
    both = np.ascontiguousarray(np.stack([a, b], axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both)]).cast(pa.binary())


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat, counts = sets(*shingles(part.column("text").to_pylist()))
    return flat, counts, *digests(flat, counts)


def _farthest(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared bits: differing ones over which P(similarity >= threshold) < tolerance.

    Bits of sets of similarity s differ with probability (1 - s) / 2; the prior of s is uniform.
    """
    out = np.zeros(BITS + 1, dtype=np.int64)
    p = np.linspace(0, 0.5, 2001)  # of differing
    for n in range(64, BITS + 1, 64):
        for d in range(n + 1):
            log = d * np.log(np.maximum(p, 1e-300)) + (n - d) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[p <= (1 - threshold) / 2 + 1e-12].sum() < tolerance * weight.sum():
                break
            out[n] = d
    return out


def _bands(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (set, band) and bits (set, words) of sets that aren't empty."""
    values = minhash(flat, counts, _ODD).astype(np.uint64)
    bits = (mix(values[:, _FROM], 21) & np.uint64(1)).astype(np.uint8)
    values = values.reshape(len(counts), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), (len(counts), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key ^ values[:, :, r], 1)
    return key, np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64).reshape(len(counts), BITS // 64)


@trimmed
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, node, full, bands, bits); node: the first half of the digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("full", pa.binary()), ("bands", pa.binary()), ("bits", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text"):
            flat, counts, a, b = _sets(part)
            keys: list[bytes | None] = [None] * len(counts)
            bits: list[bytes | None] = [None] * len(counts)
            if len(flat):
                for i, row, more in zip(np.flatnonzero(counts), *_bands(flat, counts[counts > 0]), strict=True):
                    keys[i], bits[i] = row.tobytes(), more.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("__key").cast(pa.binary()), pa.array(a.view(np.int64)), full_keys(a, b), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], schema=schema)


def _band_records(n: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            node = batch.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)  # copies say nothing new
            rows = batch.take(pa.array(first)).filter(batch.column("bands").take(pa.array(first)).is_valid())
            for lo in range(0, rows.num_rows, 2_000):
                part = rows.slice(lo, 2_000)
                key = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype=np.uint64)
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), dtype=np.uint64).reshape(part.num_rows, -1)
                packer.add((key >> np.uint64(32)) % np.uint64(n), {"key": key, "node": np.repeat(part.column("node").to_numpy(), BANDS), **{f"s{k}": np.repeat(bits[:, k], BANDS) for k in range(bits.shape[1])}})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return run


def _band_edges(threshold: float):
    farthest = _farthest(threshold, TOLERANCE)

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        r = records[0]
        key, node = r["key"].to_numpy(), r["node"].to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        shared = np.concatenate([[False], key[1:] == key[:-1]]) | np.concatenate([key[1:] == key[:-1], [False]])
        order, key = order[shared], key[shared]  # most bands have one node
        back = np.lexsort((node[order], key))
        order, key = order[back], key[back]
        node = node[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        order, key, node = order[new], key[new], node[new]
        bits = np.stack([r[f"s{k}"].to_numpy()[order] for k in range(BITS // 64)], axis=1)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, alive, apart = np.zeros(len(i), dtype=bool), np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
            for k in range(BITS // 64):
                apart = apart + np.bitwise_count(bits[i[alive], k] ^ bits[j[alive], k])
                yes = apart <= farthest[64 * (k + 1)]
                alive, apart = alive[yes], apart[yes]
            out[alive] = True
            return out

        i, j = connect(key, near)
        if len(i):
            a, b = star_edges(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def _tile_records(n: int):
    """Packs the sets of the wanted rows' texts for their tiles."""

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        wanted = records.get(FOUND)
        if wanted is None or TEXT not in records:
            return
        look, texts, packer, seen, held = by_row(wanted), records[TEXT], Packer(), set(), []
        ids, k1, k2 = (texts[c].to_numpy() for c in ("id", "k1", "k2"))
        tiles, full, g, copies = wanted["tiles"].to_pylist(), wanted["full"].combine_chunks(), *(wanted[c].to_numpy() for c in ("g", "copies"))

        def flush():
            flat, counts = sets(*shingles([t for _, t in held]))
            at = offsets(counts)
            own = np.array([i for i, (w, _) in enumerate(held) for _ in tiles[w]])
            names, w = [t for x, _ in held for t in tiles[x]], np.array([x for x, _ in held])[own]
            packer.add(
                np.array([hash_of(t) % n for t in names]),
                {"tile": pa.array(names), "full": full.take(pa.array(w)), "g": g[w], "copies": copies[w], "values": pa.array([flat[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())},
            )
            held.clear()

        size = 0
        for i in range(len(ids)):
            row = (int(ids[i]), int(k1[i]), int(k2[i]))
            found = look(row)
            if len(found) and row not in seen:
                seen.add(row)
                held.append((int(found[0]), texts["c_text"][i].as_py()))
                size += len(held[-1][1])
                if size > 1 << 20:
                    flush()
                    size = 0
                    if packer.full():
                        yield from packer.batches()
        if held:
            flush()
        yield from packer.batches()

    return work


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _tile_results(threshold: float):
    """Rows (full, links, root): counts of linked documents, and the forest; a root that is the node itself says nothing."""

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        rows, i, j = bucket_links(records[0], threshold, TOLERANCE)
        if not len(i):
            return
        full, copies, n = rows["full"].combine_chunks(), rows["copies"].to_numpy(), rows.num_rows
        links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
        yes = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([full.take(pa.array(yes)), pa.array(links[yes].astype(np.int64)), full.take(pa.array(forest(i, j, n)[yes]))], names=["full", "links", "root"])

    return work


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, key, class_id, n_links, n_copies, chosen), one a row of ``docs`` (doc_id long, text); a stored table.

    key: 16 bytes that stand for the text; class_id: smallest doc_id of the class; n_links: other documents of similarity
    ``threshold`` or more, copies included; n_copies: documents with the same shingles, this one included; chosen: the row
    (all its repeats) that stands for the class.
    """
    docs = docs.select("doc_id", "text")
    signed = saved(with_key(docs).mapInArrow(_signed, "doc_id bigint, key binary, node bigint, full binary, bands binary, bits binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = saved(signed.groupBy("full").agg(first.alias("rep"), F.count("*").alias("copies"), F.first("node").alias("node")), "nodes")
    n = buckets(docs, 1.2)
    edges = by_bucket(signed.select("node", "bands", "bits").mapInArrow(_band_records(n), PACKED), n, _band_edges(threshold), "a bigint, b bigint")
    # halves of digests that agree by chance only bring more nodes to a component
    active = saved(tiled(components(edges).join(nodes, "node").drop("node")), "active")
    rows, n = buckets(docs, 2.5), buckets(docs, 1.5)
    wanted = active.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.key").alias("__key"), "full", "g", "copies", "tiles")
    texts = with_key(docs).mapInArrow(packed_rows(rows), PACKED).unionAll(wanted.mapInArrow(packed_found(rows, ["full", "g", "copies", "tiles"]), PACKED))
    values = by_bucket(texts, rows, _tile_records(n), PACKED)
    found = saved(by_bucket(values, n, _tile_results(threshold), "full binary, links bigint, root binary"), "links")
    classes = components(found.select(F.col("full").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "full")
    links = found.groupBy("full").agg(F.sum("links").alias("links"))
    per_node = saved(nodes.join(classes, "full", "left").join(links, "full", "left").withColumn("root", F.coalesce("root", "full")), "rooted")
    named = saved(per_node.groupBy("root").agg(F.min("rep").alias("first")), "named")  # partial sums first, so a hot class is a row a task
    per_node = saved(per_node.join(named, "root").select("full", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "classes")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return signed.select("doc_id", "key", "full").join(per_node, "full").select("doc_id", "key", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies", chosen.alias("chosen"))


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, n_links, n_copies), one a row of ``docs``."""
    return classify(docs, threshold).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with their columns, one of each class: the one with the smallest id."""
    chosen = classify(docs, threshold).where("chosen").groupBy("doc_id", "key").agg(F.count("*").alias("__rows"))
    chosen = saved(chosen.select(F.col("doc_id").alias("__id"), F.col("key").alias("__rep"), "__rows"), "chosen")
    keyed = with_key(docs)
    rows = keyed.join(chosen, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__rep")))
    if not chosen.where("__rows > 1").limit(1).count():
        return rows.select(*docs.columns)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("__id", "__key").orderBy(F.lit(1)))).where("__n = 1").select(*docs.columns)
