"""Connected components, and exact Jaccard links inside components, for the similarity joins.

Both joins work alike. A search groups records by a key that similar ones share; inside a group pairs are compared by
sketches as they come, and accepted pairs become edges, as few as connect what all accepted ones connect (``connect``). Components of the
edges are blocks of records among which every link must lie. The records' sets go to the blocks once, a
large component is split into tiles of pairs of row groups, and each tile finds its links exactly. With a tolerance, MinHash
values are compared incrementally first and a pair is dropped when the posterior probability of reaching the threshold falls
below it. Tiles return counts, flags and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, offsets, ranges, saved, shared_path

#: Rows of a tile's side; MinHash values that are compared in a round and at most; tolerance of the pruning.
TILE, ROUND, HASHES, TOLERANCE = 2_048, 16, 96, 1e-9
_RNG = np.random.default_rng(20_240_229)
_ODD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): every node of ``edges`` (a, b) and the smallest node that it is connected with.

    Alternating large and small stars; a round's edges are written to the shared folder, and the ones before it deleted. What a node's
    neighbours need to know is a table of its own, so that both sides of a join are plain exchanges and a hub can be split.
    """
    spark, old = edges.sparkSession, []

    def kept(df: DataFrame, label: str) -> DataFrame:
        path = shared_path(spark, label)
        df.write.option("compression", "zstd").parquet(path)
        old.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # a > b in every edge here
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(e)
    while before[0]:
        past = len(old)
        e = kept(stars(kept(stars(e, True), "half"), False), "edges")
        now = state(e)
        for path in [*old[:past], *old[past:-1]]:
            discard(spark, path)
        del old[:-1]
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest connected place of each of n places under the links i-j."""
    label = np.arange(n)
    if not len(i):
        return label
    u, v = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    at = u[first]
    while True:
        new = label.copy()
        new[at] = np.minimum(new[at], np.minimum.reduceat(label[v], first))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect what the edges a-b connect."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(back[: len(a)], back[len(a) :], len(nodes))
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def connect(group: np.ndarray, near, goes_on=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group that ``near(i, j)`` accepts; as few as connect what all accepted pairs connect.

    ``group`` ascends. Rows are compared with the next one of their group, the one after it, and so on, until a group is connected or
    has no more pairs; ``goes_on(i, j)`` may end a row's comparisons, when what fails for one partner fails for all further ones. A group of
    near-copies is connected after few steps; only one of unlike rows is compared in full.
    """
    n, label = len(group), np.arange(len(group))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size - 1, size)
    i, step, found_i, found_j, fresh = np.flatnonzero(np.arange(n) < last), 1, [], [], 0
    while len(i):
        j = i + step
        if goes_on is not None:
            yes = goes_on(i, j)
            i, j = i[yes], j[yes]
        apart = label[i] != label[j]
        p, q = i[apart], j[apart]
        if len(p):
            yes = near(p, q)
            if yes.any():
                found_i.append(p[yes])
                found_j.append(q[yes])
                fresh += int(yes.sum())
        if fresh and (step & (step - 1) == 0 or fresh > 1_000_000):
            label, fresh = forest(np.concatenate(found_i), np.concatenate(found_j), n), 0
            away = np.flatnonzero(label != np.arange(n))
            found_i, found_j = [away], [label[away]]
            whole = np.repeat(np.logical_and.reduceat(label == np.repeat(label[first], size), first), size)
            i = i[~whole[i]]
        step += 1
        i = i[i + step <= last[i]]
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


# ---------------------------------------------------------------- tiles


def tiled(members: DataFrame, tile: int = TILE) -> DataFrame:
    """``members`` (root, full, ...) with ``tiles``: the keys "root:i:j" of the tiles that need the row.

    A component of at most ``tile`` rows is one tile; a larger one is dealt into groups, one tile for each two.
    """
    members = saved(members, "members")
    sizes = saved(members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("groups")), "sizes")
    out = members.join(sizes, "root").withColumn("g", F.pmod(F.xxhash64("full"), F.col("groups")).cast("int"))
    return out.withColumn("tiles", F.expr("transform(sequence(0, groups - 1), k -> concat_ws(':', root, least(g, k), greatest(g, k)))")).drop("groups")


def _least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values: matches under which P(similarity >= threshold) < tolerance (uniform prior)."""
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance or m == n:
                break
            m += 1
        out[n] = m
    return out


_MATCHES: dict[tuple[float, float], np.ndarray] = {}


def minhash(flat: np.ndarray, counts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Values (set, hash) of sets in a row; the sets aren't empty."""
    at = offsets(counts)[:-1]
    out = np.empty((len(counts), len(k)), dtype=np.uint32)
    for i, odd in enumerate(k):
        out[:, i] = np.minimum.reduceat(((flat * odd) >> np.uint64(32)).astype(np.uint32), at)
    return out


def survivors(signature: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs are left when MinHash values are compared ``ROUND`` at a time and hopeless pairs go after each."""
    least = _MATCHES.setdefault((threshold, tolerance), _least_matches(threshold, tolerance))
    alive, matches, n = np.arange(len(i)), np.zeros(len(i), dtype=np.int64), 0
    while n < HASHES and len(alive):
        matches = matches + (signature[i[alive], n : n + ROUND] == signature[j[alive], n : n + ROUND]).sum(axis=1)
        n += ROUND
        yes = matches >= least[n]
        alive, matches = alive[yes], matches[yes]
    return alive


def tile_links(flat: np.ndarray, counts: np.ndarray, signature: np.ndarray | None, group: np.ndarray, pair: tuple[int, int], threshold: float, tolerance: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a tile. ``flat``: distinct values of the sets in a row; ``group``: the rows' groups; ``pair``: the tile's."""
    at = offsets(counts)
    left, right = np.flatnonzero(group == pair[0]), np.flatnonzero(group == pair[1])
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    found = []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        ok = (np.minimum(counts[rows][:, None], counts[right][None, :]) >= threshold * np.maximum(counts[rows][:, None], counts[right][None, :]) - 1e-9)
        if pair[0] == pair[1]:
            ok &= rows[:, None] < right[None, :]
        a, b = np.nonzero(ok)
        i, j = rows[a], right[b]
        if tolerance is not None:
            alive = survivors(signature, i, j, threshold, tolerance)
            i, j = i[alive], j[alive]
        for row in np.unique(i):
            partners = j[np.searchsorted(i, row, "left") : np.searchsorted(i, row, "right")]  # i ascends
            mark[ids[at[row] : at[row + 1]]] = True
            n = counts[partners]
            shared = np.add.reduceat(mark[ids[ranges(at[partners], n)]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
            mark[ids[at[row] : at[row + 1]]] = False
            yes = shared * (1 + threshold) >= threshold * (counts[row] + n) - 1e-6
            if yes.any():
                found.append((np.full(int(yes.sum()), row), partners[yes]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def _bulk_links(flat: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of many pairs of small tiles link, exactly; a pair's values are looked up in one sorted list of (row, value)."""
    _, ids = np.unique(flat, return_inverse=True)
    at = offsets(counts)
    keys = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) | ids  # ascending: the sets are sorted
    out = np.zeros(len(i), dtype=bool)
    cost = np.concatenate([[0], np.cumsum(counts[i])])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + 1_000_000, "right")) - 1)
        p, q = i[lo:hi], j[lo:hi]
        wanted = (np.repeat(q.astype(np.int64), counts[p]) << 32) | ids[ranges(at[p], counts[p])]
        found = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        shared = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(counts[p])[:-1]]))
        out[lo:hi] = shared * (1 + threshold) >= threshold * (counts[p] + counts[q]) - 1e-6
        lo = hi
    return out


#: Rows of a tile up to which its pairs are listed together with those of others like it.
FEW = 16


def bucket_links(records: pa.Table, threshold: float, tolerance: float | None) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A bucket's records (tile string, full binary, g, values binary, ...), a record once a tile, and the links (i, j) between them.

    ``tolerance``: of the pruning by posterior; None: every pair of fitting sizes is verified.
    """
    records = records.sort_by([("tile", "ascending"), ("full", "ascending")]).combine_chunks()
    code, full = (pc.dictionary_encode(records[c]).combine_chunks() for c in ("tile", "full"))
    names = code.dictionary.to_pylist()
    code, same = code.indices.to_numpy(), full.indices.to_numpy()
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (same[1:] != same[:-1])])
    records, code = records.filter(pa.array(fresh)).combine_chunks(), code[fresh]
    blobs, g = records["values"].to_pylist(), records["g"].to_numpy()
    counts = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
    flat, at = np.frombuffer(b"".join(blobs), dtype=np.uint64), offsets(counts)
    signature = minhash(flat, counts, _ODD) if tolerance is not None and len(flat) else None
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.append(cuts, len(code)))
    small = np.array([names[c].endswith(":0:0") for c in code[cuts]]) & (size <= FEW)
    i_found, j_found = [], []
    in_small = np.repeat(small, size)
    rows = np.flatnonzero(in_small)
    for step in range(1, FEW):
        rows = rows[rows + step < len(code)]
        rows = rows[code[rows] == code[rows + step]]
        if not len(rows):
            break
        i_found.append(rows)
        j_found.append(rows + step)
    if i_found:
        i, j = np.concatenate(i_found), np.concatenate(j_found)
        ok = np.minimum(counts[i], counts[j]) >= threshold * np.maximum(counts[i], counts[j]) - 1e-9
        i, j = i[ok], j[ok]
        if tolerance is not None:
            alive = survivors(signature, i, j, threshold, tolerance)
            i, j = i[alive], j[alive]
        ok = _bulk_links(flat, counts, i, j, threshold) if len(i) else np.zeros(0, bool)
        i_found, j_found = [i[ok]], [j[ok]]
    for lo, n in zip(cuts[~small], size[~small], strict=True):
        _, a, b = names[code[lo]].rsplit(":", 2)
        own = slice(lo, lo + n)
        i, j = tile_links(flat[at[lo] : at[lo + n]], counts[own], signature[own] if signature is not None else None, g[own], (int(a), int(b)), threshold, tolerance)
        i_found.append(i + lo)
        j_found.append(j + lo)
    none = np.zeros(0, np.int64)
    return records, np.concatenate([none, *i_found]), np.concatenate([none, *j_found])
