"""Line dedup by an exact set-similarity self-join.

A line's tokens are its lower-case words between ASCII spaces. Lines are compared as token sets: a line goes if an earlier line, by
(doc_id, line number), has a Jaccard similarity of ``threshold`` or more.

1. One scan counts tokens (a table of fixed size, by token hash) and finds the first place of each distinct line (128 bits of a digest).
2. Tokens are ordered from rare to frequent. The prefix of a line of n tokens is its first n - ceil(t n) + 1; two similar
   lines share a prefix token. Lines meet by prefix token. Tokens that occur over ``HOT`` times group by twos instead: lines whose common
   prefix tokens are all hot share two in a prefix that is longer by one, unless they have one token.
3. Pairs of a group are filtered by length, by position, and by a parity sketch whose Hamming distance never exceeds the size of the
   symmetric difference; what passes are edges, as few as connect the same lines.
4. Components of the edges are tiled and every pair of fitting sizes is verified exactly.
5. First places of lines without an earlier match stay; every other line that has tokens goes.

Defined cases: a null text stays null; a line without tokens (only ASCII spaces) always stays and matches nothing; a similarity equal to the
threshold is a match; a null doc_id comes last; rows that repeat both id and text are one document and get one result each; among equal ids
with unlike texts the order is by a digest of the text; a row all of whose lines go stays, with an empty text; very long lines and texts are handled
whole; columns of the input may have any names but those of the two new ones, which can be chosen; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, UNSPACED, Hashed, Packer, buckets, by_bucket, joined, mix, offsets, ranges, saved, slices, trimmed, with_key
from .jaccard_join import digests, full_keys
from .neighbours import bucket_links, components, connect, star_edges, tiled
from .repeats import FOUND, TEXT
from .rows import by_row, ids_of, packed_found, packed_rows
from .shingles import sets

THRESHOLD = 0.8
#: Bits of the token count table's index; slices of the table in an exchange.
TABLE, TABLE_PARTS = 18, 16
#: Lines of more tokens carry a sketch of 256 bits, others of 64.
SHORT = 90
#: Occurrences over which a token groups lines only with another one, and tokens of a line up to which it does so; longer lines, and for
#: the sake of partners of another length those from ``threshold`` times as many, group by single tokens whatever these are.
HOT, PAIRED = 1 << 17, 40
LINES, COUNTS = 0, 1


class _Lines:
    """The lines with tokens of some texts: ``text`` and ``line`` say where, ``node`` what they hold, ``n`` how many tokens.

    ``node`` and ``check`` digest the bag of a line's tokens, with 64 bits each.
    """

    def __init__(self, texts: list[str | None]):
        found = Hashed([x.lower().encode() if x else b"" for x in texts], UNSPACED)
        ends = np.flatnonzero(found.data == 10)
        n = np.diff(np.searchsorted(found.starts, ends), prepend=0)  # tokens of each line, of all texts
        number = np.flatnonzero(n)
        self.flat, self.n, self.at = found.flat, n[number], offsets(n[number])
        top = np.searchsorted(ends, found.at[:-1])  # the first line of each text
        self.text = np.searchsorted(top, number, "right") - 1
        self.line = number - top[self.text]
        node, self.check = digests(self.flat, self.n)
        self.node = node.view(np.int64)

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of some lines in a row, and each one's line as a place in ``which``."""
        return self.flat[ranges(self.at[which], self.n[which])], np.repeat(np.arange(len(which)), self.n[which])


def _scan(n: int):
    """Packs the places of the distinct lines of each slice by line, and the task's token counts by part of the table."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, table = Packer(LINES), np.zeros(1 << TABLE, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, k1, k2 = ids_of(part)
                lines = _Lines(part.column("text").to_pylist())
                table += np.bincount((lines.flat >> np.uint64(64 - TABLE)).astype(np.int64), minlength=1 << TABLE)
                own = lines.text
                rank = np.empty(len(ids), dtype=np.int64)
                rank[np.lexsort((k2, k1, ids))] = np.arange(len(ids))
                order = np.lexsort(((rank[own] << 32) | lines.line, lines.check, lines.node))
                at = order[_new(lines.node[order], lines.check[order])]  # the first place of each
                own = own[at]
                packer.add(lines.node[at].view(np.uint64) % np.uint64(n), {"node": lines.node[at], "check": lines.check[at], "doc_id": ids[own], "k1": k1[own], "k2": k2[own], "line": lines.line[at].astype(np.int32)})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()
        used = np.flatnonzero(table)
        if len(used):
            packer = Packer(COUNTS)
            packer.add(used % TABLE_PARTS, {"slot": used, "n": table[used]})
            yield from packer.batches()

    return run


def _new(*keys: np.ndarray) -> np.ndarray:
    """Which sorted rows differ from the one before."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _firsts(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
    r = records[LINES]
    c = {k: r[k].to_numpy() for k in ("node", "check", "doc_id", "k1", "k2", "line")}
    order = np.lexsort((c["line"], c["k2"], c["k1"], c["doc_id"], c["check"], c["node"]))
    at = order[_new(c["node"][order], c["check"][order])]
    key = np.stack([c["k1"][at], c["k2"][at]], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(c["node"][at]), full_keys(c["node"][at].view(np.uint64), c["check"][at]), pa.array(c["doc_id"][at]), full_keys(key[:, 0], key[:, 1]), pa.array(c["line"][at])], names=["node", "full", "doc_id", "__key", "line"])


def _table_sum(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
    slot, back = np.unique(records[COUNTS]["slot"].to_numpy(), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bincount(back, weights=records[COUNTS]["n"].to_numpy()).astype(np.int64))], names=["slot", "n"])


def _ordered(flat: np.ndarray, owner: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line, from rare to frequent."""
    often = np.frexp(table[(flat >> np.uint64(64 - TABLE)).astype(np.int64)].astype(np.float64))[1]  # by powers of two
    rank = (np.minimum(often, 31).astype(np.uint64) << np.uint64(37)) | (flat >> np.uint64(27))
    if len(owner) and owner[-1] < 1 << 22:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(42)) | rank)
    else:
        order = np.lexsort((rank, owner))
    f, o, r = flat[order], owner[order], rank[order]
    alike = (r[1:] == r[:-1]) & (o[1:] == o[:-1])
    if (alike & (f[1:] != f[:-1])).any():  # tokens whose ranks collide: the full hash decides too
        order = np.lexsort((flat, rank, owner))
        f, o = flat[order], owner[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (o[1:] != o[:-1])])
    return f[new], o[new]


def _prefixes(n_buckets: int, sent, threshold: float):
    """Packs (token, node, size, position, sketch) of the prefix tokens of the distinct lines of each slice."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch in batches:
            for part in slices(batch, "text"):
                lines = _Lines(part.column("text").to_pylist())
                if not len(lines.n):
                    continue
                node, which = np.unique(lines.node, return_index=True)
                flat, owner = _ordered(*lines.tokens(which), sent.value)
                size = np.bincount(owner, minlength=len(node))
                at = offsets(size)
                sketch = _sketches(flat, owner, size)
                place = np.arange(len(flat)) - at[owner]
                head, token = _groups(flat, owner, size, place, sent.value, threshold)
                who = owner[head]
                packer.add(token % np.uint64(n_buckets), {"token": (token >> np.uint64(32)).astype(np.uint32), "node": node[who], "size": size[who].astype(np.uint32), "place": place[head].astype(np.uint32), **{f"s{k}": sketch[who, k] for k in range(4)}})
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return run


def _groups(flat: np.ndarray, owner: np.ndarray, size: np.ndarray, place: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens by which lines meet, and the hashes of the groups: prefix tokens, or two hot ones of a prefix longer by one."""
    own, prefix = size[owner], (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner]
    hot = table[(flat >> np.uint64(64 - TABLE)).astype(np.int64)] > HOT
    alone = ~hot | (own == 1) | (own >= threshold * PAIRED)
    head = np.flatnonzero((place < prefix) & alone)
    found, groups = [head], [mix(flat[head], 4)]
    pair = np.flatnonzero((place < prefix) & hot & (own > 1) & (own <= PAIRED))
    step = 1
    while len(pair):
        pair = pair[place[pair] + step <= np.minimum(prefix[pair], own[pair] - 1)]
        both = pair[hot[pair + step]]
        found.append(both)
        groups.append(mix(joined(flat[both], flat[both + step], 31), 4))
        step += 1
    return np.concatenate(found), np.concatenate(groups)


def _sketches(flat: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity of the tokens by 256 slots; for short lines folded to 64, in the first word."""
    bit, long = np.uint64(1) << ((flat >> np.uint64(8)) & np.uint64(63)), size > SHORT
    at, out = offsets(size)[:-1], np.zeros((len(size), 4), dtype=np.uint64)  # every line has a token
    out[:, 0] = np.bitwise_xor.reduceat(bit, at)
    if long.any():
        some = np.flatnonzero(long)
        where = ranges(at[some], size[some])
        word, bit, at = (flat[where] >> np.uint64(14)) & np.uint64(3), bit[where], offsets(size[some])[:-1]
        for k in range(4):
            out[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at)
    return out


def _candidates(threshold: float):
    """Edges between lines that share a prefix token and pass the filters; as few as connect them."""
    share = threshold / (1 + threshold)

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        r = records[0]
        order = np.lexsort((r["node"].to_numpy(), r["size"].to_numpy(), r["token"].to_numpy()))
        token, node, size, place = (r[k].to_numpy()[order] for k in ("token", "node", "size", "place"))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])]) if len(token) else np.zeros(0, bool)
        order, token, node, size, place = order[new], token[new], node[new], size[new].astype(np.int64), place[new].astype(np.int64)
        sketch = np.stack([r[f"s{k}"].to_numpy()[order] for k in range(4)], axis=1)
        long = size > SHORT
        fold = np.where(long, sketch[:, 0] ^ sketch[:, 1] ^ sketch[:, 2] ^ sketch[:, 3], sketch[:, 0])

        def goes_on(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return size[i] >= threshold * size[j] - 1e-9  # a group is sorted by size: what fails once fails for all that follow

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            need = np.ceil(share * (size[i] + size[j]) - 1e-9)
            out = np.minimum(size[i] - place[i], size[j] - place[j]) >= need
            at = np.flatnonzero(out)
            p, q = i[at], j[at]
            both = long[p] & long[q]
            far = np.bitwise_count(fold[p] ^ fold[q]).astype(np.int64)
            far[both] = np.bitwise_count(sketch[p[both]] ^ sketch[q[both]]).sum(axis=1, dtype=np.int64)
            out[at] = far <= size[p] + size[q] - 2 * need[at]
            return out

        i, j = connect(token, near, goes_on)
        if len(i):
            a, b = star_edges(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return work


def _values(n: int):
    """Sets of the wanted lines, packed for their tiles."""

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        wanted = records.get(FOUND)
        if wanted is None or TEXT not in records:
            return
        look, texts, packer, seen = by_row(wanted), records[TEXT], Packer(), set()
        number, full, g, tiles = wanted["line"].to_numpy(), wanted["full"].combine_chunks(), wanted["g"].to_numpy(), wanted["tiles"].to_pylist()
        ids, k1, k2, column = texts["id"].to_numpy(), texts["k1"].to_numpy(), texts["k2"].to_numpy(), texts["c_text"]
        held, size = [], 0  # (place of the text, places of its wanted lines)

        def flush():
            lines = _Lines([column[i].as_py() for i, _ in held])
            where = {(int(t), int(x)): k for k, (t, x) in enumerate(zip(lines.text, lines.line, strict=True))}
            pairs = [(t, i, w) for t, (i, found) in enumerate(held) for w in found]
            which = np.array([where[t, int(number[w])] for t, _, w in pairs])
            flat, owner = lines.tokens(which)
            flat, counts = sets(flat, np.bincount(owner, minlength=len(which)))
            at = offsets(counts)
            own = np.array([p for p, (_, _, w) in enumerate(pairs) for _ in tiles[w]])
            names = [t for _, _, w in pairs for t in tiles[w]]
            row, w = np.array([i for _, i, _ in pairs])[own], np.array([w for _, _, w in pairs])[own]
            packer.add(
                np.array([xxhash.xxh3_64_intdigest(t) % n for t in names]),
                {"tile": pa.array(names), "full": full.take(pa.array(w)), "g": g[w], "values": pa.array([flat[at[p] : at[p + 1]].tobytes() for p in own], pa.binary()), "id": ids[row], "k1": k1[row], "k2": k2[row], "line": number[w]},
            )
            held.clear()

        for i in range(len(ids)):
            row = (int(ids[i]), int(k1[i]), int(k2[i]))
            found = look(row)
            if len(found) and row not in seen:
                seen.add(row)
                held.append((i, found))
                size += len(column[i].as_py())
                if size > 1 << 20:
                    flush()
                    size = 0
                    if packer.full():
                        yield from packer.batches()
        if held:
            flush()
        yield from packer.batches()

    return work


def _later(threshold: float):
    """Places of lines that have an earlier match in a tile, some more than once."""

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        rows, i, j = bucket_links(records[0], threshold, None)
        if not len(i):
            return
        rank = np.empty(rows.num_rows, dtype=np.int64)
        rank[np.lexsort((rows["line"].to_numpy(), rows["k2"].to_numpy(), rows["k1"].to_numpy(), rows["id"].to_numpy()))] = np.arange(len(rank))
        later = np.unique(np.where(rank[i] > rank[j], i, j))
        place = {c: rows[c].to_numpy()[later] for c in ("id", "k1", "k2", "line")}
        yield pa.RecordBatch.from_arrays([pa.array(place["id"]), full_keys(place["k1"], place["k2"]), pa.array(place["line"])], names=["doc_id", "__key", "line"])

    return work


#: What stands between tokens; a line of nothing else is blank.
SPACES = " \t\n\v\f\r"


def _rewritten(schema: pa.Schema):
    """Rows with the kept lines as text, and their counts of lines (the last two columns). First places have their line, those of them that go -1 less it too."""
    names = schema.names[:-2]

    def work(bucket: int, records: dict[int, pa.Table]) -> Iterator[pa.RecordBatch]:
        if TEXT not in records:
            return
        kept = records.get(FOUND)
        look, line = by_row(kept), kept["line"].to_numpy() if kept is not None else None
        for batch in records[TEXT].to_batches(max_chunksize=1_000):
            texts, n_lines, n_removed = [], [], []
            for text, a, b, c in zip(batch.column("c_text").to_pylist(), batch.column("id").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_removed.append(0)
                    continue
                split, found = text.split("\n"), look((a, b, c))
                own = line[found] if len(found) else np.zeros(0, np.int64)
                stay = set(own[own >= 0].tolist()).difference((-1 - own[own < 0]).tolist())
                rest = [x for i, x in enumerate(split) if i in stay or not x.strip(SPACES)]
                texts.append("\n".join(rest))
                n_lines.append(len(split))
                n_removed.append(len(split) - len(rest))
            out = {x: batch.column(f"c_{x}") for x in names}
            out["text"] = pa.array(texts, schema.field("text").type)
            if "n_chars" in out:
                out["n_chars"] = pa.array([None if x is None else len(x) for x in texts], schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([*(out[x].cast(schema.field(x).type) for x in names), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], schema=schema)

    return work


def dedup(docs: DataFrame, threshold: float = THRESHOLD, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of ``docs`` (doc_id long, text, ...) with the lines that stay, n_chars to match, and the ``counts`` of lines and removed lines (long).

    All but the last exchange is done when this is called.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in counts))
    total, gone = counts
    slim = with_key(docs.select("doc_id", "text"))
    n = buckets(docs, 0.5)
    scanned = saved(slim.mapInArrow(_scan(n), PACKED), "line-scan")
    firsts = saved(by_bucket(scanned.where(F.col("kind") == LINES), n, _firsts, "node bigint, full binary, doc_id bigint, __key binary, line int"), "line-firsts")
    often = by_bucket(scanned.where(F.col("kind") == COUNTS), TABLE_PARTS, _table_sum, "slot bigint, n bigint").toPandas()  # the table has a fixed size
    table = np.zeros(1 << TABLE, dtype=np.int64)
    table[often.slot] = often.n
    sent = spark.sparkContext.broadcast(table)
    n = buckets(docs, 2.5)
    edges = by_bucket(docs.select("text").mapInArrow(_prefixes(n, sent, threshold), PACKED), n, _candidates(threshold), "a bigint, b bigint")
    wanted = tiled(components(edges).join(firsts, "node").drop("node"))
    rows, n = buckets(docs, 2.5), buckets(docs, 1)
    found = wanted.select("doc_id", "__key", "line", "full", "g", "tiles").mapInArrow(packed_found(rows, ["line", "full", "g", "tiles"]), PACKED)
    values = by_bucket(slim.mapInArrow(packed_rows(rows), PACKED).unionAll(found), rows, _values(n), PACKED)
    later = saved(by_bucket(values, n, _later(threshold), "doc_id bigint, __key binary, line int"), "line-later")
    places = firsts.select("doc_id", "__key", "line").unionAll(later.select("doc_id", "__key", (-1 - F.col("line")).alias("line")))
    kept = places.mapInArrow(packed_found(rows, ["line"]), PACKED)
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in docs.schema.fields), (total, pa.int64()), (gone, pa.int64())])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{total}` bigint, `{gone}` bigint"])
    return by_bucket(with_key(docs).mapInArrow(packed_rows(rows), PACKED).unionAll(kept), rows, _rewritten(schema), ddl)

