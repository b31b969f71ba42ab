"""The training-data operators against brute force, on real tables and on awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from terrasift.llm import block_dedup, bpe, decontaminate, importance, jaccard_join, line_dedup, media, neighbours, queries, repeats, shingles, suffix_dedup, token_counts, toxicity
from terrasift.llm.common import rolling

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LONG = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince " * 4
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, root string, bucket int"
TEXTS = [
    None, "", " ", "\n", "a", "word", "a" * 3000, "= " * 900, LONG, LONG, LONG + "tail", "head " + LONG, "é" * 500 + " ñandú 日本語     x",
    "line one is here now\nline two is here now\nline one is here now\n\n\nLINE one is here now", "it's they'll  \n\n  we've\t123 4567 <|endoftext|>",
    " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(400) if i != 200), "x\0y\0z" * 100,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, copies, near copies, long runs; a null id, a repeated id and a repeated row; clashing columns."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "n", "k", "r", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id " + LONG, None, None, 1, None, None, None, None), (3, "another text with the id three", "en", "s", 1, "n", "k", "r", 1), rows[8]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---------------------------------------------------------------- 1, 2, 3


def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (64, 16), (200, 40)])
def test_bpe(spark, odd, nothing, chunk, overlap):
    enc = encoding()
    ids = bpe.encode(odd, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    got = Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in bpe.decode(ids, RANKS, P.PATTERN).collect())
    want = Counter((i, np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in pairs_of(odd))
    assert got == want
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


SPACES = [" ", "\t", "\n", "\r", "\v", "\f", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]


@pytest.mark.parametrize("chunk, overlap, repeats", [(bpe.CHUNK, bpe.OVERLAP, [bpe.CHUNK - bpe.OVERLAP]), (64, 16, range(40, 70))])
def test_bpe_seams_at_every_space(spark, chunk, overlap, repeats):
    """Runs of spaces of every kind where a chunk may end: a piece must not end inside or behind them."""
    enc, texts = encoding(), []
    for a in SPACES:
        for n in repeats:
            head = ("word " * (n // 5 + 1))[: n - 1].rstrip() + "d" * 5
            texts += [head + " " + a + "x tail" + " more words" * (overlap // 4), head + a + a + " 'll see " + "y z" * overlap]
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
    for i, t in enumerate(texts):
        assert got[i] == np.array(enc.encode_ordinary(t), dtype="<u4").tobytes(), (i, t[-80:])


def test_bpe_query(spark, sf_dir, real):
    enc = encoding()
    for r in queries.op1_byte_bpe(spark, sf_dir).collect():
        ids = enc.encode_ordinary(real[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(real[r.doc_id].encode()))


def test_media(spark, odd, nothing):
    root = media.write_archives(odd)
    rows = media.decode(media.read_archives(spark, root, range_bytes="700")).collect()
    want = Counter((None if i is None else str(i), (t or "").encode()) for i, t in pairs_of(odd))
    assert Counter((r.id, bytes(r.payload)[: r.n_bytes]) for r in rows) == want
    assert all(len(r.payload) % 192 == 0 and len(r.payload) > 0 for r in rows)
    assert media.read_archives(spark, media.write_archives(nothing)).count() == 0


def test_media_retries_a_member_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    root = media.write_archives(docs, f"file://{tmp_path}/m")
    (archive,) = (tmp_path / "m/archives").iterdir()
    data = bytearray(archive.read_bytes())
    at = data.index(b"IDAT")
    data[at + 6] ^= 255
    archive.write_bytes(data)
    rows = media.read_archives(spark, root, on_error="null", tries="2").collect()
    assert sorted(r.media is None for r in rows) == [False] * 4 + [True]
    assert {r.tries for r in rows if r.media is None} == {2}


def test_media_query(spark, sf_dir, real):
    rows = queries.op2_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(real)
    for r in rows:
        b = real[r.doc_id].encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha(p), zlib.crc32(p[-16:]))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, odd, nothing, name, tmp_path):
    count, cache = token_counts._counter(P.path(name)), f"file://{tmp_path}/cache"
    want = Counter((i, len((t or "").encode()), count([t or ""])[0]) for i, t in pairs_of(odd))
    assert Counter(map(tuple, token_counts.count_tokens(odd, P.path(name), cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in pairs_of(odd)})
    assert Counter(map(tuple, token_counts.count_tokens(odd, P.path(name), cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored  # nothing was missing
    assert token_counts.count_tokens(nothing, P.path(name), cache).count() == 0


def test_token_counts_query_against_the_library(spark, sf_dir, real):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in real.items()}
    rows = queries.op3_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want


def test_token_counts_joins_stored_ones(spark, tmp_path):
    """A stored count is taken as it is, so it was read and not made again; another tokenizer's isn't."""
    path, cache = P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "stored text", "x"), (2, "new text", "y")], "digest long, content string, n_tokens string")
    stored = spark.createDataFrame([(hashlib.sha256(b"stored text").digest(), token_counts.tokenizer_digest(path), 777), (hashlib.sha256(b"new text").digest(), "another", 888)], token_counts.CACHE)
    stored.write.parquet(cache)
    got = {r.digest: r.n_tokens for r in token_counts.count_tokens(docs, path, cache, "digest", "content").collect()}
    assert got[1] == 777 and got[2] == token_counts._counter(path)(["new text"])[0] and spark.read.parquet(cache).count() == 3


# ---------------------------------------------------------------- 5, 7


def removed(tokens, window):
    """For each text: a mask of what windows cover that start anywhere else too."""
    seen = Counter(tuple(t[i : i + window]) if not isinstance(t, bytes) else t[i : i + window] for t in tokens for i in range(len(t) - window + 1))
    out = []
    for t in tokens:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window]) if not isinstance(t, bytes) else t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def check_bytes(rows, got):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), b, gone in zip(rows, texts, removed(texts, 200), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    assert got == want


def check_words(rows, got):
    found = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    want = Counter()
    for (i, _), w, gone in zip(rows, found, removed(found, 35), strict=True):
        want[i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert got == want


def test_suffixes(spark, odd, nothing, sf_dir, real):
    out = repeats.attach(odd, suffix_dedup.remove_repeats(odd)).collect()
    check_bytes(pairs_of(odd), Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) for r in out))
    check_bytes(list(real.items()), Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, sf_dir).collect()))
    assert repeats.attach(nothing, suffix_dedup.remove_repeats(nothing)).count() == 0


def test_blocks(spark, odd, nothing, sf_dir, real):
    out = repeats.attach(odd, block_dedup.remove_repeats(odd)).collect()
    check_words(pairs_of(odd), Counter((r.doc_id, r.n_words, r.n_removed, sha(bytes(r.kept))) for r in out))
    check_words(list(real.items()), Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_block_dedup(spark, sf_dir).collect()))
    assert repeats.attach(nothing, block_dedup.remove_repeats(nothing)).count() == 0


def test_interleave_sorts_and_measures():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 32)).astype(np.uint8)
    block = rng.integers(0, 3, 300)
    order, lcp = suffix_dedup.interleave(block, suffix_dedup._words(rows))
    keys = [(int(block[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 300):
        same = next((j for j in range(32) if rows[order[k]][j] != rows[order[k - 1]][j]), 32)
        assert lcp[k] == (same if keys[k][0] == keys[k - 1][0] else -1)


def test_rolling():
    x = np.arange(1, 60, dtype=np.uint64)
    for width in (1, 5, 18, 35):
        got = rolling(x, width, 0x9E3779B97F4A7C15)
        for i in range(len(x) - width + 1):
            want = 0
            for v in x[i : i + width].tolist():
                want = (want * 0x9E3779B97F4A7C15 + v) & (2**64 - 1)
            assert int(got[i]) == want


# ---------------------------------------------------------------- 6, 8, 10


def shingle_set(text):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def item_set(text):
    """An item's shingles: of five words, or all its words if these are fewer."""
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def runs_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))


def holds(text, item):
    return bool(item_set(item)) and len(runs_of(text) & item_set(item)) >= 0.8 * len(item_set(item)) - 1e-9


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 5])
def test_containment(spark, odd, nothing, block):
    bench = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "Word"), (5, " ".join(f"w{i}" for i in range(300))), (6, "is here now"), (7, LONG)], "item_id long, text string")
    rows, items = pairs_of(odd), [(r.item_id, r.text) for r in bench.collect()]
    want = Counter((d, i) for d, t in rows for i, x in items if holds(t, x))
    assert (13, 6) in want and (5, 4) in want
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.contained(odd, bench, block=block).collect()) == want
    clean = decontaminate.keep_clean(odd, bench, block=block)
    assert clean.columns == odd.columns
    assert Counter(r.text for r in clean.collect()) == Counter(t for _, t in rows if not any(holds(t, x) for _, x in items))
    assert decontaminate.contained(nothing, bench, block=block).count() == 0 and decontaminate.contained(odd, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_containment_query(spark, sf_dir, real):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs, wanted = {i: runs_of(t) for i, t in real.items()}, {i: item_set(t) for i, t in items.items()}
    want = {(d, i) for d, a in docs.items() for i, b in wanted.items() if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    got = queries.op6_decontaminate(spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    many = decontaminate.contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block=5)
    assert {(r.doc_id, r.item_id) for r in many.collect()} == want


def classes(sets):
    """Smallest member of each one's class, and links; equal empty sets are copies."""
    n, links = len(sets), [0] * len(sets)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)], links


def test_near_copies(spark, odd, nothing, sf_dir, real):
    ids = sorted(real)
    root, links = classes([shingle_set(real[i]) for i in ids])
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op8_ngram_join(spark, sf_dir).collect()}
    assert got == {i: (ids[root[k]], links[k]) for k, i in enumerate(ids)}
    rows = sorted(pairs_of(odd), key=lambda r: (r[0] is None, r[0] or 0))
    root, links = classes([shingle_set(t) for _, t in rows])
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(odd).collect()) == Counter((i, rows[root[k]][0], links[k]) for k, (i, _) in enumerate(rows))
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root))
    assert jaccard_join.join(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0


def test_large_components_are_tiled(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, links = classes([shingle_set(t) for t in texts])
    old, neighbours.tiled.__defaults__ = neighbours.tiled.__defaults__, (7,)
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()}
    finally:
        neighbours.tiled.__defaults__ = old
    assert got == {i: (root[i], links[i]) for i in range(60)}


def deduped(rows):
    """Rows (id, text) in order: the lines that stay."""
    earlier, out = [], []
    for i, text in rows:
        keep = []
        for line in (text or "").split("\n"):
            s = frozenset(line.lower().encode().split())
            if s:
                match = any(len(s & e) / len(s | e) >= 0.8 - 1e-12 for e in earlier)
                earlier.append(s)
                if match:
                    continue
            keep.append(line)
        out.append((i, len((text or "").split("\n")) if text is not None else 0, None if text is None else "\n".join(keep)))
    return out


def test_lines(spark, odd, nothing, real, sf_dir):
    one_each = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id <> 3")
    got = {(r.doc_id, r.n_lines, r.text) for r in line_dedup.dedup(one_each).collect()}
    assert got == set(deduped(sorted(pairs_of(one_each))))
    whole = line_dedup.dedup(odd)
    assert whole.count() == odd.count() and whole.columns == [*odd.columns, "n_lines", "n_removed"]
    want = {i: (n, sha(t.encode())) for i, n, t in deduped(sorted(real.items()))}
    assert {r.doc_id: (r.n_lines, r.kept_sha256) for r in queries.op10_line_dedup(spark, sf_dir).collect()} == want
    assert line_dedup.dedup(nothing).count() == 0


def test_lines_of_odd_spaces_and_hot_tokens(spark, monkeypatch):
    """Lines whose tokens Python takes for spaces aren't blank; tokens that all lines share group them in twos."""
    rng = np.random.default_rng(11)
    texts = ["\u00a0\n\u00a0\n \t \n \t \n\x1c x\n\x1c x", "\u00a0\nnew line here", "the\nthe the\nthe of\nof the\nof"]
    texts += ["\n".join(" ".join(rng.choice(["the", "of", "and", "to", "a", "in", "is", "it"], size=rng.integers(1, 9)).tolist() + ["x"] * int(rng.integers(0, 2))) for _ in range(6)) for _ in range(12)]
    texts += ["\n".join(" ".join(f"t{k}" for k in rng.choice(60, size=45, replace=False)) for _ in range(3)) for _ in range(4)]
    base = [f"t{k}" for k in range(60)]
    texts += ["\n".join(" ".join(w for k, w in enumerate(base[: 36 + n]) if k != d) for d in range(0, 36, 9)) for n in (0, 3, 6, 9)]
    monkeypatch.setattr(line_dedup, "HOT", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.text) for r in line_dedup.dedup(docs).collect()}
    assert got == set(deduped(list(enumerate(texts))))


def test_counts_of_the_input_stay(spark):
    docs = spark.createDataFrame([(1, "a b\na b", 7, 8)], "doc_id long, text string, n_lines long, n_removed long")
    (row,) = line_dedup.dedup(docs, counts=("lines", "gone")).collect()
    assert (row.text, row.n_lines, row.n_removed, row["lines"], row.gone) == ("a b", 7, 8, 2, 1)


# ---------------------------------------------------------------- 4, 9, pipeline


def test_importance(spark, odd, nothing, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratio = importance.fit(docs, labels.where("quality = 1").select("doc_id"))
    rows = importance.score(docs, ratio).toPandas()
    best = rows.sort_values(["gumbel_key", "doc_id"], ascending=[False, True]).doc_id.head(140)
    assert set(best) == {r.doc_id for r in queries.op4_importance(spark, sf_dir).collect()}
    assert importance.score(odd, ratio).count() == odd.count() and importance.score(odd, ratio).where("doc_id = 1").first().log_ratio == 0
    assert importance.resample(nothing, nothing.select("doc_id")).count() == 0
    named = docs.select(F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert np.array_equal(importance.fit(named, labels.where("quality = 1").select(F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("doc_id"))), ratio)


def ngram_slots(text):
    """Hash buckets of a text's words and of its pairs of words, one pair at a time."""
    flat = shingles.lower_words([text]).flat.tolist()
    pairs = [((a * 0x9E3779B97F4A7C15) & (2**64 - 1)) ^ (b >> 7) for a, b in zip(flat, flat[1:], strict=False)]
    return [(h >> 20) % importance.BUCKETS for h in flat] + [((p * 0xBF58476D1CE4E5B9 & (2**64 - 1)) >> 20) % importance.BUCKETS for p in pairs]


def test_importance_models_against_brute_force(spark, sf_dir, real):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    docs = spark.createDataFrame(list(real.items()), "doc_id long, text string")
    got = importance.fit(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    raw, target = Counter(), Counter()
    for i, t in real.items():
        raw.update(ngram_slots(t))
        target.update(ngram_slots(t) if i in good else ())
    total, n = importance.BUCKETS * importance.SMOOTH, importance.SMOOTH
    want = [np.log((target[k] + n) / (sum(target.values()) + total)) - np.log((raw[k] + n) / (sum(raw.values()) + total)) for k in range(importance.BUCKETS)]
    assert np.abs(got - np.array(want)).max() < 1e-9
    scored = {r.doc_id: r.log_ratio for r in importance.score(docs, got).collect()}
    for i, t in list(real.items())[:60]:
        assert abs(scored[i] - sum(want[k] for k in ngram_slots(t))) < 1e-6


def test_top_k_refines_its_histogram(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    monkeypatch.setattr(importance, "BINS", 8)
    rows = spark.range(3000).select("id", ((F.col("id") * 7919) % 611 / 7.0).alias("v"))
    want = [(r.id, r.v) for r in rows.orderBy(F.desc("v"), "id").limit(777).collect()]
    assert sorted(map(tuple, importance.top_k(rows, "v", 777, "id").collect())) == sorted(want)


def test_toxicity(spark, odd, nothing):
    ordinary = "the weather and the garden were calm and the people of the town walked home"
    texts = [(i, ordinary + f" on day {i % 7}" + (" you stupid idiot clown" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        assert (r.toxicity >= 0.7) == (r.doc_id % 5 == 0)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.where("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("toxicity > 0").count() == 0
    used = {r.doc_id for r in toxicity.training(labels).collect()}
    assert used and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept: its decisions from their definitions, all columns as they were."""
    import corpus_pipeline

    enc = encoding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_lines", F.lit(7)).withColumn("toxicity", F.lit(0.5)).cache()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = pairs_of(docs), stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns and {(r.n_lines, r.toxicity) for r in out.collect()} == {(7, 0.5)}, name
        if name == "toxicity":
            want = [(i, t) for (i, t), score in zip(before, model.score([t for _, t in before]), strict=True) if score < 0.7]
        elif name == "line_dedup":
            want = [(i, t) for i, _, t in deduped(sorted(before))]
        elif name == "ngram_jaccard_join":
            rows = sorted(before)
            root, _ = classes([shingle_set(t) for _, t in rows])
            want = [rows[k] for k in sorted(set(root))]
        else:
            want = [(i, t) for i, t in before if not any(holds(t, x) for x in items)]
        assert Counter(pairs_of(out)) == Counter(want), name
        docs = out
    last = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    ids = {i: enc.encode_ordinary(t or "") for i, t in pairs_of(docs)}
    assert last == {i: (len(ids[i]), sha(np.array(ids[i], dtype="<u4").tobytes()), sha((t or "").encode())) for i, t in pairs_of(docs)}


def test_pipeline_on_odd_rows(spark, odd, nothing, sf_dir):
    import corpus_pipeline

    for rows in (odd, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() and (rows is odd) == (docs.count() > 0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]


THUE_MORSE = ["".join("ab"[bin(i).count("1") % 2 ^ f] for i in range(1024)) for f in (0, 1)]


def test_words_that_a_polynomial_takes_for_equal(spark):
    """Texts that differ in one word of a Thue-Morse sequence: different texts for every operator that hashes words."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:20], w, *base[20:]]) for w in THUE_MORSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_words(list(enumerate(texts)), Counter((r.doc_id, r.n_words, r.n_removed, sha(bytes(r.kept))) for r in repeats.attach(docs, block_dedup.remove_repeats(docs)).collect()))
    assert {r.n_copies for r in jaccard_join.join(docs).collect()} == {1}
    short = spark.createDataFrame([(i, f"{w} x") for i, w in enumerate(THUE_MORSE)], "doc_id long, text string")
    assert line_dedup.dedup(short).where("n_removed > 0").count() == 0
    item = spark.createDataFrame([(1, f"{THUE_MORSE[0]} x")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained(short, item).collect()] == [0]


def test_a_passage_that_very_many_texts_share(spark):
    """One licence in unlike texts: each loses it and nothing else, by bytes and by words."""
    licence = " ".join(f"clause{i}" for i in range(60))
    rows = [(i, f"own{i} start{i} of{i} text{i} {licence} own{i} end{i} of{i} text{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {(r.n_removed) for r in repeats.attach(docs, block_dedup.remove_repeats(docs)).collect()} == {60}
    check_bytes(rows, Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) for r in repeats.attach(docs, suffix_dedup.remove_repeats(docs)).collect()))


def test_toxicity_learns_from_training_rows_only(spark):
    texts = [(i, "calm words of a quiet town by the river" + (" stupid idiot clown" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in texts]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in texts], flipped)]
    assert models[0].rule == models[1].rule and models[0].curve == models[1].curve
    assert (models[0].ratio == models[1].ratio).all()


def words_of(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())


def test_kneser_ney_models_against_brute_force(spark, sf_dir, real):
    """Both models from their definition, on 200 texts; each sums to one over the corpus and one word more."""
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").collect()}
    sample = {i: t for i, t in real.items() if i in toxic}
    docs = spark.createDataFrame(list(real.items()), "doc_id long, text string")
    got = {np.uint64(r.h % 2**64): r for r in toxicity.models(docs, spark.createDataFrame([(t, toxic[i]) for i, t in sample.items()], "text string, toxic int")).collect()}
    corpus = Counter(w for t in real.values() for w in words_of(t))
    share = {w: (n + 1) / (sum(corpus.values()) + len(corpus) + 1) for w, n in corpus.items()}
    for c in (0, 1):
        pairs = {(a, b) for i, t in sample.items() if toxic[i] == c for a, b in zip(["<s>", *words_of(t)], words_of(t), strict=False)}
        before = Counter(b for _, b in pairs)
        rest = 1 - sum(n - 0.75 for n in before.values()) / len(pairs)
        p = {w: max(before[w] - 0.75, 0) / len(pairs) + rest * share[w] for w in corpus}
        assert abs(sum(p.values()) + rest / (sum(corpus.values()) + len(corpus) + 1) - 1) < 1e-9
        listed = {w for i in sample for w in words_of(sample[i])}
        assert len(listed) == len(got)
        in_texts = Counter(w for t in sample.values() for w in set(words_of(t)))
        hashes = dict(zip(sorted(listed), shingles.lower_words([" ".join(sorted(listed))]).flat, strict=True))
        for w in listed:
            assert abs(got[hashes[w]][f"p{c}"] - p[w]) < 1e-12 and abs(got[hashes[w]][f"rest{c}"] - rest) < 1e-9
            assert abs(got[hashes[w]].share - share[w]) < 1e-15 and got[hashes[w]].texts == in_texts[w]


def test_toxicity_query(spark):
    """The contract's columns, the scores of the model by its definition, and quality on rows that didn't train."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    rows = queries.op9_toxicity(spark, sf).collect()
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    ratio = {int(h): r for h, r, n in zip(model.words, model.ratio, model.texts, strict=True) if r > model.rule[0] and n >= model.rule[1]}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        words = shingles.lower_words([docs[r.doc_id]]).flat.tolist()
        z = model.curve[0] * sum(ratio.get(w, 0.0) for w in words) / (len(words) + toxicity.PRIOR_WORDS) + model.curve[1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    caught = sum(p and y for p, y in held)
    assert caught >= 0.7 * sum(y for _, y in held) and caught >= 0.9 * sum(p for p, _ in held)


def test_toxic_column_of_the_input_stays(spark):
    docs = spark.createDataFrame([(i, " ".join(w if i % 4 or k != i // 4 % 12 else f"{w} idiot" for k, w in enumerate("calm words of a day by the wide river in the town".split())), 0.5, "x") for i in range(400)], "doc_id long, text string, toxicity double, __toxicity string")
    kept = toxicity.keep_ordinary(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert kept.columns == docs.columns and {("idiot" in r.text, r.toxicity) for r in kept.collect()} == {(False, 0.5)}


def test_toxicity_trains_on_every_label(spark):
    """All labelled rows that may train do, however many; counts of words are those of all of them."""
    n = 30_000
    docs = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("calm words of a town by the river"), F.when(F.col("id") % 1_000 == 7, F.concat(F.lit(" rude"), (F.col("id") / 5_000).cast("int").cast("string"), F.lit(" idiot")))
        .otherwise(F.concat(F.lit(" day"), (F.col("id") % 50).cast("string")))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 1_000 == 7).cast("int").alias("toxic"))
    may = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.doc_id for r in toxicity.training(labels.unionAll(labels)).collect()) == may
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    assert toxicity.training(many).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40_000)) > 20_000
    model = toxicity.fit(docs, labels)
    held = {i for i in may if zlib.crc32(f"curve{i}".encode()) % toxicity.HELD == 0}
    trained = Counter(f"rude{i // 5_000}" for i in may if i % 1_000 == 7 and i not in held)
    words = dict(zip(model.words.tolist(), model.texts.tolist(), strict=True))
    for w, k in trained.items():
        assert words.get(int(shingles.lower_words([w]).flat[0])) == (k if k >= toxicity.FLOORS[0] else None)
    wrong = toxicity.score(docs, model).where((F.col("toxicity") >= 0.7) != (F.col("doc_id") % 1_000 == 7)).count()
    assert wrong == 0


def test_line_dedup_joins_no_lines_at_the_end(spark, sf_dir):
    """First places and those that go meet with their text in one exchange; the table of all lines isn't joined once more."""
    kept = line_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_line_sketches_against_brute_force():
    """Parity of tokens by slot: 64 for short lines, 256 for long ones, whose words together are the short form."""
    rng = np.random.default_rng(3)
    size = np.array([1, 5, line_dedup.SHORT, line_dedup.SHORT + 1, 2, 300])
    flat = rng.integers(0, 1 << 63, size.sum(), dtype=np.uint64)
    got = line_dedup._sketches(flat, np.repeat(np.arange(len(size)), size), size)
    for row, tokens in zip(got.tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True):
        want = [0, 0, 0, 0]
        for t in tokens.tolist():
            slot = t >> 8 & 255
            want[slot // 64 if len(tokens) > line_dedup.SHORT else 0] ^= 1 << slot % 64
        assert row == want
