"""The whole job where a query of the star schema does a part of it: whole names, all rows, no radius."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from terrasift.functions import coords
from terrasift.operators import candidates, profile, spatial
from terrasift.plans import registry, views


def ask(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir)


# ------------------------------------------------------------ whole names


def name_score(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 100.0
    if a in b:
        return 80.0
    if b in a:
        return 60.0
    words = a.split()
    return sum(any(w in o or o in w for o in b.split()) for w in words) * 40.0 / len(words)


def similarity(a, b):
    a, b = (" ".join(re.findall("[a-z0-9]+", t.lower())) for t in (a, b))
    if a == b:
        return 100.0
    if a in b or b in a:
        return 70 + 30 * min(len(a), len(b)) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    j = len(x & y) / len(x | y)
    return 60.0 if j >= 0.5 else 50 * j


@pytest.fixture(scope="module")
def named(spark):
    """Requests and features of two municipalities: names of one to four words that often share endings."""
    r = random.Random(7)
    name = lambda: " ".join(r.choices(["Casa", "Vieja", "centro", "Salud", "Norte", "Casa-Norte", "Sal", "1040", "0040"], k=r.randint(1, 4)))
    p, f = [(i, r.choice("ab"), name()) for i in range(60)], [(i, r.choice("ab"), name()) for i in range(40)]
    return p, f, spark.createDataFrame(p, "id int, mun string, name string"), spark.createDataFrame(f, "fid int, mun string, fname string")


def test_best_names_brute_force(named):
    p, f, requests, features = named
    want = set()
    for i, m, n in p:
        best = sorted((-name_score(n, o), k) for k, mun, o in f if mun == m)[:2]
        want |= {(i, k, -s) for s, k in best}
    assert {tuple(r) for r in candidates.best_names(requests, features, ["mun"], "id", "fid", 2).select("id", "fid", "score").collect()} == want
    assert {s for _, _, s in want} >= {100.0, 80.0, 60.0}


def test_best_match_brute_force(named):
    p, f, requests, features = named
    want = set()
    for i, m, n in p:
        score, k = min((-similarity(n, o), k) for k, mun, o in f if mun == m)
        want |= {(i, k, "MATCH")} if -score >= 50 else set()
    assert {tuple(r) for r in candidates.best_match(requests, features, ["mun"], "id", "fid", 50.0).select("id", "fid", "how").collect()} == want


def test_whole_names(spark):
    """Customer#…1040 isn't Supplier#…0040, though both end in 040."""
    sf = "/root/testdata/sf0.1"
    assert {r.score for r in ask(spark, sf, "name_candidates_whole").select("score").distinct().collect()} == {0.0}
    assert ask(spark, sf, "source_match_whole").where("how = 'MATCH'").count() == 0


# ------------------------------------------------------------ nearest, however far


def test_nearest_all_brute_force(spark):
    """A cluster, a few far points and one very far: sparse places have neighbours too, equal distances go by key."""
    r = random.Random(11)
    f = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(200)] + [(200, 5_000.0, 5_000.0), (201, -90_000.0, 40.0), (202, 5_000.0, 5_010.0)]
    p = [(i, r.uniform(-50, 150), r.uniform(-50, 150)) for i in range(50)] + [(50, 1e6, -1e6), (51, 5_000.0, 5_005.0), (52, -90_000.0, 40.0), (53, None, 1.0)]
    got = spatial.nearest_all(spark.createDataFrame(p, "id int, x double, y double"), spark.createDataFrame(f, "fid int, x double, y double"), "id", "fid", 4)
    want = {(i, k, n) for i, x, y in p if x is not None for n, (_, k) in enumerate(sorted((math.hypot(x - a, y - b), k) for k, a, b in f)[:4], 1)}
    assert {(r.id, r.fid, r["rank"]) for r in got.collect()} == want


def test_nearest_all_small(spark):
    """Fewer than k features give them all; none, or all on one place, are no trouble."""
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id int, x double, y double")
    f = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.0)], "fid int, x double, y double")
    assert sorted((r.id, r.fid, r["rank"]) for r in spatial.nearest_all(p, f, "id", "fid", 3).collect()) == [(1, 7, 1), (1, 8, 2), (2, 7, 1), (2, 8, 2)]
    assert spatial.nearest_all(p, f.limit(0), "id", "fid", 3).collect() == []


def test_three_for_every_point(spark, sf_dir):
    assert ask(spark, sf_dir, "nearest_features_all").groupBy("id").count().where("count = 3").count() == 150


# ------------------------------------------------------------ all rows


def test_every_point_has_a_border(spark, sf_dir):
    """Inside and outside, before all four sides and all four corners, against the closed form."""
    p = {r.id: (r.x, r.y) for r in views.points(spark, sf_dir).collect()}
    got = {r.id: r.distance for r in ask(spark, sf_dir, "border_distance_all").collect()}
    assert got.keys() == p.keys()
    zones = set()
    for k, (x, y) in p.items():
        dx, dy = max(200_000 - x, x - 400_000), max(4_000_000 - y, y - 4_150_000)
        want = -max(dx, dy) if max(dx, dy) <= 0 else math.hypot(max(dx, 0), max(dy, 0))
        assert got[k] == pytest.approx(want, abs=0.0051)
        zones.add((dx > 0, dy > 0, dx > dy))
    assert {z[:2] for z in zones} == {(False, False), (True, False), (False, True), (True, True)} and {(False, False, True), (False, False, False)} <= zones


def test_every_point_meets_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.shape, r.rule): r.n for r in ask(spark, sf, "rules_apply_all").groupBy((F.col("id") % 4).alias("shape"), "rule").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 1_500 and got[2, "comma"] == 375 and got[3, None] == 375
    assert {(0, "scale"), (0, None), (1, "north"), (1, None)} <= got.keys()


def test_boxes_hold_every_kind(spark, sf_dir):
    f = views.features(spark, sf_dir).collect()
    box = {m: [g(v) for v in zip(*((r.x, r.y) for r in f if r.mun == m), strict=True) for g in (min, max)] for m in {r.mun for r in f}}
    meet = lambda a, b: all(a[i] - 100 <= b[i + 1] + 100 and b[i] - 100 <= a[i + 1] + 100 for i in (0, 2))
    want = {(a, b) for a in box for b in box if a < b and meet(box[a], box[b])}
    assert {tuple(r) for r in ask(spark, sf_dir, "bbox_adjacency_all").collect()} == want


# ------------------------------------------------------------ all documents


def test_every_document(spark, tmp_path):
    """German, null, plain and mixed texts have a digest too; what is sound comes out of the repair unchanged."""
    texts = ["Größe der Straße", None, "plain text", "", "Año, sehr schön", "naïve À la carte"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    words = ["gro e der stra e", None, "plain text", "", "ano sehr schon", "naive a la carte"]
    assert {r.doc_id: r.digest for r in ask(spark, f"file://{tmp_path}", "accent_normalise_all").collect()} == dict(enumerate(map(md5, words)))
    assert {r.doc_id: (r.repaired, r.plain) for r in ask(spark, f"file://{tmp_path}", "mojibake_fix_all").collect()} == {i: (md5(t), md5(t)) for i, t in enumerate(texts)}


# ------------------------------------------------------------ placeholders


def test_every_placeholder(spark):
    """The reference's 27 texts, three empty ones and 11 numbers (which are read from a text's start); near misses stay values."""
    texts = ["indicar", "pendiente", "sin datos", "sin data", "n/a", "na", "n.a.", "n.d.", "nd", "por definir", "desconocido", "ninguno", "xxx", "tbd", "todo", "ver plano", "consultar", "a determinar"]
    texts += ["sin información", "sin informacion", "no especificada", "no especificado", "inexistente", "inexistentes", "-", "--", "---", "", "null", "undefined", "Sin Datos ", "SIN INFORMACIÓN", None]
    numbers = ["0", "1", "-1", "99999", "999999", "9999999", "-9999", "-99999", "-999999", "12345", "123456", "-9999.0", "12345 m"]
    sound = ["12346", "123457", "-9998", "12345.5", "436780"]
    df = spark.createDataFrame([(t,) for t in texts + numbers + sound], "t string").select("t", coords.is_placeholder(F.col("t")).alias("p"), coords.parse(F.col("t")).alias("v"))
    got = {r.t: (r.p, r.v) for r in df.collect()}
    assert {t for t, (p, _) in got.items() if not p} == set(sound)
    assert {t for t, (_, v) in got.items() if v is not None} == set(sound)


def test_placeholders_are_not_located(spark):
    """A record with -9999 or 12345 isn't readable, one with 'sin datos' isn't filled in."""
    rows = [("a", "-9999", "4229920"), ("a", "436780", "12345"), ("a", "sin datos", "4229920"), ("a", "436780", "4229920")]
    got = profile.profile(spark.createDataFrame(rows, "doc string, x string, y string"), "doc", "x", "y").first()
    assert (got.n, got.with_x, got.with_y, got.with_both, got.missing, got.readable) == (4, 2, 3, 1, 3, 5)


def test_nearest_up_to_a_radius(spark, monkeypatch):
    """Brute force within the radius, from far fewer hits than lie within it; lonely points have what the radius holds."""
    r = random.Random(5)
    f = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(400)] + [(400, 150.0, 150.0)]
    p = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(300)] + [(300, 150.0, 110.0), (301, 150.0, 200.0), (302, 400.0, 400.0), (303, 1.0, None)]
    made, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, d: made.append(within(a, b, d)) or made[-1])
    got = spatial.nearest(spark.createDataFrame(p, "id int, x double, y double"), spark.createDataFrame(f, "fid int, x double, y double"), "id", "fid", 3, 50.0)
    want = {(i, k, n) for i, x, y in p if y is not None for n, (d, k) in enumerate(sorted((math.hypot(x - a, y - b), k) for k, a, b in f)[:3], 1) if d <= 50}
    assert {(q.id, q.fid, q["rank"]) for q in got.collect()} == want
    assert {(i, k) for i, k, _ in want if i > 300} == {(301, 400)}
    near = sum(math.hypot(x - a, y - b) <= 50 for _, x, y in p if y is not None for _, a, b in f)
    assert sum(d.count() for d in made) < near / 4


@pytest.mark.parametrize("floor", [-1.0, 3.0, 12.5, 25.0, 50.0, 60.0, 85.0])
def test_best_match_at_any_floor(spark, floor):
    """Names that are empty, hold others across words, repeat or share few words; whatever the floor, no match is lost."""
    r = random.Random(int(floor))
    name = lambda: r.choice([" ", "-", "."]).join(r.choices(["casa", "de", "la", "sal", "as", "ad", "salud", "e", "norte", "vieja", "c", "rio", "alto"], k=r.choice([0, 1, 1, 2, 3, 4, 5, 7])))
    p, f = [(i, r.choice("abc"), name()) for i in range(80)], [(i, r.choice("abd"), name()) for i in range(60)]
    f += [(100, "c", "una"), (101, "e", "no")]
    p += [(200, "c", "otra"), (201, None, "una")]

    def score(a, b):
        empty = [not re.findall("[a-z0-9]+", t) for t in (a, b)]
        return 100.0 if all(empty) else 0.0 if any(empty) else similarity(a, b)

    want = set()
    for i, m, n in p:
        own = sorted((-score(n, o), k) for k, mun, o in f if mun == m)
        want |= {(i, own[0][1], "MATCH", -own[0][0])} if own and -own[0][0] >= floor else {(i, own[0][1], "ONLY", -own[0][0])} if len(own) == 1 else set()
    got = candidates.best_match(spark.createDataFrame(p, "id int, mun string, name string"), spark.createDataFrame(f, "fid int, mun string, fname string"), ["mun"], "id", "fid", floor, only=1)
    assert {(q.id, q.fid, q.how, round(q.score, 6)) for q in got.collect()} == {(i, k, h, round(s, 6)) for i, k, h, s in want}
