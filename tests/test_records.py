"""Rules, profiles, candidates, codes, fused texts and topologies on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from terrasift.functions import codes, fused_text, geo
from terrasift.operators import candidates, profile, rules
from terrasift.sources import topology


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "raw, text, n, level",
    [
        ("CentroSalud", "Centro Salud", 1, "ALTA"), ("Centro de Salud", "Centro de Salud", 0, "ALTA"), ("CENTRODESALUD", "CENTRO DE SALUD", 1, "ALTA"),
        ("AYUNTAMIENTOVIEJOZZ", "AYUNTAMIENTOVIEJOZZ", 0, "MEDIA"), ("plaza.Mayor", "plaza. Mayor", 1, "ALTA"), ("", "", 0, "ALTA"), ("calle12345", "calle 12345", 1, "ALTA"),
    ],
)
def test_separate(spark, raw, text, n, level):
    got = one(spark, fused_text.separate(F.col("t"), ["CENTRO", "DE", "SALUD"]), t=raw)
    assert (got.text, len(got.rules), got.confidence) == (text, n, level)


def test_separate_null_and_misplaced(spark):
    assert one(spark, fused_text.separate(F.col("t")), t=None) is None
    assert [one(spark, fused_text.misplaced(F.col("t")), t=t) for t in ("1 SARGENTO JEFE DE PARQUE", "Lunes a viernes", "Jefe de turno", None)] == ["STAFF", "HOURS", None, None]


def test_codes(spark):
    rows = [("18087", "18087", None), ("18088", "18087", None), ("29067", "18087", None), ("28079", None, None), ("", "18087", None), (None, None, None), ("29067", None, "18"), ("29067", None, None)]
    df = spark.createDataFrame(rows, "got string, wanted string, p string")
    got = [r.m for r in df.select(codes.rejection(F.col("got"), F.col("wanted"), F.col("p")).alias("m")).collect()]
    assert got == [None, "municipio_incorrecto", "provincia_incorrecta", "fuera_andalucia", "sin_codigo_ine", "sin_codigo_ine", "provincia_incorrecta", None]
    assert one(spark, codes.padded(F.col("t")), t="4013") == "04013" and one(spark, codes.padded(F.col("t")), t="x") is None


def test_rules(spark, tmp_path):
    rows = [(1, "range", 1.0, 5.0, None, None, "multiply", 0.0), (2, "range", 1.0, None, None, None, "add", 10.0), (3, "custom", None, None, None, None, "add", 1.0)]
    catalogue = spark.createDataFrame([(k, f"r{k}", "both", kind, lo, hi, p, d, a, n, None, None) for k, kind, lo, hi, p, d, a, n in rows], rules.SCHEMA)
    values = spark.createDataFrame([(1, 3.0, "3", "x"), (2, 0.0, "0", "y"), (3, None, None, "x")], "id int, value double, raw string, field string")
    assert {r.id: (r.rule, r.corrected) for r in rules.apply(values, catalogue).collect()} == {1: ("r2", 13.0), 2: (None, 0.0), 3: (None, None)}
    assert {r.id: r.rule for r in rules.apply(values, catalogue.limit(0)).collect()} == {1: None, 2: None, 3: None}
    rules.export(catalogue, f"file://{tmp_path}/r")
    back = rules.imported(spark, f"file://{tmp_path}/r", catalogue.where("rank = 1"))
    assert sorted(r.id for r in back.collect()) == ["r1", "r2", "r3"]


def test_profile(spark):
    rows = [("a", "436780,5", "4.229.920"), ("a", "1,25", "N/A"), ("a", None, ""), ("b", "500000.5", "4 229 920")]
    got = {r.doc: r for r in profile.profile(spark.createDataFrame(rows, "doc string, x string, y string"), "doc", "x", "y").collect()}
    assert (got["a"].n, got["a"].with_x, got["a"].with_y, got["a"].with_both, got["a"].missing) == (3, 1, 1, 1, 4)  # 1,25 starts like the placeholder 1
    assert (got["a"].decimal_mark, got["a"].thousands_mark, got["b"].decimal_mark, got["b"].thousands_mark) == (",", ".", ".", " ")
    assert got["a"].notations == {"comma": 1, "placeholder": 4, "thousands": 1}


@pytest.mark.parametrize("wanted, name, score", [("Salud", "SALÚD", 100.0), ("salud", "Centro de Salud", 80.0), ("Centro de Salud Norte", "centro de salud", 60.0), ("casa vieja", "la casa", 20.0), ("uno", "dos", 0.0)])
def test_name_score(spark, wanted, name, score):
    assert one(spark, candidates.name_score(F.col("a"), F.col("b")), a=wanted, b=name) == score


def test_scopes_and_cascade(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id int, fid int")
    got = candidates.scoped(make((1, 10)), make((1, 11), (2, 12)), make((1, 13), (2, 14), (3, 15)), "id").collect()
    assert {(r.id, r.fid, r.scope) for r in got} == {(1, 10, 0), (2, 12, 1), (3, 15, 2)}
    c = spark.createDataFrame([(1, 0, 80.0), (1, 1, 90.0), (2, 0, 95.0), (2, 1, 90.0), (3, 0, 60.0), (3, 2, 70.0), (4, 2, 10.0)], "id int, level int, confidence double")
    assert {(r.id, r.level, r.confidence) for r in candidates.cascade(c, "id", {0: 70.0, 1: 50.0, 2: 55.0}).collect()} == {(1, 1, 90.0), (2, 0, 95.0), (3, 2, 70.0)}


def test_spatial_trace(spark):
    c = candidates.spatial_cascade(F.col("x"), F.lit(4_100_000.0), F.lit(300_000.0), F.lit(4_100_000.0), F.col("x") < 300_000, F.col("x") - 300_000, F.lit(None).cast("string"))
    got = one(spark, c, x=300_050.0)
    assert (got.level, got.state, [(t.level, t.passed) for t in got.trace]) == (3, "AT_BORDER", [(1, True), (2, False), (3, True)])
    assert one(spark, c, x=900_000.0).state == "OUT_OF_RANGE"


def test_topology(spark, tmp_path):
    arcs = [[[0, 0], [10, 0]], [[10, 0], [0, 10], [-10, 0], [0, -10]], [[10, 0], [10, 0], [0, 10], [-10, 0]]]
    geometries = [
        {"type": "Polygon", "arcs": [[0, 1]], "properties": {"cod_ine": "18001", "nombre": "A"}},
        {"type": "MultiPolygon", "arcs": [[[2, 3]]], "properties": {"COD_INE": "18002"}}, {"type": "MultiPolygon", "arcs": [[[-4, -3]]], "properties": {"cod_ine": "18003"}}, {"type": "Polygon", "arcs": [[0, 1]], "properties": {}},
    ]
    arcs.append([[20, 10], [-10, 0], [0, -10]])
    top = {"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [100, 200]}, "objects": {"municipios": {"type": "GeometryCollection", "geometries": geometries}}, "arcs": arcs}
    top["arcs"][2] = [[10, 0], [10, 0], [0, 10]]
    (tmp_path / "t.json").write_text(json.dumps(top))
    found = topology.rings(spark, f"file://{tmp_path}/t.json", "municipios")
    got = {r.code: [(p.x, p.y) for p in r.points] for r in found.collect()}
    assert got["18001"] == [(100, 200), (105, 200), (105, 205), (100, 205), (100, 200)]
    assert got["18002"] == [(105, 200), (110, 200), (110, 205), (105, 205), (105, 200)]
    assert got["18003"] == got["18002"][::-1]
    assert {tuple(r) for r in topology.boxes(found).where("code = '18001'").collect()} == {("18001", 100.0, 200.0, 105.0, 205.0)}


def moved(spark, x, y, system, shift=None):
    return geo.reprojected(spark.createDataFrame([(x, y)], "x double, y double"), "x", "y", system, shift).first()


def test_reprojection(spark):
    want = one(spark, geo.to_utm(F.col("lon"), F.col("lat")), lon=-4.2, lat=37.1)
    for system, zone in (("EPSG:25829", 29), ("EPSG:25831", 31)):
        there = one(spark, geo.to_utm(F.col("lon"), F.col("lat"), zone), lon=-4.2, lat=37.1)
        here = moved(spark, there.x, there.y, system)
        assert (here.x, here.y) == (pytest.approx(want.x, abs=0.01), pytest.approx(want.y, abs=0.01))
    assert moved(spark, -4.2, 37.1, "EPSG:4326").x == pytest.approx(want.x, abs=1e-6)
    assert moved(spark, -4.2, 37.1, "EPSG:4258", (0.0, 0.0, 0.0)).y == pytest.approx(want.y, abs=1e-4)
    old = moved(spark, 500_000.0, 4_100_000.0, "EPSG:23030", geo.ED50_SHIFT)
    assert 80 < 500_000 - old.x < 150 and 180 < 4_100_000 - old.y < 230
    assert moved(spark, 1.0, 1.0, "EPSG:1").x is None and moved(spark, None, 1.0, "EPSG:25829").x is None


@pytest.mark.parametrize(
    "raw, street, reason",
    [
        ("Policía Local, C/GARCILASO DE LA VEGA, n/ 5, disponible 24 horas", "Calle Garcilaso de la Vega, 5", None), ("C/ Mayor 3 y C/ Menor 4", None, "SEVERAL"), ("POLIGONO C/ QUINTA AVENIDA", "Polígono, Calle Quinta Avenida", None),
        ("POLIGONO C/ QUINTA", "Polígono, Calle Quinta", None), ("C/ PLAZA DE LA CONSTITUCIÓN", "Plaza de la Constitución", None), ("Parcela 12 polígono 3", None, "CADASTRAL"), ("", None, "NO_PLACE"),
    ],
)
def test_street(spark, raw, street, reason):
    from terrasift.functions import address

    got = one(spark, address.street(F.col("t")), t=raw)
    assert (got.street, got.reason) == (street, reason)


def test_street_null(spark):
    from terrasift.functions import address

    assert one(spark, address.street(F.col("t")), t=None) is None


def test_source_answers(spark):
    requests = spark.createDataFrame([(1, "a", "Torre Vodafone norte"), (2, "b", "nada"), (3, "c", "nada")], "id int, mun string, name string")
    layer = spark.createDataFrame([(5, "a", "torre norte", "Orange"), (6, "a", "torre", "Vodafone"), (7, "b", "x_y", "Orange"), (8, "c", "uno", "A"), (9, "c", "dos", "B")], "fid int, mun string, fname string, operator string")
    assert {(r.id, r.fid, r.how) for r in candidates.best_match(requests, layer, ["mun"], "id", "fid", 60.0, only=1).collect()} == {(1, 6, "MATCH"), (2, 7, "ONLY")}
    assert {(r.id, r.fid) for r in candidates.by_operator(layer, requests, ["mun"], "id", "fid").collect()} == {(1, 6), (2, 7), (3, 8)}
    assert [r.fid for r in layer.where(candidates.predicate("fname", "x_y")).collect()] == [7] and layer.where(candidates.predicate("fname", "_")).count() == 1
