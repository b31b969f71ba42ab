"""Column functions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from terrasift.functions import coords, geo, text
from terrasift.operators import fusion, spatial


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "raw, value",
    [("504 750´´92", 504750.92), ("4 077 153´´36", 4077153.36), ("4.077.905,68", 4077905.68), ("436780,0", 436780.0), ("4.229.920", 4229920.0), ("503693´77", 503693.77), ("Indicar", None), ("N/A", None), ("0", None), ("99999", None), (None, None), ("", None), ("37°26'46.5\"N", 37.44625), ("3726.775N", 37.44625)],
)
def test_parse(spark, raw, value):
    got = one(spark, coords.parse(F.col("t")), t=raw)
    assert got is None if value is None else got == pytest.approx(value, abs=1e-4)


def test_pairs(spark):
    assert one(spark, coords.pair(F.col("x"), F.col("y")), x=500000.0, y=77905.0).asDict() == {"x": 500000.0, "y": 4077905.0, "swapped": False, "fixed": True, "confidence": "MEDIA"}
    assert one(spark, coords.pair(F.col("x"), F.col("y")), x=4077905.0, y=500000.0).swapped
    got = one(spark, coords.parse_nmea_pair(F.col("t")), t="$GPGGA,123519,3726.775,N,00345.204,W,1,08,0.9,545.4,M,46.9,M,,*47")
    assert (got.lat, got.lon) == (pytest.approx(37.44625), pytest.approx(-3.7534))
    assert one(spark, coords.parse_geojson(F.col("t")), t='{"type":"Point","coordinates":[504750,4077153]}').y == 4077153


def test_projection_round_trip(spark):
    utm = one(spark, geo.to_utm(F.col("lon"), F.col("lat")), lon=-3.0, lat=37.0)
    assert utm.x == pytest.approx(500000, abs=1e-3) and utm.y == pytest.approx(4094989.0, abs=500)
    away = one(spark, geo.to_utm(F.col("lon"), F.col("lat")), lon=-4.5, lat=36.7)
    back = one(spark, geo.from_utm(F.col("x"), F.col("y")), x=away.x, y=away.y)
    assert (back.lon, back.lat) == (pytest.approx(-4.5, abs=1e-8), pytest.approx(36.7, abs=1e-8))


def test_text(spark):
    assert one(spark, text.repair_encoding(F.col("t")), t="MÃ¡laga") == "Málaga"
    assert one(spark, text.repair_encoding(F.col("t")), t="Málaga") == "Málaga"
    assert one(spark, text.repair_encoding(F.col("t")), t="AlmerÃ\u00ada nº 3 日本 Ã Â¿") == "Almería nº 3 日本 Ã ¿"
    assert one(spark, text.repair_encoding(F.col("t")), t=None) is None
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="Centro de Salud", b="centro salúd de") == 60.0
    assert one(spark, text.similarity(F.col("a"), F.col("b")), a="Almería", b="ALMERIA") == 100.0
    assert one(spark, text.split_camel(F.col("t")), t="CentroSalud24") == "Centro Salud 24"


def test_grid_join_is_the_cross_join(spark):
    points = [(i, float(i * 7919 % 1000), float(i * 104729 % 1000)) for i in range(120)]
    left, right = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(points, "fid long, x double, y double")
    got = {(r.id, r.fid) for r in spatial.within(left, right, 90.0).collect()}
    assert got == {(a, b) for a, x, y in points for b, u, v in points if math.hypot(x - u, y - v) <= 90}


def test_robust_centroid_resists_an_outlier(spark):
    rows = [(1, 0.0, 0.0), (1, 10.0, 0.0), (1, 0.0, 10.0), (1, 10.0, 10.0), (1, 9000.0, 9000.0), (2, 4.0, 6.0), (2, 8.0, 2.0)]
    got = {r.k: (r.x, r.y) for r in fusion.robust_centroid(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    assert got[2] == (6.0, 4.0) and abs(got[1][0] - 5) < 10 and abs(got[1][1] - 5) < 10


@pytest.mark.parametrize(
    "raw, cleaned, kind",
    [
        ("C/Garcilaso de la Vega, n/ 5, bajo, Tíjola, disponible 24 horas", "Calle Garcilaso de la Vega, 5, Tíjola", "STREET"),
        ("Lugar más próximo donde se localice la emergencia", None, "NAMED"),
        ("Avda. Andalucía nº 12", "Avenida Andalucía, 12", "STREET"),
        ("Ctra. A-92 km 3", "Carretera A-92 km 3", "ROAD"),
        ("Paraje Los Llanos s/n", "Paraje Los Llanos s/n", "RURAL"),
        ("", None, "EMPTY"),
        (None, None, "EMPTY"),
    ],
)
def test_address(spark, raw, cleaned, kind):
    from terrasift.functions import address

    got = one(spark, F.struct(address.clean(F.col("t")).alias("c"), address.kind(F.col("t")).alias("k"), address.quality(F.col("t")).alias("q")), t=raw)
    assert (got.c, got.k) == (cleaned, kind)
    assert (got.q > 0) == (cleaned is not None)


def test_address_parts(spark):
    from terrasift.functions import address

    got = one(spark, address.parts(F.col("t")), t="C/ Mayor, 7, 18001 Granada")
    assert (got.street, got.number, got.postcode, got.locality) == ("Calle Mayor", "7", "18001", "Granada")
    assert one(spark, address.geocodable(F.col("t")), t="C/ Mayor, 7, 18001 Granada")
