"""Distances and projections in closed form, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


# The GRS80 ellipsoid and the scale and false easting of UTM.
_A, _F, _K0, _E0 = 6_378_137.0, 1 / 298.257222101, 0.9996, 500_000.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int = 30) -> Column:
    """Struct (x, y) of degrees, by Krüger's series to the third order (millimetres)."""
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_E0 + _K0 * _R * x).alias("x"), (_K0 * _R * y).alias("y"))


def from_utm(x: Column, y: Column, zone: int = 30) -> Column:
    """Struct (lon, lat) in degrees."""
    xi, eta = y / (_K0 * _R), (x - _E0) / (_K0 * _R)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(phi).alias("lat"))


def to_degrees_roughly(x: Column, y: Column) -> Column:
    """Struct (lon, lat) by constant metres a degree, good to a few kilometres near the zone's middle."""
    return F.struct((-3.0 + (x - _E0) / 85_000.0).alias("lon"), (y / 111_000.0).alias("lat"))


# Semi-major axis and flattening of the ellipsoids, and EPSG codes as (zone or None for degrees, ellipsoid).
ELLIPSOIDS = {"GRS80": (6_378_137.0, 1 / 298.257222101), "WGS84": (6_378_137.0, 1 / 298.257223563), "intl": (6_378_388.0, 1 / 297.0)}
SYSTEMS = {
    "EPSG:25829": (29, "GRS80"), "EPSG:25830": (30, "GRS80"), "EPSG:25831": (31, "GRS80"), "EPSG:32629": (29, "WGS84"), "EPSG:32630": (30, "WGS84"), "EPSG:32631": (31, "WGS84"),
    "EPSG:23029": (29, "intl"), "EPSG:23030": (30, "intl"), "EPSG:23031": (31, "intl"), "EPSG:4326": (None, "WGS84"), "EPSG:4258": (None, "GRS80"), "EPSG:4230": (None, "intl"),
}
#: Metres (dx, dy, dz) from ED50 to WGS84: the mean shift for Spain and Portugal. Not applied unless asked for.
ED50_SHIFT = (-84.0, -107.0, -120.0)


def geodetic(x: Column, y: Column, zone: int, ellipsoid: str) -> Column:
    """Struct (lon, lat) of a transverse Mercator place on any ellipsoid, by scaling to the series of the first."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    r = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta = y / (_K0 * r), (x - _E0) / (_K0 * r)
    u, v = xi, eta
    for j, b in enumerate((n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480), 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate((2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15), 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((zone * 6 - 183 + F.degrees(F.atan2(F.sinh(v), F.cos(u)))).alias("lon"), F.degrees(phi).alias("lat"))


def shifted(lon: Column, lat: Column, source: str, target: str, by: tuple[float, float, float]) -> Column:
    """Struct (lon, lat) after a shift of the earth's centre, at height 0 (Bowring's formula back; under a millimetre)."""
    (a, f), (b, g) = ELLIPSOIDS[source], ELLIPSOIDS[target]
    e2, h2 = f * (2 - f), g * (2 - g)
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    x, y, z = nu * F.cos(phi) * F.cos(lam) + by[0], nu * F.cos(phi) * F.sin(lam) + by[1], nu * (1 - e2) * F.sin(phi) + by[2]
    p = F.hypot(x, y)
    theta = F.atan2(z * b, p * b * (1 - g))
    top = z + h2 / (1 - h2) * b * (1 - g) * F.pow(F.sin(theta), 3)
    return F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(top, p - h2 * b * F.pow(F.cos(theta), 3))).alias("lat"))


def reprojected(rows: DataFrame, x: str, y: str, system: str, shift: tuple[float, float, float] | None = None) -> DataFrame:
    """``rows`` with columns ``x`` and ``y`` in EPSG:25830 instead of ``system`` (x is the longitude for degrees).

    Unknown systems give nulls. ED50 keeps its degrees on the new ellipsoid unless ``shift`` gives parameters. Each step
    is a projection of its own: the series use their arguments many times, and as one expression they would multiply.
    """
    if system not in SYSTEMS:
        return rows.withColumns({x: F.lit(None).cast("double"), y: F.lit(None).cast("double")})
    zone, ellipsoid = SYSTEMS[system]
    steps = [] if zone is None else [("lon", "lat", lambda a, b: geodetic(a, b, zone, ellipsoid))]
    if shift is not None:
        steps.append(("lon", "lat", lambda a, b: shifted(a, b, ellipsoid, "GRS80", shift)))
    for first, second, step in [*steps, ("x", "y", lambda a, b: to_utm(a, b, 30))]:
        rows = rows.withColumn("__place", step(F.col(x), F.col(y)))
        rows = rows.withColumns({x: F.col("__place")[first], y: F.col("__place")[second]}).drop("__place")
    return rows


def system_of(x: Column, y: Column) -> Column:
    """The coordinate system that mean absolute values of a sample speak for."""
    return F.when((F.abs(x) <= 180) & (F.abs(y) <= 90), "EPSG:4326").when(x.between(100_000, 800_000) & y.between(3_980_000, 4_350_000), "EPSG:25830").otherwise("UNKNOWN")
