"""Candidate places of several sources, fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import let


def weighted_centroid(candidates: DataFrame, key: str) -> DataFrame:
    """(key, x, y, n) of candidates (x, y, confidence 0 to 100, authority), weighted by both."""
    w = F.col("confidence") / 100 * F.col("authority")
    return candidates.groupBy(key).agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.count("*").alias("n"))


def robust_centroid(candidates: DataFrame, key: str) -> DataFrame:
    """(key, x, y, n): Huber's centroid of each key's points, as one fold over its array."""
    points = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    return points.withColumn("m", huber(F.col("p"))).select(key, F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.size("p").cast("long").alias("n"))


def concordance(distance: Column) -> Column:
    """1 up to 100 m, falling to 0.5 at 500 m and to 0 at 2 km."""
    return F.when(distance <= 100, 1.0).when(distance <= 500, 1 - (distance - 100) / 800).when(distance <= 2000, 0.5 - (distance - 500) / 3000).otherwise(0.0)


def status(n: Column, discrepancy: Column) -> Column:
    return F.when(n == 0, "NOT_FOUND").when(n == 1, "SINGLE_SOURCE").when(discrepancy <= 100, "CONFIRMED").when(discrepancy <= 500, "PROBABLE").when(discrepancy <= 2000, "REVIEW").otherwise("CONFLICT")


# ---------------------------------------------------------------- clusters of sources

# How far a source is trusted, in the two validations; distances in metres up to which sources of a kind of place agree.
TRUST = {"LOCAL": 0.95, "WFS_HEALTH": 0.90, "WFS_EDUCATION": 0.90, "WFS_CULTURAL": 0.85, "WFS_SECURITY": 0.85, "CARTOCIUDAD": 0.80, "CDAU": 0.80, "NGA": 0.75, "OVERPASS": 0.60, "NOMINATIM": 0.55}
AUTHORITY = {"CDAU": 0.95, "WFS_SPECIALIZED": 0.92, "WFS_DERA": 0.90, "LOCAL_DERA": 0.88, "CARTOCIUDAD": 0.85, "NGA": 0.80, "IAID": 0.78, "OSM": 0.65, "NOMINATIM": 0.50}
SPREAD = {"SANITARIO": 50, "EDUCATIVO": 50, "SEGURIDAD": 50, "SERVICIOS_BASICOS": 75, "DEPORTIVO": 100, "CULTURAL": 100, "ADMINISTRATIVO": 75, "TRANSPORTE": 150, "HIDRAULICO": 200, "ENERGIA": 200}
#: Metres up to which a kind's sources confirm each other, agree, and need review; the last entry for other kinds.
LIMITS = {
    "SANITARIO": (25, 50, 100), "EMERGENCIAS": (25, 50, 100), "SEGURIDAD": (25, 75, 150), "EDUCATIVO": (50, 100, 200), "ADMINISTRATIVO": (100, 200, 300),
    "CULTURAL": (75, 150, 250), "DEPORTIVO": (100, 200, 300), "ENERGIA": (150, 300, 500), "HIDRAULICO": (100, 250, 400), "": (100, 200, 300),
}
CRITICAL = ["SANITARIO", "EMERGENCIAS", "SEGURIDAD"]


def _lookup(table: dict[str, float], name: Column, default: float | None = None) -> Column:
    found = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[name]
    return found if default is None else F.coalesce(found, F.lit(default))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def huber(points: Column, k: float = 1.345, rounds: int = 20, tolerance: float = 0.1, floor: float = 10.0) -> Column:
    """Struct (x, y, w): Huber's centroid of an array of points and the weight of each; the mean, with full weights, up to two.

    Starts at the mean; the scale is the deviation of the distances from their median, ``floor`` at least; points that are all closer than that keep full weights.
    """
    ones = F.transform(points, lambda _: F.lit(1.0))
    start = F.struct(_mean(F.transform(points, lambda q: q["x"])).alias("x"), _mean(F.transform(points, lambda q: q["y"])).alias("y"), ones.alias("w"), (F.size(points) <= 2).alias("done"))

    def step(m: Column, _: Column) -> Column:
        def fitted(d: Column) -> Column:
            scale = let(_median(d), lambda mid: F.greatest(F.lit(floor), 1.4826 * _median(F.transform(d, lambda v: F.abs(v - mid)))))
            weights = let(scale, lambda s: F.transform(d, lambda v: F.when(v <= k * s, 1.0).otherwise(k * s / v)))
            close = (F.array_max(d) < floor) & (let(_median(d), lambda mid: 1.4826 * _median(F.transform(d, lambda v: F.abs(v - mid)))) < floor)
            return F.when(close, F.struct(m["x"].alias("x"), m["y"].alias("y"), ones.alias("w"), F.lit(True).alias("done"))).otherwise(let(weights, moved))

        def moved(w: Column) -> Column:
            x, y = (_sum(F.zip_with(points, w, (lambda c: lambda q, v: q[c] * v)(c))) / _sum(w) for c in ("x", "y"))
            return let(F.struct(x.alias("x"), y.alias("y")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), w.alias("w"), (F.hypot(c["x"] - m["x"], c["y"] - m["y"]) < tolerance).alias("done")))

        return F.when(m["done"], m).otherwise(let(F.transform(points, lambda q: F.hypot(q["x"] - m["x"], q["y"] - m["y"])), fitted))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def clusters(results: DataFrame, key: str, threshold: float = 100.0) -> DataFrame:
    """(key, n, x, y, radius, concordant, outliers, outlier_trust, concordance) of results (key, source, x, y, authority).

    An outlier has a weight under a half or lies over ``threshold`` from the centroid; radius: the farthest of those with a half at least;
    concordance: the authority of those that agree, as a share. A query's sources are few, so they are one array. Results without coordinates don't count.
    """
    found = results.where("x is not null and y is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "x", "y", "authority"))).alias("p"))
    each = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(
        F.get("p", i)["source"].alias("source"), F.get("p", i)["authority"].alias("authority"), F.get("m.w", i).alias("w"), F.hypot(F.get("p", i)["x"] - F.col("m.x"), F.get("p", i)["y"] - F.col("m.y")).alias("d")))
    judged = found.withColumn("m", huber(F.col("p"))).withColumn("e", each)
    out = F.filter("e", lambda r: (F.size("p") > 1) & ((r["w"] < 0.5) | (r["d"] > threshold)))
    inner = F.filter("e", lambda r: ~((F.size("p") > 1) & ((r["w"] < 0.5) | (r["d"] > threshold))))
    total = _sum(F.transform("e", lambda r: r["authority"]))
    return judged.select(
        key, F.size("p").cast("long").alias("n"), F.col("m.x").alias("x"), F.col("m.y").alias("y"),
        F.coalesce(F.array_max(F.transform(F.filter("e", lambda r: r["w"] >= 0.5), lambda r: r["d"])), F.lit(0.0)).alias("radius"),
        F.size(inner).cast("long").alias("concordant"), F.transform(out, lambda r: r["source"]).alias("outliers"), F.coalesce(F.array_max(F.transform(out, lambda r: r["authority"])), F.lit(0.0)).alias("outlier_trust"),
        F.when(F.size("p") == 1, 1.0).when(total > 0, _sum(F.transform(inner, lambda r: r["authority"])) / total).otherwise(0.0).alias("concordance"),
    )


def composite(match: Column, concordance_: Column, authority: Column) -> Column:
    """0 to 100: 35 parts the match of names (0 to 100, or to 1), 40 the concordance, 25 the authority (0 to 1)."""
    return F.floor((0.35 * F.when(match > 1, match / 100).otherwise(match) + 0.40 * concordance_ + 0.25 * authority) * 100 + 0.5).cast("long")


def discrepancy(radius: Column, outlier_trust: Column, concordance_: Column, kind: Column) -> Column:
    """Struct (found, severity): a radius over twice the kind's spread is high; over it, or a trusted outlier, medium; a concordance under 0.6 low."""
    limit = _lookup(SPREAD, F.upper(kind), 100)
    severity = F.when(radius > 2 * limit, "high").when((radius > limit) | (outlier_trust >= 0.80), "medium").when(concordance_ < 0.6, "low")
    return F.struct(severity.isNotNull().alias("found"), F.coalesce(severity, F.lit("low")).alias("severity"))


def recommendation(score: Column, found: Column, severity: Column, concordant: Column) -> Column:
    """REJECT, MANUAL_REVIEW or USE_RESULT."""
    return (
        F.when((score < 40) | (found & (severity == "high")), "REJECT")
        .when((score < 70) | (found & (severity == "medium")) | (concordant < 2), "MANUAL_REVIEW")
        .otherwise("USE_RESULT")
    )


# ---------------------------------------------------------------- validation of all sources of a query


def agreement(metres: Column, confirmed: Column, likely: Column, uncertain: Column) -> Column:
    """1 up to ``confirmed``, falling to 0.7 at ``likely`` and 0.3 at ``uncertain``; beyond slowly to 0.1."""
    return (
        F.when(metres <= confirmed, 1.0)
        .when(metres <= likely, 1 - 0.3 * (metres - confirmed) / (likely - confirmed))
        .when(metres <= uncertain, 0.7 - 0.4 * (metres - likely) / (uncertain - likely))
        .otherwise(F.greatest(F.lit(0.1), 0.3 - (metres - uncertain) / 5000))
    )


def validated(results: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """(key, n, x, y, score, status, metres, primary, review, reason) of results (key, position, source, x, y, confidence 0 to 100[, kind]).

    Results at zero or without confidence don't count; a query without any other has NO_RESULTS. metres: the largest distance of two sources (one
    decimal). x and y: the weighted centroid of sources that agree, else of the most trusted source, null in a conflict. One aggregation; a query's
    sources are few, so they are one array. Ties go to the first position.
    """
    counts = (F.col("x") != 0) & (F.col("y") != 0) & (F.col("confidence") > 0)
    one = F.struct("position", "source", "x", "y", "confidence", _lookup(AUTHORITY, F.col("source"), 0.5).alias("authority"))
    what = F.max(kind) if kind else F.lit(None).cast("string")
    r = results.groupBy(key).agg(F.array_sort(F.collect_list(F.when(counts, one))).alias("p"), what.alias("kind"))
    far = F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))))
    limit = [_lookup({k: v[i] for k, v in LIMITS.items()}, F.coalesce("kind", F.lit("")), LIMITS[""][i]) for i in range(3)]
    n, c = F.size("p"), F.col("metres")
    r = r.withColumn("metres", F.when(F.size("p") >= 2, F.floor(far * 10 + 0.5) / 10))
    match = F.array_max(F.transform("p", lambda q: q["confidence"])) / 100
    own = _sum(F.transform("p", lambda q: q["confidence"] / 100 * q["authority"])) / _sum(F.transform("p", lambda q: q["authority"]))
    bonus = F.when((n >= 2) & (c <= 25), F.least(F.lit(8.0), (25 - c) / 3)).otherwise(0.0)
    base = (0.40 * match + 0.35 * F.when(n == 1, 0.5).otherwise(agreement(c, *limit)) + 0.25 * own) * 100
    score = F.floor(F.when(bonus > 0, F.least(F.lit(100.0), base + bonus)).otherwise(base) * 10 + 0.5) / 10
    state = F.when(n == 0, "NO_RESULTS").when(n == 1, "SINGLE_SOURCE").when(c <= limit[0], "CONFIRMED").when(c <= limit[1], "LIKELY_VALID").when(c <= limit[2], "UNCERTAIN").otherwise("CONFLICT")
    best = F.get(F.filter("p", lambda q: q["authority"] * q["confidence"] == F.array_max(F.transform("p", lambda o: o["authority"] * o["confidence"]))), 0)
    r = r.select(key, "kind", "p", "metres", F.coalesce(score, F.lit(0.0)).alias("score"), state.alias("status"), best.alias("best"))
    weight = _sum(F.transform("p", lambda q: q["confidence"] / 100 * q["authority"]))
    at = lambda a: F.when(F.col("status").isin("CONFIRMED", "LIKELY_VALID"), _sum(F.transform("p", lambda q: q[a] * (q["confidence"] / 100 * q["authority"]))) / weight).when(F.col("status").isin("UNCERTAIN", "SINGLE_SOURCE"), F.col("best")[a])
    reason = (
        F.when(F.col("status") == "CONFLICT", "CONFLICT").when(F.col("score") < 60, "LOW_SCORE")
        .when((F.col("status") == "SINGLE_SOURCE") & F.col("kind").isin(CRITICAL), "CRITICAL_SINGLE").when((F.col("score") < 80) & F.col("kind").isin(CRITICAL[:2]), "CRITICAL_SCORE")
    )
    return r.select(key, F.size("p").cast("long").alias("n"), at("x").alias("x"), at("y").alias("y"), "score", "status", "metres", F.col("best.source").alias("primary"), reason.isNotNull().alias("review"), reason.alias("reason"))


# ---------------------------------------------------------------- spread of a query's sources


def spread(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, middle, mad) of ``value``: median and scaled median deviation, from one array a key; sources of a query are few (for groups without a bound, ``percentile`` twice)."""
    found = candidates.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v")).withColumn("middle", _median(F.col("v")))
    return found.select(key, "middle", (1.4826 * _median(F.transform("v", lambda x: F.abs(x - F.col("middle"))))).alias("mad"))


def farthest(candidates: DataFrame, key: str, source: str) -> DataFrame:
    """(key, metres): the largest distance of points of two sources, from one array a key; null where there is only one source."""
    found = candidates.groupBy(key).agg(F.collect_list(F.struct(F.col(source).alias("s"), "x", "y")).alias("p"))
    apart = lambda a, b: F.when(a["s"] < b["s"], F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])))
    return found.select(key, F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: apart(a, b))))).alias("metres"))
