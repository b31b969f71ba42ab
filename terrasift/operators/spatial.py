"""Joins by place. Cells of a grid make an equi-join of what would be a join by distance; a filter decides."""

from __future__ import annotations

import math
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import planar


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (left columns, right columns, distance) of points (x, y) at most ``radius`` apart. Column names must differ but for x, y.

    A right point goes to the nine cells around it, so each pair meets in exactly one cell.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.withColumn("__cx", cell("x")).withColumn("__cy", cell("y"))
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    b = right.withColumnsRenamed({"x": "__x", "y": "__y"})
    b = b.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    b = b.withColumn("__cx", F.floor(F.col("__x") / radius).cast("long") + F.col("__dx")).withColumn("__cy", F.floor(F.col("__y") / radius).cast("long") + F.col("__dy")).drop("__dx", "__dy")
    out = a.join(b, ["__cx", "__cy"]).withColumn("distance", planar(F.col("x"), F.col("y"), F.col("__x"), F.col("__y")))
    return out.where(F.col("distance") <= radius).drop("__cx", "__cy", "__x", "__y")


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int, radius: float) -> DataFrame:
    """The k nearest right points of each left point within ``radius``, with their rank; equal distances by right key."""
    return nearest_all(left, right, left_key, right_key, k, radius)


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share (``spark.checkpoint.dir``); local mode gets a folder of its own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terrasift-"))
    return df.checkpoint()


def nearest_all(left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int, most: float = math.inf) -> DataFrame:
    """The k nearest right points of each left point, however far (or up to ``most``), with their rank; equal distances by right key. Points without a place have no row.

    Rounds of :func:`within`: the first radius holds a few right points at their mean density, and left points with fewer than k hits go
    through a radius twice as long, until one spans both tables or is ``most``. Hits inside a radius are complete, so k of them are the nearest.
    A round's hits and the points left over are checkpointed, or the plan would grow with the power of the rounds.
    """
    box = [f(c).alias(f"{c}_{i}") for i, f in enumerate((F.min, F.max)) for c in ("x", "y")]
    placed = lambda d: d.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    todo, right = placed(left), placed(right)
    both = [d.agg(*box, F.count("*").alias("n")).first() for d in (todo, right)]
    if not both[0].n or not both[1].n:
        return within(left, right, 1.0).limit(0).withColumn("rank", F.lit(0))
    low, high = ([f(getattr(b, f"{c}_{i}") for b in both) for c in ("x", "y")] for i, f in enumerate((min, max)))
    span = math.hypot(high[0] - low[0], high[1] - low[1]) * 1.01 or 1.0
    wide, tall = (max(getattr(both[1], f"{c}_1") - getattr(both[1], f"{c}_0"), span / 1_000) for c in ("x", "y"))
    span = min(span, most)
    radius = min(span, math.sqrt(wide * tall * k / both[1].n)) if both[1].n > k else span
    if 2 * radius >= most:
        radius = span  # a round costs more than four times the pairs of few
    rank, whole, parts = F.row_number().over(W.partitionBy(left_key).orderBy("distance", right_key)), W.partitionBy(left_key), []
    while True:
        best = within(todo, right, radius).withColumn("rank", rank).where(F.col("rank") <= k)
        if radius >= span:
            return reduce(DataFrame.unionByName, [*parts, best])
        # a hit at the very edge may fall to a cell beyond the neighbours by rounding, so the k-th must be a little nearer
        full = _cut(best.withColumn("__k", F.count_if(F.col("distance") < radius * (1 - 1e-9)).over(whole)).where(F.col("__k") == k).drop("__k"))
        todo = _cut(todo.join(full.where(F.col("rank") == k).select(left_key), left_key, "left_anti"))
        parts.append(full)
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        radius = min(2 * radius, span)


def overlapping(boxes: DataFrame, key: str, margin: float, cell: float) -> DataFrame:
    """Pairs (a, b), a < b, of boxes (min_x, min_y, max_x, max_y) that meet when each grows by ``margin``; once each."""
    low = lambda c: F.floor((F.col(c) - margin) / cell).cast("long")
    high = lambda c: F.floor((F.col(c) + margin) / cell).cast("long")
    spread = boxes.withColumn("__cx", F.explode(F.sequence(low("min_x"), high("max_x")))).withColumn("__cy", F.explode(F.sequence(low("min_y"), high("max_y"))))
    a, b = spread.alias("a"), spread.alias("b")
    both = a.join(b, (F.col("a.__cx") == F.col("b.__cx")) & (F.col("a.__cy") == F.col("b.__cy")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    meet = (F.col("a.min_x") - margin <= F.col("b.max_x") + margin) & (F.col("b.min_x") - margin <= F.col("a.max_x") + margin) & (F.col("a.min_y") - margin <= F.col("b.max_y") + margin) & (F.col("b.min_y") - margin <= F.col("a.max_y") + margin)
    return both.where(meet).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).distinct()


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring (array of struct x, y), by crossings of a ray; holes by a second call."""
    n = F.size(ring)
    edges = F.sequence(F.lit(0), n - 2)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return F.when((a["y"] > y) != (b["y"] > y), x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance from a point to the nearest segment of a closed ring."""

    def to(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        span = dx * dx + dy * dy
        t = F.when(span == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / span)))
        return planar(x, y, a["x"] + t * dx, a["y"] + t * dy)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), to))


def nearest_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radii: tuple[float, ...] = (100, 500, 1_000, 5_000, 10_000)) -> DataFrame:
    """(left_key, right_key, distance, radius): the nearest right point and the first of ``radii`` that holds it; null beyond the last.

    The smallest radius with a hit holds the nearest point, so one join at the largest decides; a point's hits are reduced to one in the map tasks.
    """
    hits = within(left.select(left_key, "x", "y"), right.select(right_key, "x", "y"), float(radii[-1]))
    best = hits.groupBy(left_key).agg(F.min(F.struct("distance", right_key)).alias("b")).select(left_key, F.col(f"b.{right_key}").alias(right_key), "b.distance")
    first = F.array_min(F.filter(F.array(*(F.lit(float(r)) for r in radii)), lambda r: r >= F.col("distance")))
    return left.select(left_key).join(best, left_key, "left").withColumn("radius", first)


def in_square(left: DataFrame, right: DataFrame, left_key: str, right_key: str, half: float) -> DataFrame:
    """(left_key, right_key, distance, rank) of right points in the square of side 2 * ``half`` around each left one, the nearest first."""
    hits = within(left.select(left_key, "x", "y"), right.select(right_key, F.col("x"), F.col("y"), F.col("x").alias("rx"), F.col("y").alias("ry")), half * math.sqrt(2))
    inside = hits.where((F.abs(F.col("rx") - F.col("x")) <= half) & (F.abs(F.col("ry") - F.col("y")) <= half))
    return inside.withColumn("rank", F.row_number().over(W.partitionBy(left_key).orderBy("distance", right_key)).cast("long")).select(left_key, right_key, "distance", "rank")


def placed_in(points: DataFrame, polygons: DataFrame, key: str, code: str, tolerance: float = 100.0, margin: float = 100.0, cell: float = 50_000.0) -> DataFrame:
    """(key, state, found) of points (key, code, x, y) with a declared ``code``, against polygons (code, rings array<array<struct<x,y>>>, min_x, min_y, max_x, max_y).

    INSIDE of the declared polygon; AT_BORDER up to ``tolerance`` from it; NEIGHBOUR inside of one whose box touches the declared one's (the smallest code); else
    OUTSIDE; UNKNOWN without a polygon of that code. Rings alternate inside and outside, so holes and parts need no marks.
    """
    inside = lambda: F.aggregate(F.transform("rings", lambda r: in_ring(F.col("x"), F.col("y"), r)), F.lit(False), lambda s, v: s != v)
    own = points.join(polygons, code, "left").withColumn("in", inside()).withColumn("edge", F.array_min(F.transform("rings", lambda r: ring_distance(F.col("x"), F.col("y"), r))))
    own = own.withColumn("state", F.when(F.col("rings").isNull(), "UNKNOWN").when(F.col("in"), "INSIDE").when(F.col("edge") <= tolerance, "AT_BORDER"))
    rest = own.where("state is null").select(key, code, "x", "y")
    pairs = overlapping(polygons.select(code, "min_x", "min_y", "max_x", "max_y"), code, margin, cell)
    both = pairs.select(F.col("a").alias(code), F.col("b").alias("next")).unionByName(pairs.select(F.col("b").alias(code), F.col("a").alias("next")))
    near = rest.join(both, code).join(polygons.select(F.col(code).alias("next"), "rings", "min_x", "min_y", "max_x", "max_y"), "next")
    near = near.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))).where(inside())
    found = rest.select(key).join(near.groupBy(key).agg(F.min("next").alias("found")), key, "left")
    found = found.select(key, F.when(F.col("found").isNotNull(), "NEIGHBOUR").otherwise("OUTSIDE").alias("state"), "found")
    done = own.where("state is not null").select(key, "state", F.when(F.col("state") != "UNKNOWN", F.col(code)).alias("found"))
    return done.unionByName(found)
