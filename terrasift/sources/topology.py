"""Topologies: shared, quantised arcs to the rings of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARCS = "arcs array<array<array<double>>>, transform struct<scale: array<double>, translate: array<double>>"


def arc_points(arc: Column, scale: Column, translate: Column) -> Column:
    """Points (x, y) of an arc: running sums of its steps, scaled; without a transform the arc's points as they are."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<x: double, y: double>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        x, y = s["x"] + F.get(p, 0), s["y"] + F.get(p, 1)
        at = F.struct((x * F.get(scale, 0) + F.get(translate, 0)).alias("x"), (y * F.get(scale, 1) + F.get(translate, 1)).alias("y"))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(at)).alias("out"))

    raw = F.transform(arc, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return F.when(scale.isNull(), raw).otherwise(F.aggregate(arc, start, step)["out"])


def rings(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(code, name, part, ring, points array<struct x, y>) of the polygons of a layer.

    Arcs become rows and meet the references to them by index. A negative reference (~i) runs the arc backwards, after
    its steps were summed. An arc's first point repeats the last one before it and is left out.
    """
    schema = f"{_ARCS}, objects map<string, struct<geometries: array<struct<type: string, arcs: string, properties: map<string, string>>>>>"
    top = spark.read.schema(schema).option("multiLine", True).json(path)
    arcs = top.select("transform", F.posexplode("arcs").alias("at", "arc")).select("at", arc_points(F.col("arc"), F.col("transform.scale"), F.col("transform.translate")).alias("p"))
    geometry = top.select(F.explode(F.col("objects")[layer]["geometries"]).alias("g")).select("g.type", "g.arcs", "g.properties")
    first = lambda *names: F.coalesce(*(F.col("properties")[n] for n in names))
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("arcs", "array<array<int>>"))).otherwise(F.from_json("arcs", "array<array<array<int>>>"))
    refs = (
        geometry.select(first("cod_ine", "COD_INE", "code").alias("code"), first("nombre", "NOMBRE", "name").alias("name"), F.posexplode(parts).alias("part", "rings")).where("code is not null")
        .select("code", "name", "part", F.posexplode("rings").alias("ring", "refs")).select("code", "name", "part", "ring", F.posexplode("refs").alias("seq", "ref"))
    )
    joined = refs.withColumn("at", F.when(F.col("ref") < 0, -F.col("ref") - 1).otherwise(F.col("ref"))).join(arcs, "at")
    way = F.when(F.col("ref") < 0, F.reverse("p")).otherwise(F.col("p"))
    piece = joined.select("code", "name", "part", "ring", "seq", F.when(F.col("seq") == 0, way).otherwise(F.slice(way, F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("piece"))
    whole = piece.groupBy("code", "name", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("all"))  # one ring's arcs
    return whole.select("code", "name", "part", "ring", F.flatten(F.transform("all", lambda a: a["piece"])).alias("points")).where(F.size("points") >= 3)


def boxes(found: DataFrame) -> DataFrame:
    """(code, min_x, min_y, max_x, max_y) of the rings."""
    ends = {"min_x": (F.array_min, "x"), "min_y": (F.array_min, "y"), "max_x": (F.array_max, "x"), "max_y": (F.array_max, "y")}
    each = found.select("code", *(f(F.transform("points", (lambda k: lambda p: p[k])(c))).alias(n) for n, (f, c) in ends.items()))
    return each.groupBy("code").agg(*((F.min if n.startswith("min") else F.max)(n).alias(n) for n in ends))
