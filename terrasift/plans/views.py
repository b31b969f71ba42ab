"""Places, features, dirty strings and requests, derived from the star schema by integer arithmetic.

Each view has a text that both engines read, so that a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The eleven kinds of features.
KINDS = ["SANITARIO", "EDUCATIVO", "CULTURAL", "POLICIAL", "BOMBEROS", "DEPORTIVO", "MUNICIPAL", "ENERGIA", "HIDRAULICO", "INDUSTRIAL", "OTROS"]
_KIND = "case {k} % 11 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(KINDS)) + " end"

POINTS = "select c_custkey as id, c_nationkey as mun, c_name as name, cast(100000 + (c_custkey * 7919) % 520000 as double) as x, cast(3980000 + (c_custkey * 104729) % 310000 as double) as y from customer"
FEATURES = f"select s_suppkey as fid, s_nationkey as mun, s_name as fname, {_KIND.format(k='s_suppkey')} as kind, cast(100000 + (s_suppkey * 7919 * 31) % 520000 as double) as x, cast(3980000 + (s_suppkey * 104729 * 17) % 310000 as double) as y from supplier"
DIRTY = f"""
select id, mun, cast(x as bigint) as true_x, cast(y as bigint) as true_y,
  case id % 10 when 5 then 'Indicar' when 7 then cast(cast(y as bigint) as string) else cast(cast(x as bigint) as string) end as raw_x,
  case id % 10
    when 0 then s
    when 1 then substr(s, 1, 1) || '.' || substr(s, 2, 3) || '.' || substr(s, 5, 3) || ',' || d
    when 2 then s || ',' || d
    when 3 then substr(s, 1, 1) || '.' || substr(s, 2, 3) || '.' || substr(s, 5, 3)
    when 4 then substr(s, 1, 1) || ' ' || substr(s, 2, 3) || ' ' || substr(s, 5, 3) || '´´' || d
    when 5 then 'N/A'
    when 6 then substr(s, 3, 5)
    when 7 then cast(cast(x as bigint) as string)
    when 8 then substr(s, 1, 1) || ' ' || substr(s, 2, 3) || ' ' || substr(s, 5, 3)
    else s || '.' || d end as raw_y
from (select id, mun, x, y, cast(cast(y as bigint) as string) as s, cast(10 + id % 90 as string) as d from ({POINTS}) p0) p1"""
SOURCES = "select l_orderkey as qid, l_linenumber as source, cast(100000 + (l_orderkey * 7919) % 520000 + l_partkey % 700 as double) as x, cast(3980000 + (l_orderkey * 104729) % 310000 + l_suppkey % 300 as double) as y, cast(50 + l_quantity as double) as confidence, cast(1 + l_linenumber % 3 as double) / 3 as authority from lineitem"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", "from {t}"), t=table(spark, sf_dir, name))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, POINTS, "customer")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FEATURES, "supplier")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, DIRTY, "customer")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SOURCES, "lineitem")
