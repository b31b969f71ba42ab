"""Learned corrections: a table of rules, the first of which that fits a value transforms it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import prefix_number

#: rank orders the rules; ``field`` is x, y or both; ``kind`` range, regex or digits; ``action`` multiply, add or replace.
SCHEMA = "rank int, id string, field string, kind string, low double, high double, pattern string, digits int, action string, amount double, search string, replacement string"
#: A catalogue beyond this many rules is refused: it travels with every row's task.
MOST = 10_000


def fits(value: Column, raw: Column, rule: Column) -> Column:
    inside = F.coalesce(value >= rule["low"], F.lit(True)) & F.coalesce(value <= rule["high"], F.lit(True))
    long = F.length(F.floor(F.abs(value)).cast("string")) == rule["digits"]
    by_kind = F.when(rule["kind"] == "range", inside).when(rule["kind"] == "regex", F.regexp_like(raw, rule["pattern"])).when(rule["kind"] == "digits", long)
    return value.isNotNull() & F.coalesce(by_kind, F.lit(False))


def transformed(value: Column, raw: Column, rule: Column) -> Column:
    """The corrected value; null if the rule has nothing to do (no amount, an amount of 0, no number left)."""
    amount = F.nullif(rule["amount"], F.lit(0.0))
    swapped = prefix_number(F.regexp_replace(F.regexp_replace(raw, rule["search"], rule["replacement"]), r"[^\d.-]", ""))
    return F.when(rule["action"] == "multiply", value * amount).when(rule["action"] == "add", value + amount).when(rule["action"] == "replace", swapped)


def apply(values: DataFrame, rules: DataFrame, value: str = "value", raw: str = "raw", field: str = "field") -> DataFrame:
    """``values`` with (rule, corrected): the first rule by rank that fits and yields a number; without one the value itself.

    The rules are one row of an array (at most ``MOST`` of them, checked), so no value is shuffled.
    """
    if rules.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} rules")
    all_rules = rules.agg(F.array_sort(F.collect_list(F.struct(*(c.split()[0] for c in SCHEMA.split(", "))))).alias("__rules"))
    joined = values.crossJoin(F.broadcast(all_rules))  # one row
    v, t, f = F.col(value), F.col(raw), F.col(field)
    hit = F.get(F.filter("__rules", lambda r: ((r["field"] == "both") | (r["field"] == f)) & fits(v, t, r) & transformed(v, t, r).isNotNull()), 0)
    out = joined.withColumn("__hit", hit)
    return out.withColumn("rule", F.col("__hit.id")).withColumn("corrected", F.coalesce(transformed(v, t, F.col("__hit")), v)).drop("__hit", "__rules")


def learned(wrong: Column, right: Column) -> Column:
    """Struct (action, amount) that a correction teaches: a factor of 1000 or 10, four millions, or CUSTOM with null."""
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.abs(b)
    kind = F.when(near(wrong * 1000, right), "multiply").when(near(wrong * 10, right), "multiply").when(near(wrong + 4_000_000, right), "add").otherwise("custom")
    amount = F.when(near(wrong * 1000, right), 1000.0).when(near(wrong * 10, right), 10.0).when(near(wrong + 4_000_000, right), 4_000_000.0)
    return F.struct(kind.alias("action"), amount.alias("amount"))


def merged(local: DataFrame, community: DataFrame, key: str = "id") -> DataFrame:
    """The local rules, and those of the community that no local one replaces."""
    return local.unionByName(community.join(local.select(key), key, "left_anti"))


def export(rules: DataFrame, path: str, stable_only: bool = False) -> None:
    """JSON lines; ``stable_only`` keeps rules with ``is_stable``."""
    (rules.where("is_stable") if stable_only else rules).write.mode("overwrite").json(path)


def imported(spark, path: str, present: DataFrame | None = None, schema: str = SCHEMA) -> DataFrame:
    """Rules of an export; those already present stay out of the way."""
    found = spark.read.schema(schema).json(path)
    return found if present is None else merged(present, found.select(*present.columns))
