"""Reports over logs and results: what was refused, what was learned, what a run gave, what texts need repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Motives for which an answer is refused.
MOTIVES = ["fuera_andalucia", "provincia_incorrecta", "municipio_incorrecto", "sin_codigo_ine", "timeout", "error_red", "formato_invalido"]


def by_motive(log: DataFrame, motive: str, motives: list[str]) -> DataFrame:
    """(motive, n) of every known motive, also of such that never came up; others aren't counted."""
    every = log.sparkSession.createDataFrame([(m,) for m in motives], "motive string")
    counts = log.groupBy(F.col(motive).alias("motive")).agg(F.count("*").alias("n"))
    return every.join(counts, "motive", "left").select("motive", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_refused(log: DataFrame, place: str, limit: int = 5) -> DataFrame:
    """(place, n, rank): the places with the most entries; ties by name."""
    counts = log.groupBy(F.col(place).alias("place")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "place").limit(limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "place")).cast("long"))  # at most `limit` rows


def recent_alerts(log: DataFrame, ts: str, now, least: int) -> DataFrame:
    """One row (last_hour, today, alert) as of ``now``: entries of the last hour and of the day, and whether the hour has ``least``."""
    t, at = F.col(ts), F.lit(now).cast("timestamp")
    hour = F.count_if((t >= at - F.expr("interval 1 hour")) & (t <= at))
    return log.agg(hour.alias("last_hour"), F.count_if((F.to_date(t) == F.to_date(at)) & (t <= at)).alias("today"), (hour >= least).alias("alert"))


def as_lines(log: DataFrame, columns: list[str], quoted: list[str]) -> Column:
    """A log's row as a line of text; the ``quoted`` columns always in quotes."""
    one = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) if c in quoted else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(",", *(one(c) for c in columns))


def learning_totals(events: DataFrame, rule: str, success: Column, place: str) -> DataFrame:
    """One row (rules, uses, successes, rate, stable, places): stable rules have ten uses and 95 % successes at least."""
    per = events.groupBy(rule).agg(F.count("*").alias("uses"), F.count_if(success).alias("good"))
    totals = per.agg(F.count("*").alias("rules"), F.sum("uses").alias("uses"), F.sum("good").alias("successes"), F.count_if((F.col("uses") >= 10) & (F.col("good") / F.col("uses") >= 0.95)).alias("stable"))
    places = events.agg(F.countDistinct(place).alias("places"))
    return totals.crossJoin(places).select("rules", "uses", "successes", (F.col("successes") / F.col("uses")).alias("rate"), "stable", "places")  # one row each


def run_counts(results: DataFrame, source: str) -> DataFrame:
    """(source, n, share) of a run's results by the source that placed them; null for what none placed."""
    n = results.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # as many rows as there are sources


def encoding_facts(rows: DataFrame, text: str) -> DataFrame:
    """One row (n, ascii, suspicious): texts of ASCII alone, and those with signs that UTF-8 leaves when it is read as Latin-1."""
    t = F.col(text)
    return rows.agg(F.count("*").alias("n"), F.count_if(t.rlike(r"^[\x00-\x7F]*$")).alias("ascii"), F.count_if(t.rlike("[ÃÂ][\u0080-¿]|�")).alias("suspicious"))


def cache_hits(requests: DataFrame, key: str, ts: str, order: str, ttl: str) -> DataFrame:
    """(key, requests, hits): what a cache that keeps an answer for ``ttl`` after it was fetched would have answered.

    A hit doesn't renew an entry, so an entry's age counts from the miss that fetched it; that needs the order of a key's requests, one sorted group a key.
    """
    per = requests.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ts, order))), lambda r: r[ts]).alias("t"))
    span = F.expr(f"cast(interval {ttl} as interval day to second)")

    def step(state: Column, t: Column) -> Column:
        live = state["until"].isNotNull() & (t < state["until"])
        return F.struct(F.when(live, state["until"]).otherwise(t + span).alias("until"), (state["hits"] + F.when(live, 1).otherwise(0)).alias("hits"))

    start = F.struct(F.lit(None).cast("timestamp").alias("until"), F.lit(0).cast("long").alias("hits"))
    done = per.withColumn("t", F.transform("t", lambda x: x.cast("timestamp"))).withColumn("s", F.aggregate("t", start, lambda s, t: step(s, t).cast("struct<until:timestamp,hits:bigint>")))
    return done.select(key, F.size("t").cast("long").alias("requests"), F.col("s.hits").alias("hits"))


def singletons(wanted: DataFrame, features: DataFrame, on: list[str], key: str, feature_key: str, limit: int = 10) -> DataFrame:
    """(key, n, verdict, confidence, candidates) of requests: SINGLE with its feature at a confidence of 95, MANY with the first ``limit`` candidates, NONE."""
    counts = features.groupBy(*on).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(feature_key)), 1, limit).alias("candidates"))
    out = wanted.join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    verdict = F.when(F.col("n") == 1, "SINGLE").when(F.col("n") > 1, "MANY").otherwise("NONE")
    return out.select(key, "n", verdict.alias("verdict"), F.when(F.col("n") == 1, 95).alias("confidence"), F.coalesce("candidates", F.array().cast(features.select(F.collect_list(feature_key)).schema[0].dataType)).alias("candidates"))
