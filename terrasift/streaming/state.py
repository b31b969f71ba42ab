"""State over event streams: caches that expire, counters of rules, alerts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(events: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """A cache that expires: the first event of each key; repeats within ``ttl`` are dropped and state is freed after it."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def answered(requests: DataFrame, key: str, ts: str, answer: str, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, ts, answer, hit) of a stream of requests with the answers that a source would give: a cache of a state a key.

    A request within ``ttl_seconds`` of the miss that fetched its key's answer gets that answer (hit), another one fetches its own; a hit doesn't renew an entry. An
    entry is dropped when event time has passed its end, so the state holds what is live and no more; a null answer is kept too.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def step(keys, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        until, kept = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        out = []
        for at, given in zip(rows[ts], rows[answer], strict=True):
            now = at.timestamp()
            if hit := until is not None and now < until:
                given = kept
            else:
                until, kept = now + ttl_seconds, given
            out.append((keys[0], at, given, hit))
        state.update((until, kept))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, answer, "hit"])

    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    schema = f"{key} {kind[key]}, {ts} timestamp, {answer} {kind[answer]}, hit boolean"
    return timed.groupBy(key).applyInPandasWithState(step, schema, f"until double, kept {kind[answer]}", "append", GroupStateTimeout.EventTimeTimeout)


def rule_counters(events: DataFrame, rule: str, success: str) -> DataFrame:
    """(rule, uses, successes, stable): stable from ten uses and 95 % successes on; for update mode."""
    ok = F.count_if(success)
    return events.groupBy(rule).agg(F.count("*").alias("uses"), ok.alias("successes")).withColumn("stable", (F.col("uses") >= 10) & (F.col("successes") / F.col("uses") >= 0.95))


def alerts(events: DataFrame, ts: str, kind: str, window: str, slide: str, late: str, least: int) -> DataFrame:
    """Windows with at least ``least`` events of a kind; events later than ``late`` are ignored."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def unexpired(rows: DataFrame, expires: str, now) -> DataFrame:
    """Batch purge: rows that are still valid at ``now``."""
    return rows.where(F.col(expires) >= F.lit(now))
