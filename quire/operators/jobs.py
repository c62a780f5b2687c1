"""Status events of jobs folded into states, counters and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.keys import version_parts


def latest_state(events: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """The last event of each key, and how many there were: key, ``columns``, time, events.

    Of equal times the larger ``tie`` counts.  Hot keys are combined before the
    shuffle.  Events without a key are left out; null times come first.
    """
    last = F.max(F.struct(time, tie, *[c for c in columns if c not in (time, tie)])).alias("l")
    out = events.filter(F.col(key).isNotNull()).groupBy(key).agg(last, F.count(F.lit(1)).alias("events"))
    return out.select(key, *(F.col(f"l.{c}").alias(c) for c in dict.fromkeys([*columns, time])), "events")


def history_events(jobs: DataFrame) -> DataFrame:
    """Jobs' histories as events: job_id, seq (from 0), status, stage, message, timestamp."""
    return jobs.select("job_id", F.posexplode("history").alias("seq", "h")).select("job_id", "seq", "h.status", "h.stage", "h.message", "h.timestamp")


def without_repeats(events: DataFrame, key: str, seq: str, same: list[str]) -> DataFrame:
    """Events that differ from the one before them in ``same``."""
    w = Window.partitionBy(key).orderBy(seq)
    repeated = F.lit(True)
    for c in same:
        repeated = repeated & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return events.withColumn("_repeat", repeated & ~first).filter("not _repeat").drop("_repeat")


def counter_map(df: DataFrame, key: str, counter: str) -> DataFrame:
    """Per key a map of how often each value of ``counter`` occurs (null values don't count)."""
    counts = df.filter(F.col(counter).isNotNull()).groupBy(key, counter).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(counter, "n")))).alias("counters"))


def new_keys(incoming: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key isn't known yet, the first by ``order`` of each key."""
    fresh = incoming.join(known.select(key).distinct(), key, "left_anti")
    cols = [c for c in incoming.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their counts; null isn't a value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def run_report(results: DataFrame, passed: Column, by: list[str] | None = None) -> DataFrame:
    """total, passed, failed, success_rate (4 places) and ok (all passed); a null verdict is a failure."""
    p = F.coalesce(passed, F.lit(False))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"), F.round(F.avg(p.cast("int")), 4).alias("success_rate"), F.coalesce(F.bool_and(p), F.lit(True)).alias("ok")
    )


def latency_quantiles(events: DataFrame, time: str, stage: str, value: str, window: str = "5 minutes", accuracy: int = 10_000) -> DataFrame:
    """p50 and p95 by stage and tumbling window, with the events counted; null values are left out.

    Quantiles come from mergeable sketches, exact for groups of up to ``accuracy`` values.
    """
    rows = events.filter(F.col(value).isNotNull()).groupBy(F.window(time, window).alias("w"), stage)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, 0.5, accuracy).alias("p50"), F.percentile_approx(value, 0.95, accuracy).alias("p95"))
    return out.select(F.col("w.start").alias("window_start"), stage, "n", "p50", "p95")


def status_counts(events: DataFrame, time: str, status: str, window: str = "1 minute") -> DataFrame:
    """Events by status and tumbling window."""
    return events.groupBy(F.window(time, window).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), status, "n")


def rate_windows(events: DataFrame, time: str, good: Column, bad: Column, window: str = "5 minutes", least: float = 0.995) -> DataFrame:
    """Share of good among good and bad events by window, and whether it falls below ``least``.

    Both series come from one pass with conditional counts, so no join.  A
    window without either has a null share and no breach.
    """
    out = events.groupBy(F.window(time, window).alias("w")).agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    share = F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad")))
    return out.select(F.col("w.start").alias("window_start"), "good", "bad", F.round(share, 6).alias("share"), F.coalesce(share < least, F.lit(False)).alias("breach"))


def absences(events: DataFrame, key: str, time: str, longer_than: str = "15 minutes") -> DataFrame:
    """Gaps between a key's consecutive events that are longer than the interval: key, gap_start, gap_end."""
    w = Window.partitionBy(key).orderBy(time)
    gaps = events.select(key, F.col(time).alias("gap_start"), F.lead(time).over(w).alias("gap_end"))
    return gaps.filter(F.col("gap_end") > F.col("gap_start") + F.expr(f"interval {longer_than}"))


def next_versions(files: DataFrame, name: str, extension: str) -> DataFrame:
    """The next free version by root name and extension (``name-vN``; no suffix is version 1)."""
    parts = files.select(version_parts(F.col(name)).alias("v"), extension)
    return parts.groupBy(F.col("v.root").alias("root"), extension).agg((F.max("v.version") + 1).alias("next_version"))


def expired(artifacts: DataFrame, retain: str, now: Column) -> DataFrame:
    """Artifacts whose time is up; missing and unreadable times don't expire."""
    return artifacts.filter(F.try_to_timestamp(F.col(retain)) <= now)


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def chunk_flags(chunks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``chunks`` with chunk_index (from 0), total_chunks and is_last_chunk by key."""
    w = Window.partitionBy(*key)
    o = w.orderBy(*order)
    return chunks.withColumns({"chunk_index": F.row_number().over(o) - 1, "total_chunks": F.count(F.lit(1)).over(w), "is_last_chunk": F.row_number().over(o) == F.count(F.lit(1)).over(w)})
