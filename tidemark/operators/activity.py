"""Activity over time: gaps, sessions, nearest events, recovery and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import quantiles


def gaps(df: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Seconds since the key's row before; null for its first one."""
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts, order))
    return df.withColumn("gap", F.timestamp_diff("SECOND", before, F.col(ts)))


def active_time(df: DataFrame, idle: int, key: str = "user_id", by: str | None = None) -> DataFrame:
    """Seconds of each key (and of another column's value) without gaps longer than ``idle``."""
    keys = [key, *([by] if by else [])]
    return gaps(df, key).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("gap") <= idle, F.col("gap"))), F.lit(0)).alias("active_seconds"), F.count(F.lit(1)).alias("n_events"))


def sessions(df: DataFrame, idle: int, least: int = 0, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of a key's rows with gaps of at most ``idle`` seconds: first, last, rows, seconds; those of ``least`` seconds or more."""
    marked = gaps(df, key, ts).withColumn("_new", F.when(F.col("gap").isNull() | (F.col("gap") > idle), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(W.partitionBy(key).orderBy(ts, "event_id")))
    found = numbered.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
    return found.withColumn("seconds", F.timestamp_diff("SECOND", "first_ts", "last_ts")).where(F.col("seconds") >= least)


def next_event(df: DataFrame, start: Column, goal: Column, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Forward as-of join of a key's start rows with its next goal row: one window in place of a join of all pairs."""
    after = W.partitionBy(key).orderBy(ts, order).rowsBetween(1, W.unboundedFollowing)
    return df.withColumn("next_ts", F.first(F.when(goal, F.col(ts)), ignorenulls=True).over(after)).where(start)


def last_event(df: DataFrame, start: Column, goal: Column, key: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Backward as-of join: a key's start rows with its last goal row before."""
    before = W.partitionBy(key).orderBy(ts, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("last_ts", F.last(F.when(goal, F.col(ts)), ignorenulls=True).over(before)).where(start)


def recovery(df: DataFrame, failed: Column, recovered: Column, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Of each key: failures, those with a later recovery, and the mean seconds until it."""
    found = next_event(df, failed, recovered, key, ts).withColumn("_s", F.timestamp_diff("SECOND", F.col(ts), F.col("next_ts")))
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.count("_s").alias("recovered"), F.round(F.avg("_s"), 6).alias("mean_seconds"))


def friction(df: DataFrame, prompt: Column, failed: Column, within: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Prompts of a key, and whether a failure soon after made them a detour."""
    found = next_event(df, prompt, failed, key, ts)
    soon = F.timestamp_diff("SECOND", F.col(ts), F.col("next_ts")) <= within
    return found.withColumn("label", F.when(soon, "detour").otherwise("accelerated"))


def flow(df: DataFrame, idle: int, least: int, key: str = "user_id") -> DataFrame:
    """Focused share of a key's active time: seconds of sessions of ``least`` seconds or more over those of all sessions."""
    found = sessions(df, idle, 0, key)
    focused = F.sum(F.when(F.col("seconds") >= least, F.col("seconds")).otherwise(0))
    return found.groupBy(key).agg(F.coalesce(focused / F.nullif(F.sum("seconds"), F.lit(0)), F.lit(0.0)).alias("flow"))


def rates(df: DataFrame, cohort: Column, failed: Column) -> DataFrame:
    """Of each cohort: rows, failure rate and pass rate."""
    return df.groupBy(cohort.alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(failed, 1.0).otherwise(0.0)), 6).alias("failure_rate"),
        F.round(F.count_if(~failed) / F.count(F.lit(1)), 6).alias("pass_rate"),
    )


def median_delta(df: DataFrame, cohort: Column, value: Column) -> DataFrame:
    """Medians of two cohorts (true and false) and their difference; exact, from counts of values in ranges."""
    found = quantiles(df.select(cohort.alias("_in"), value.alias("_value")).where("_in is not null"), ["_in"], F.col("_value"), 0.5, "m")
    both = found.agg(F.max(F.when(F.col("_in"), F.col("m"))).alias("median_in"), F.max(F.when(~F.col("_in"), F.col("m"))).alias("median_out"))
    return both.withColumn("delta", F.col("median_in") - F.col("median_out"))


def by_origin(df: DataFrame, key: str, origin: str, lines: str) -> DataFrame:
    """Lines of each key by origin, human and ai side by side."""
    return df.groupBy(key).pivot(origin, ["human", "ai"]).agg(F.sum(lines)).fillna(0, ["human", "ai"])
