"""Usage, spending and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import budget_band, cost, days_left, exact_sum, monthly


def daily(df: DataFrame, ts: str, value: Column, key: str | None = None) -> DataFrame:
    """Rows and sum of a value by day, and by key if there is one."""
    keys = [F.to_date(F.date_trunc("DAY", F.col(ts))).alias("day"), *([F.col(key)] if key else [])]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def observed_and_estimated(ledger: DataFrame, by: str = "model") -> DataFrame:
    """Tokens by kind, side by side and never added up."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0))
    return ledger.groupBy(by).agg(of("observed").alias("observed_tokens"), of("estimated").alias("estimated_tokens"))


def priced(ledger: DataFrame, prices: DataFrame, how: str = "left") -> DataFrame:
    """Of each request the cost without and with cached reads; where the model has no price null, or no row if ``how`` is "inner"."""
    joined = ledger.join(prices, "model", how)
    full = cost(F.col("input_tokens"), F.col("full_per_m"))
    cached = cost(F.col("input_tokens") - F.col("cached_tokens"), F.col("full_per_m")) + cost(F.col("cached_tokens"), F.col("cached_per_m"))
    return joined.select(*ledger.columns, full.alias("cost_full"), cached.alias("cost_cached"), (full - cached).alias("cost_avoided"))


def totals(ledger: DataFrame, spent: Column, saved: Column) -> DataFrame:
    """Spent, saved, and saved as a share of both in percent."""
    sums = ledger.agg(F.coalesce(F.sum(spent), F.lit(0)).alias("spent"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved"))
    return sums.withColumn("saved_pct", F.round(100.0 * F.col("saved") / F.nullif(F.col("spent") + F.col("saved"), F.lit(0)), 1))


def hit_rate(ledger: DataFrame, by: str) -> DataFrame:
    return ledger.groupBy(by).agg((F.sum("cached_tokens") / F.nullif(F.sum("input_tokens"), F.lit(0))).alias("hit_rate"))


def per_task(turns: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tokens and seconds of each task (task_id, user_id, start, stop): turns of its user in [start, stop)."""
    inside = (turns["user_id"] == tasks["user_id"]) & (turns["ts"] >= tasks["start"]) & (turns["ts"] < tasks["stop"])
    joined = tasks.join(turns, inside, "left")
    return joined.groupBy("task_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"))


def running(df: DataFrame, key: str, order: list[str | Column], value: str, limit: float | None = None) -> DataFrame:
    """Running sum of each key in a total order, exact for values of up to ten decimals, and whether it is over a limit: a sum that meets the limit is not."""
    total = exact_sum(F.col(value), W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = df.withColumn("running", total)
    return out if limit is None else out.withColumn("over", F.col("running") > limit)


def budget(df: DataFrame, key: str, value: str, ts: str, amount: float) -> DataFrame:
    """Speed of spending by day between a key's first and last row, projected month, days left and their band."""
    days = F.greatest(F.datediff(F.max(ts), F.min(ts)) + 1, F.lit(1))
    speed = df.groupBy(key).agg(F.round(F.sum(value) / days, 6).alias("per_day"))
    return speed.select(key, "per_day", monthly(F.col("per_day")).alias("month"), days_left(F.lit(amount), F.col("per_day")).alias("days_left")).withColumn("band", budget_band(F.col("days_left")))


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """A value before and after by key, with the change in percent and its class; a key may lack on either side."""
    a = before.groupBy(key).agg(F.sum(value).alias("before"))
    b = after.groupBy(key).agg(F.sum(value).alias("after"))
    both = a.join(b, key, "full").select(key, F.round(F.coalesce("before", F.lit(0.0)), 4).alias("before"), F.round(F.coalesce("after", F.lit(0.0)), 4).alias("after"))
    change = F.round(100.0 * (F.col("after") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)), 1)
    kind = F.when(F.col("change_pct") >= 10, "more").when(F.col("change_pct") <= -10, "less").when(F.col("change_pct").isNotNull(), "steady").otherwise("new")
    return both.withColumn("change_pct", change).withColumn("kind", kind)


def shares(df: DataFrame, sector: str, tile: str, value: Column) -> DataFrame:
    """Tiles and their sectors, each with its share of the level above in percent: treemap areas by rollup."""
    rolled = df.rollup(sector, tile).agg(F.sum(value).alias("total"), F.grouping_id().cast("bigint").alias("level"))
    whole = df.agg(F.sum(value).alias("_whole"))  # one row
    of_sector = F.sum(F.when(F.col("level") == 0, F.col("total"))).over(W.partitionBy(sector, "level"))
    above = F.when(F.col("level") == 0, of_sector).otherwise(F.col("_whole"))
    rolled = rolled.join(F.broadcast(whole))
    return rolled.withColumn("share_pct", F.round(100.0 * F.col("total") / F.nullif(above, F.lit(0)), 2)).drop("_whole")


def stage_delta(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """A value's change from the stage before; null at a key's first stage."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(*order)))


def tiles(ledger: DataFrame) -> DataFrame:
    """One row of key figures: requests, users, tokens, the share of cached tokens, and estimated requests."""
    rate = F.sum("cached_tokens") / F.nullif(F.sum("input_tokens"), F.lit(0))
    return ledger.agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("users"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(rate, 6).alias("hit_rate"), F.count_if(F.col("kind") == "estimated").alias("estimated"))


def carbon(tokens: Column, grams_per_million: float) -> Column:
    """Grams for tokens by a given factor."""
    return F.round(tokens * grams_per_million / 1_000_000, 6)


def milestone(total: Column, steps: list[tuple[float, str]]) -> Column:
    """The name of the highest step that a total has reached; steps rise."""
    reached = F.lit(None).cast("string")
    for least, name in steps:
        reached = F.when(total >= least, name).otherwise(reached)
    return reached


def repeats(df: DataFrame, text: str) -> DataFrame:
    """Digests of texts that occur more than once: how often, and the characters that repeats cost."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) - 1) * F.max(F.length(text))).cast("bigint").alias("repeated_chars")).where("n > 1")


def trend(df: DataFrame, key: str, x: str, y: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y.cast("double"), F.col(x).cast("double")), 6).alias("slope"))
