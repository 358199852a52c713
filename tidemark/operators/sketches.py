"""Quantiles and distinct counts from sketches: one row of each key and day is stored, and rows are merged for any longer time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of quantile sketches and bits of distinct counts' registers.
K, LG = 400, 12
#: What they may be off: a quantile's rank as a share of all rows (the single-sided 99 % bound of K is below 0.7 %), and a count by three standard deviations.
RANK_ERROR, COUNT_ERROR = 0.015, 3 * 1.04 / 2 ** (LG / 2)


def daily(df: DataFrame, ts: str, keys: list[str], value: Column, member: Column) -> DataFrame:
    """Of each day and keys: rows, a sketch of a value's distribution and one of the distinct members. Null values and members aren't in them."""
    day = F.to_date(F.date_trunc("DAY", F.col(ts))).alias("day")
    return df.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value.cast("double"), K).alias("values"), F.hll_sketch_agg(member, LG).alias("members"))


def merged(stored: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Stored rows merged by keys: rows, days, the quantiles (an array) and the distinct members, both estimates."""
    found = stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.count_distinct("day").alias("days"), F.kll_merge_agg_double("values", K).alias("values"), F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"))
    some = F.kll_sketch_get_n_double("values") > 0
    return found.select(*keys, "n", "days", F.when(some, F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(float(q)) for q in quantiles]))).alias("quantiles"), "members")


def rank_errors(df: DataFrame, found: DataFrame, keys: list[str], value: Column, quantiles: list[float]) -> DataFrame:
    """found with ``rank_error``: of its quantiles the largest distance, as a share of the rows, of the ranks they have in df from those they should have.

    One pass over df with two counters a quantile; a value that many rows have takes up all their ranks.
    """
    joined = df.withColumn("_v", value.cast("double")).where("_v is not null").join(found.select(*keys, "quantiles"), keys)
    n = F.count(F.lit(1))
    errors = []
    for i, q in enumerate(quantiles):
        below, upto = (F.count_if(F.col("_v") < F.col("quantiles")[i]) / n, F.count_if(F.col("_v") <= F.col("quantiles")[i]) / n)
        errors.append(F.greatest(below - q, q - upto, F.lit(0.0)))
    return found.join(joined.groupBy(*keys).agg(F.greatest(*errors, F.lit(0.0)).alias("rank_error")), keys, "left")
