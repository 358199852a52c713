"""Places and running values in one order over all rows, without a task that sees them all.

Rows are dealt out by ranges of the order and sorted there; each partition's total goes to the driver, one row for each
partition, and what comes before a partition is added to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.stages import kept

#: monotonically_increasing_id has a row's number within its partition in so many low bits.
ROW_BITS = 33


def in_ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df with ``_part``, the number of its range, and ``_at``, the row's number in it from 0. The order must be total; it is fixed by writing the rows."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))))


def _with_before(ranged: DataFrame, total: Column, zero, add) -> DataFrame:
    """ranged with ``_before``: what the totals of all partitions before a row's own come to."""
    totals = ranged.groupBy("_part").agg(total.alias("t")).orderBy("_part").collect()  # as many rows as partitions
    rows, before = [], zero
    for part, t in totals:
        rows.append((part, before))
        before = add(before, t)
    kind = ranged.groupBy("_part").agg(total.alias("t")).schema["t"].dataType.simpleString()
    befores = ranged.sparkSession.createDataFrame(rows, f"_part int, _before {kind}")
    return ranged.join(F.broadcast(befores), "_part")


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in a total order."""
    found = _with_before(in_ranges(df, order), F.count(F.lit(1)), 0, lambda a, b: a + b)
    return found.select(*df.columns, (F.col("_before") + F.col("_at") + 1).alias(name))


def summed(df: DataFrame, order: list[Column | str], value: str, name: str = "running") -> DataFrame:
    """df with the sum of a value up to and including each row, in a total order; nulls add nothing."""
    found = _with_before(in_ranges(df, order), F.coalesce(F.sum(value), F.lit(0)), 0, lambda a, b: a + b)
    own = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.select(*df.columns, (F.col("_before") + F.coalesce(own, F.lit(0))).alias(name))


def least_before(df: DataFrame, order: list[Column | str], value: str, name: str = "least_before") -> DataFrame:
    """df with the least value of all rows before each, in a total order; null if there is none."""
    found = _with_before(in_ranges(df, order), F.min(value), None, lambda a, b: b if a is None else a if b is None else min(a, b))
    own = F.min(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    return found.select(*df.columns, F.least(own, "_before").alias(name))


def quantiles(df: DataFrame, keys: list[str], value: Column, quantile: float, name: str = "quantile") -> DataFrame:
    """The exact quantile of a value in each group, between its two nearest rows as ``percentile`` does; nulls don't count, groups without values are left out.

    Equal values are counted first, so no value is many rows; counts are added up over ranges of (keys, value), and the rows at
    the wanted places are picked. No group's values meet in one task.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = summed(counts, [*[F.asc(k) for k in keys], F.asc("_v")], "_c", "_upto")
    groups = upto.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_start")) if keys else upto.agg(F.sum("_c").alias("_n"), F.lit(0).alias("_start"))
    groups = groups.withColumn("_at", (F.col("_n") - 1) * quantile).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start", "_at")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed_ = upto.join(groups if keys else F.broadcast(groups), same)
    covers = lambda at: (F.col("_upto") - F.col("_c") - F.col("_start") <= at) & (at < F.col("_upto") - F.col("_start"))
    low, high = F.floor("_at"), F.ceil("_at")
    near = placed_.where(covers(low) | covers(high)).groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first(F.col("_at") - low).alias("_share"))
    return near.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias(name))
