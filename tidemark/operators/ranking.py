"""Ranking, searching and bounding of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import saved_share
from tidemark.functions.text import has_text, token_estimate
from tidemark.operators.order import least_before, placed


def file_stats(docs: DataFrame, key: str = "source") -> DataFrame:
    """Of each file key: tokens of its texts, tokens of each text's distinct lines, what that saves and the share in percent.

    Lines are compared within a document, so the row is self-contained and only the key is shuffled.
    """
    distinct = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    per_doc = docs.select(F.col(key).alias("path"), token_estimate(F.col("text")).alias("raw"), token_estimate(distinct).alias("kept"))
    sums = per_doc.groupBy("path").agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    return sums.withColumn("savings", F.col("raw") - F.col("kept")).withColumn("pct", saved_share(F.col("savings"), F.col("raw")))


def rank_files(stats: DataFrame, by: str = "savings", query: str = "") -> DataFrame:
    """Files whose path holds the query, best first; ties and unknown keys go by path. The first row has place 1."""
    order = [F.desc(by)] if by in ("savings", "raw", "pct") else []
    found = stats.where(has_text(F.col("path"), query))
    return placed(found, [*order, F.asc("path")])


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which any of the columns holds the query."""
    fits = F.lit(False)
    for c in columns:
        fits = fits | has_text(F.col(c), query)
    return df.where(fits)


def page(df: DataFrame, order: list[str | Column], size: int, number: int) -> DataFrame:
    return df.orderBy(*order).offset(size * number).limit(size)


def keep_last(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key, in a given total order."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in one of x and y without being worse in the other; both are to be small.

    Points are first reduced to the least y of each x; a running minimum over x then needs one
    ordered pass over distinct x, in ranges, in place of a comparison of all pairs.
    """
    best = df.groupBy(x).agg(F.min(y).alias("_best")).where(F.col(x).isNotNull() & F.col("_best").isNotNull())
    front = least_before(best, [F.asc(x)], "_best", "_before").where(F.col("_before").isNull() | (F.col("_best") < F.col("_before"))).select(F.col(x).alias("_x"), "_best")
    return df.join(front, (df[x] == F.col("_x")) & (df[y] == F.col("_best")), "left_semi")
