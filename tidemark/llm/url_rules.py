"""Allow and block rules for URLs, found by a sort-merge sweep over canonical keys. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys drawn to place the bounds of the sweep's ranges; they affect balance only, never results.
BOUNDS_SAMPLE = 8192
#: Greater than whatever follows a prefix.
TOP = "\U0010ffff" * 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed and closed by a dot: a host and all its subdomains, and nothing else, begin with its key."""
    return F.concat(F.reverse(host), F.lit("."))


def _range_of(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are <= key, by a binary search in JVM expressions."""
    if not bounds:
        return F.lit(0)
    steps = math.ceil(math.log2(len(bounds) + 1))
    table = F.array(*[F.lit(b) for b in bounds])
    halves = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)])

    def step(at: Column, half: Column) -> Column:
        to = at + half
        return F.when((to <= len(bounds)) & (F.get(table, to - 1) <= key), to).otherwise(at)

    return F.aggregate(halves, F.lit(0), step)


def _bounds(keys: DataFrame) -> list[str]:
    """Evenly spaced keys out of a bounded hash-ordered draw: as many as the session has shuffle partitions, less one."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(r[0] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(BOUNDS_SAMPLE).collect())
    return sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []


def _with_enclosing(rules: DataFrame) -> DataFrame:
    """To each prefix rule, the stack it lies on: itself and all rules whose prefix begins its own, innermost first."""
    own = rules.select("prefix").distinct()
    starts = own.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda i: F.substring(F.col("prefix"), F.lit(1), i))).alias("start"))
    outer = rules.select(F.col("prefix").alias("start"), F.struct(F.length("prefix").alias("n"), "prefix", "payload").alias("rule"))
    return starts.join(outer, "start").groupBy("prefix").agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points (key, ...) with ``active``: the rules (prefix, payload) whose prefix begins the key, innermost first.

    A prefix is the interval [prefix, prefix + TOP). Points and interval starts are sorted
    together in ranges of the key; an interval that goes on beyond a range starts again in the
    next one. In sorted order the last start at or before a point carries the stack of nested
    rules open there; those that have ended are taken off by comparing with the key.
    """
    bounds = _bounds(points)
    extra = [c for c in points.columns if c != "key"]
    stacks = _with_enclosing(rules).select("prefix", "stack", F.explode(F.sequence(_range_of(F.col("prefix"), bounds), _range_of(F.concat("prefix", F.lit(TOP)), bounds))).alias("bucket"))
    low = F.coalesce(F.get(F.array(*[F.lit(b) for b in bounds]), F.col("bucket") - 1), F.lit("")) if bounds else F.lit("")
    starts = stacks.select("bucket", F.greatest("prefix", low).alias("at"), F.lit(0).alias("kind"), "prefix", "stack", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra])
    stack_type = starts.schema["stack"].dataType
    asked = points.select(_range_of(F.col("key"), bounds).alias("bucket"), F.col("key").alias("at"), F.lit(1).alias("kind"), F.lit("").alias("prefix"), F.lit(None).cast(stack_type).alias("stack"), *extra)
    order = W.partitionBy("bucket").orderBy("at", "kind", "prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = starts.unionByName(asked).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("kind = 1")
    return swept.select(F.col("at").alias("key"), *extra, F.filter(F.coalesce("open", F.array().cast(stack_type)), lambda r: F.startswith(F.col("at"), r["prefix"])).alias("active"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: its id, host, path, the rule that decides (host then path; null if none) and the verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts
    with its own; of several the longest text wins, then the longest host, then the lower verdict.
    Rules with a null part are no rules. Distinct (host, path) are swept twice: over host keys for
    the stack of rule hosts, then over host key and path for the rules of each of these hosts. A
    null or odd URL has an empty host and path, no rule and the default verdict.
    """
    given = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    urls = given.where("host <> ''").select("host", "path").distinct().withColumn("key", F.concat(host_key(F.col("host")), "path"))
    hosts = rules.select(host_key(F.col("host")).alias("prefix"), F.col("host").alias("payload")).distinct()
    at_host = sweep(urls, hosts).select("host", "path", F.explode("active").alias("node")).select("host", "path", F.concat("node.prefix", "path").alias("key"))
    texts = rules.select(F.concat(host_key(F.col("host")), "path").alias("prefix"), F.struct(F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict").alias("payload"))
    fits = sweep(at_host, texts).select("host", "path", F.get("active", F.lit(0)).alias("top")).where("top is not null")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("top.payload.rule").alias("n"), F.col("top.payload.host_chars").alias("h"), F.col("top.payload.rule").alias("rule"), F.col("top.payload.verdict").alias("verdict"))).alias("best"))
    return given.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
