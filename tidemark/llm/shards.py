"""Shards of near-equal size by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import written

#: Bundles of small groups for each shard. A group above one bundle's share of all bytes is
#: scheduled by itself; there cannot be more such groups than bundles, so the heap's input is bounded.
BUNDLES = 256
#: Cells for each shard within which slots are numbered.
CELLS = 64


def schedule(jobs: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first, each job to the shard that is least loaded so far; ties by the job's name, then the shard's number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, size, text_crc32, law 'bytes', shard, slot and grown_shard (null: this law has none).

    size is the text's UTF-8 bytes plus 1, 1 for a null text; rows of equal text (nulls are equal
    to each other) stay in one shard. Large groups are jobs of their own, small ones share a
    bundle by their text's digest, and a heap deals the jobs out, longest first. Slots number a
    shard's rows from 0 without gaps: by bundle, then by a cell of the id's digest, then by id;
    repeated rows get slots of their own. An empty table gives an empty result. Extra columns of
    df are not read.
    """
    spark = df.sparkSession
    bundles = shards * BUNDLES
    text = F.col(text_col).cast("string").cast("binary")
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("group"),
    )
    rows = written(rows.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int").cast("string")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    large = [r["group"] for r in groups.where(F.col("size") > total / bundles).select("group").collect()]
    if large:
        named = F.broadcast(spark.createDataFrame([(g,) for g in large], "group string"))
        rows = rows.join(named.withColumn("own", F.lit(True)), "group", "left").withColumn("bundle", F.when(F.col("own"), F.col("group")).otherwise(F.col("bundle")))
    # Each bundle is cut into cells by the id, as many as its rows need, so that a group with a third of all rows is numbered by many tasks.
    sized = rows.groupBy("bundle").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    most = max(1, sum(r["n"] for r in sized) // (shards * CELLS))
    placed = schedule([(r["size"], r["bundle"]) for r in sized], shards)
    plan = spark.createDataFrame([(r["bundle"], placed[r["bundle"]], r["n"] // most + 1) for r in sized], "bundle string, shard int, cells long")
    rows = rows.join(F.broadcast(plan), "bundle").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(8)), F.col("cells")).cast("int"))
    # The number of cells is bounded by that of bundles and CELLS, so their counts fit the driver.
    cells = sorted((r["shard"], r["bundle"], r["cell"], r["n"]) for r in rows.groupBy("shard", "bundle", "cell").agg(F.count(F.lit(1)).alias("n")).collect())
    first, starts = dict.fromkeys(range(shards), 0), []
    for shard, bundle, cell, n in cells:
        starts.append((bundle, cell, first[shard]))
        first[shard] += n
    offsets = spark.createDataFrame(starts, "bundle string, cell int, first long")
    order = W.partitionBy("bundle", "cell").orderBy("id", "text_crc32")
    slot = F.col("first") + F.row_number().over(order) - 1
    return rows.join(F.broadcast(offsets), ["bundle", "cell"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
