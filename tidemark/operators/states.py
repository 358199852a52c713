"""Checks of runs that go through phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What may follow what. Rollback and converged are final.
STEPS = [("plan", "guard"), ("guard", "act"), ("act", "observe"), ("observe", "plan"), ("observe", "converged"), ("guard", "rollback"), ("act", "rollback"), ("observe", "rollback")]
MOST_TURNS = 5
FINAL = ("converged", "rollback")


def transitions(steps: DataFrame) -> DataFrame:
    """Each step with the one before it in its run."""
    return steps.withColumn("before", F.lag("state").over(W.partitionBy("run_id").orderBy("seq")))


def illegal(steps: DataFrame) -> DataFrame:
    allowed = steps.sparkSession.createDataFrame(STEPS, "before string, state string")
    return transitions(steps).where("before is not null").join(F.broadcast(allowed), ["before", "state"], "left_anti")


def oscillating(steps: DataFrame) -> DataFrame:
    """Steps whose result is that of the step before last, with another one between."""
    w = W.partitionBy("run_id").orderBy("seq")
    return steps.withColumn("oscillates", F.coalesce((F.lag("result_hash", 2).over(w) == F.col("result_hash")) & (F.lag("result_hash", 1).over(w) != F.col("result_hash")), F.lit(False)))


def run_states(steps: DataFrame) -> DataFrame:
    """Of each run up to its first fault or final state: turns, that state, and the verdict: illegal, oscillating, too long, converged or
    rollback; a run without any is running. What comes after a final state or a fault doesn't count, as in the stream."""
    w = W.partitionBy("run_id").orderBy("seq")
    allowed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in STEPS])
    before, one, two = F.lag("state").over(w), F.lag("result_hash").over(w), F.lag("result_hash", 2).over(w)
    seen = steps.select("run_id", "seq", "state", "result_hash", before.alias("before"), one.alias("one"), two.alias("two"), F.count_if(F.col("state") == "plan").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("turns"))
    legal = F.array_contains(allowed, F.struct(F.col("before").alias("a"), F.col("state").alias("b")))
    event = (
        F.when(F.col("before").isNotNull() & ~legal, "illegal")
        .when((F.col("two") == F.col("result_hash")) & (F.col("one") != F.col("result_hash")), "oscillating")
        .when(F.col("turns") > MOST_TURNS, "too long")
        .when(F.col("state").isin(*FINAL), F.col("state"))
    )
    judged = seen.withColumn("event", event)
    first = F.min(F.when(F.col("event").isNotNull(), F.struct("seq", "event", "turns", "state")))
    last = F.max(F.struct("seq", "turns", "state"))
    found = judged.groupBy("run_id").agg(first.alias("first"), last.alias("last"))
    return found.select("run_id", F.coalesce("first.turns", "last.turns").alias("turns"), F.coalesce("first.state", "last.state").alias("last_state"), F.coalesce("first.event", F.lit("running")).alias("verdict"))
