"""Streaming twins of the batch operators: event time with watermarks, rows later than that are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.states import FINAL, MOST_TURNS, STEPS

#: How late a row may come.
LATE = "10 minutes"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less times are taken as UTC, the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counters(ticks: DataFrame) -> DataFrame:
    """Ticks so far and their sum; to be written in complete mode."""
    return ticks.groupBy().agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("total"))


def buckets(events: DataFrame, width: str = "2 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events of each user in tumbling (or sliding) windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events, late).groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("window_start"), "n")


def live_sessions(events: DataFrame, idle_seconds: int = 120, late: str = LATE) -> DataFrame:
    """Sessions that end after a pause: first, last and number of events."""
    found = _timed(events, late).groupBy("user_id", F.session_window("ts", f"{idle_seconds} seconds").alias("w"))
    return found.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events")).drop("w")


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event_id once, though it may be sent again within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def priced_live(events: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Stream-static join."""
    return events.join(prices, key, "left")


def recovered_live(failures: DataFrame, successes: DataFrame, within: str = "1 hour", late: str = LATE, how: str = "inner") -> DataFrame:
    """Stream-stream join: successes of a user within a time after a failure. ``how`` "left" also gives, with nulls, failures that had none, once the watermark is past their time.

    Both sides' state ends with the watermark, as the join has a bound in time.
    """
    f = _timed(failures, late).select(F.col("event_id").alias("failed_id"), F.col("user_id").alias("failed_user"), F.col("ts").alias("failed_ts"))
    s = _timed(successes, late)
    return f.join(s, (F.col("failed_user") == F.col("user_id")) & (F.col("ts") > F.col("failed_ts")) & (F.col("ts") <= F.col("failed_ts") + F.expr(f"interval {within}")), how)


def put_batch(path: str):
    """A writer of micro-batches that may be called again with the same batch: each goes to a folder of its own number, as a whole or not at all.

    Spark commits a batch only after it is written, so one may come twice; then it replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def start_once(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream to a table so that each row is in it once, over any failures and restarts from the checkpoint."""
    writer = df.writeStream.foreachBatch(put_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest_first(spark: SparkSession, path: str, order: str) -> DataFrame:
    """What start_once has written, newest first; a batch's rows by ``order``, largest first."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").orderBy(F.desc("batch"), F.desc(order))


def milliseconds(interval: str | None) -> int | None:
    """An interval such as "10 minutes" in milliseconds."""
    return interval and int(pd.Timedelta(interval).total_seconds() * 1000)


def verdict_of(state: str | None, new: str, before: str | None, last: str | None, result: str | None, turns: int) -> str | None:
    """What a run's new step makes of it: a fault, a final state, or None as it goes on."""
    if state is not None and (state, new) not in STEPS:
        return "illegal"
    if before is not None and last is not None and before == result != last:
        return "oscillating"
    if turns > MOST_TURNS:
        return "too long"
    return new if new in FINAL else None


class PhaseMachine(StatefulProcessor):
    """Checks each run's steps as they come; a run that went wrong or ended stays so."""

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "state string, before string, last string, turns int, verdict string", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        state, before, last, turns, verdict = known or (None, None, None, 0, "running")
        for step in pd.concat(list(rows)).sort_values("seq").itertuples():
            if verdict != "running":
                break
            turns += step.state == "plan"
            verdict = verdict_of(state, step.state, before, last, step.result_hash, turns) or verdict
            state, before, last = step.state, last, step.result_hash
        self.state.update((state, before, last, int(turns), verdict))
        yield pd.DataFrame({"run_id": [key[0]], "turns": [int(turns)], "verdict": [verdict]})

    def close(self) -> None:
        pass


def live_states(steps: DataFrame, forget: str | None = None) -> DataFrame:
    """Of each run with new steps: turns and verdict so far. Needs the RocksDB state store. A run that gets no step for ``forget`` (of processing time) is forgotten."""
    return steps.groupBy("run_id").transformWithStateInPandas(PhaseMachine(milliseconds(forget)), "run_id bigint, turns int, verdict string", "update", "processingTime" if forget else "none")


ENDED = "lane string, run_id bigint, verdict string, turns int, steps int, refused int, tokens bigint, began timestamp, ended timestamp"


class TimedRuns(StatefulProcessor):
    """One run at a time on each lane, from its step of seq 0 to a final state, a fault, or a time without a step.

    Steps of other runs meanwhile are refused and counted. When a run ends its row goes out, and its lane's state and timer go.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "run_id bigint, state string, before string, last string, turns int, steps int, refused int, tokens bigint, began bigint, at bigint")

    def _end(self, key: Any, run: dict, verdict: str, at: int) -> dict:
        row = {"lane": key[0], "verdict": verdict, **{c: run[c] for c in ("run_id", "turns", "steps", "refused", "tokens")}}
        return row | {c: pd.Timestamp(t, unit="ms") for c, t in (("began", run["began"]), ("ended", at))}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = ("run_id", "state", "before", "last", "turns", "steps", "refused", "tokens", "began", "at")
        run = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else None
        timer = run["at"] + self.patience if run else None
        ended = []
        for step in pd.concat(list(rows)).sort_values(["ts", "run_id", "seq"], kind="stable").itertuples():
            at = int(step.ts.value // 1_000_000)
            if run and at > run["at"] + self.patience:
                ended.append(self._end(key, run, "timed out", run["at"] + self.patience))
                run = None
            if run is None:
                if step.seq != 0:
                    continue
                run = dict.fromkeys(names) | {"run_id": int(step.run_id), "turns": 0, "steps": 0, "refused": 0, "tokens": 0, "began": at}
            elif step.run_id != run["run_id"]:
                run["refused"] += 1
                continue
            run["turns"] += int(step.state == "plan")
            run["steps"] += 1
            run["tokens"] += int(step.tokens)
            verdict = verdict_of(run["state"], step.state, run["before"], run["last"], step.result_hash, run["turns"])
            run |= {"state": step.state, "before": run["last"], "last": step.result_hash, "at": at}
            if verdict:
                ended.append(self._end(key, run, verdict, at))
                run = None
        now = run["at"] + self.patience if run else None
        if timer != now:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now)
        if run:
            self.state.update(tuple(run[c] for c in names))
        else:
            self.state.clear()
        if ended:
            yield pd.DataFrame(ended)[[f.split()[0] for f in ENDED.split(", ")]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        names = ("run_id", "state", "before", "last", "turns", "steps", "refused", "tokens", "began", "at")
        if not self.state.exists():
            return
        run = dict(zip(names, self.state.get(), strict=True))
        self.state.clear()
        yield pd.DataFrame([self._end(key, run, "timed out", run["at"] + self.patience)])[[f.split()[0] for f in ENDED.split(", ")]]

    def close(self) -> None:
        pass


def timed_runs(steps: DataFrame, patience: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Runs that ended, of steps (lane, run_id, seq, ts, state, result_hash, tokens): one row each, with its counters.

    A lane has one run at a time. A run that gets no step for ``patience`` of event time is timed out once the
    watermark passes. Steps of a run that isn't going on and that don't begin one are left out, so a final state stays final. Needs the RocksDB state store.
    """
    return _timed(steps, late).groupBy("lane").transformWithStateInPandas(TimedRuns(milliseconds(patience)), ENDED, "append", "eventTime")


def run_counters(ended: DataFrame) -> DataFrame:
    """Of runs that ended, by verdict: runs, turns, tokens of the converged ones, and refused steps."""
    saved = F.sum(F.when(F.col("verdict") == "converged", F.col("tokens")).otherwise(0))
    return ended.groupBy("verdict").agg(F.count(F.lit(1)).alias("runs"), F.sum("turns").alias("turns"), saved.alias("tokens"), F.sum("refused").alias("refused"))


class Recent(StatefulProcessor):
    """Whether a digest was seen within a time; the store forgets it after that."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "n bigint", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.times.get()[0] if self.times.exists() else 0
        ids = pd.concat(list(rows))["request_id"].sort_values()
        self.times.update((n + len(ids),))
        yield pd.DataFrame({"request_id": ids, "digest": key[0], "reused": [n + k > 0 for k in range(len(ids))]})

    def close(self) -> None:
        pass


def reused_live(requests: DataFrame, keep: str = "1 hour") -> DataFrame:
    """Requests (request_id, text) with whether an equal text was asked within ``keep`` of processing time. Digests are state, texts aren't."""
    keyed = requests.select("request_id", F.sha2("text", 256).alias("digest"))
    return keyed.groupBy("digest").transformWithStateInPandas(Recent(milliseconds(keep)), "request_id bigint, digest string, reused boolean", "append", "processingTime")


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", every: str | None = None, **options: str) -> StreamingQuery:
    """Start a query; without ``every`` it takes what there is and ends. Its rate is changed by stopping it and starting anew."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k, v)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
