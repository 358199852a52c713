import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import states
from tidemark.sources import readers, schemas
from tidemark.streaming import live


def written(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[k::2]) + "\n")
    return str(folder)


def ran(spark, df, name, tmp_path, mode="append"):
    live.start(df, "memory", str(tmp_path / name), mode, queryName=name).awaitTermination(120)
    return spark.table(name)


def event(i, seconds, user):
    return {"event_id": i, "ts": (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)).isoformat(), "user_id": user, "event_type": "click", "value": 1.0, "props": "{}"}


def test_buckets_and_sessions_equal_batch(spark, tmp_path):
    rows = [event(i, s, i % 2) for i, s in enumerate([0, 30, 60, 100, 130, 400, 410, 800, 9000, 9001])]
    folder = written(spark, tmp_path, rows)
    batch = spark.read.schema(schemas.ACTIVITY).json(folder)
    for name, f in (("tumbling", live.buckets), ("sliding", lambda d: live.buckets(d, "4 minutes", "2 minutes")), ("paused", live.live_sessions)):
        streamed = ran(spark, f(readers.watch_activity(spark, folder)), name, tmp_path, "complete" if name != "paused" else "append")
        want = f(batch)
        if name == "paused":  # the last sessions stay open until the watermark passes them
            want = want.where(F.col("last_ts") < F.lit("2024-01-01 02:00:00").cast("timestamp"))
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, want.collect())), name


def test_repeated_events_count_once(spark, tmp_path):
    folder = written(spark, tmp_path, [event(1, 0, 1), event(1, 5, 1), event(2, 6, 1)])
    assert ran(spark, live.once(readers.watch_activity(spark, folder)), "once_only", tmp_path).count() == 2


def test_states_equal_batch(spark, tmp_path):
    turn = ["plan", "guard", "act", "observe"]
    runs = {1: [*turn, "converged"], 2: ["plan", "act"], 4: ["plan", "guard", "rollback"], 5: ["plan", "guard", "rollback", "plan"], 6: ["plan", "guard", "act"], 7: turn * 6, 8: [*turn, "converged", "rollback"], 9: turn}
    rows = [{"run_id": r, "seq": i, "state": s, "result_hash": "same" if r == 9 and i in (1, 3) else f"{r}-{i}"} for r, ss in runs.items() for i, s in enumerate(ss)]
    folder = tmp_path / "steps"
    folder.mkdir()
    (folder / "0.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    streamed = ran(spark, live.live_states(spark.readStream.schema(schemas.FSM_STEPS).json(str(folder))), "run_verdicts", tmp_path, "update")
    batch = states.run_states(spark.read.schema(schemas.FSM_STEPS).json(str(folder)))
    found = {r.run_id: (r.turns, r.verdict) for r in streamed.collect()}
    assert found == {r.run_id: (r.turns, r.verdict) for r in batch.collect()}
    assert {r: v for r, (_, v) in found.items()} == {1: "converged", 2: "illegal", 4: "rollback", 5: "rollback", 6: "running", 7: "too long", 8: "converged", 9: "oscillating"}


SECONDS = dt.datetime(2024, 1, 1)
STEP = "lane string, run_id bigint, seq int, ts timestamp, state string, result_hash string, tokens bigint"


def step(lane, run, seq, second, state, tokens=1):
    return {"lane": lane, "run_id": run, "seq": seq, "ts": (SECONDS + dt.timedelta(seconds=second)).isoformat(), "state": state, "result_hash": f"{run}-{seq}", "tokens": tokens}


def fed(spark, tmp_path, name, batches, schema, make, mode="append", **query):
    """Runs a stream over one file after the other, each a batch of its own; returns its table and checkpoint."""
    folder = tmp_path / name
    folder.mkdir()
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)))
    checkpoint = tmp_path / f"{name}-checkpoint"
    running = live.start(stream, "memory", str(checkpoint), mode, "0 seconds", queryName=name, **query)
    try:
        for k, rows in enumerate(batches):
            (folder / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
            running.processAllAvailable()
            yield running
    finally:
        running.stop()


def test_timed_runs_end_and_leave_no_state(spark, tmp_path):
    turn = ["plan", "guard", "act", "observe"]
    first = [step("a", 1, i, 10 * i, s, 5) for i, s in enumerate([*turn, "converged"])]
    first += [step("a", 2, i, 10 * i + 5, s) for i, s in enumerate(turn[:2])]  # refused: run 1 is going on
    first += [step("b", 3, i, 10 * i, s) for i, s in enumerate(["plan", "guard", "rollback", "act", "observe"])]  # final stays final
    first += [step("c", 4, 0, 0, "plan"), step("c", 4, 1, 20, "guard"), step("d", 5, 3, 0, "plan")]  # 4 goes silent, 5 never began
    second = [step("c", 6, 0, 2000, "plan"), step("e", 7, 0, 2000, "plan"), step("e", 7, 1, 2001, "act")]
    third = [step("z", 8, 0, 9000, "plan"), step("z", 8, 1, 9001, "act")]
    for running in fed(spark, tmp_path, "timed", [first, second, third], STEP, live.timed_runs):
        pass
    rows = {r.run_id: r for r in spark.table("timed").collect()}
    assert {k: r.verdict for k, r in rows.items()} == {1: "converged", 3: "rollback", 4: "timed out", 6: "timed out", 7: "illegal", 8: "illegal"}
    assert (rows[1].turns, rows[1].steps, rows[1].tokens, rows[1].refused) == (1, 5, 25, 2)
    assert (rows[4].ended - rows[4].began).total_seconds() == 620 and rows[3].steps == 3
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    counters = {r.verdict: r for r in live.run_counters(spark.table("timed")).collect()}
    assert (counters["converged"].runs, counters["converged"].tokens, counters["converged"].refused, counters["timed out"].runs) == (1, 25, 2, 2)


def test_timed_runs_equal_one_pass(spark, tmp_path):
    """Whatever the batches, runs end as in one pass over all steps in order."""
    import random

    r = random.Random(3)
    rows, second = [], 0
    for run in range(60):
        states = r.choice([["plan", "guard", "act", "observe", "converged"], ["plan", "guard", "rollback", "plan"], ["plan", "act"], ["plan", "guard"]])
        lane = r.choice("ab")
        for i, s in enumerate(states):
            second += r.choice([1, 30, 100])
            rows.append(step(lane, run, i, second, s))
        second += r.choice([1, 900])
    rows += [step("z", 99, 0, second + 9000, "plan"), step("z", 99, 1, second + 9001, "act")]
    want, going = {}, {}
    for x in sorted(rows, key=lambda x: x["ts"]):
        at, lane, run = dt.datetime.fromisoformat(x["ts"]), x["lane"], x["run_id"]
        if lane in going and (at - going[lane][1]).total_seconds() > 600:
            want[going.pop(lane)[0]] = "timed out"
        if lane not in going and x["seq"] == 0:
            going[lane] = [run, at, None, 0]
        if lane not in going or going[lane][0] != run:
            continue
        verdict = live.verdict_of(going[lane][2], x["state"], None, None, None, 0)
        going[lane][1:3] = at, x["state"]
        if verdict:
            want[run] = verdict
            del going[lane]
    want |= {run: "timed out" for run, *_ in going.values()}
    cuts = sorted(r.sample(range(1, len(rows) - 2), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for _ in fed(spark, tmp_path, "one_pass", batches, STEP, live.timed_runs):
        pass
    assert {r.run_id: r.verdict for r in spark.table("one_pass").collect()} == want


def test_reuse_is_forgotten_in_time(spark, tmp_path):
    import time

    folder = tmp_path / "asked"
    folder.mkdir()
    stream = live.reused_live(spark.readStream.schema("request_id bigint, text string").json(str(folder)), "15 seconds")
    running = live.start(stream, "memory", str(tmp_path / "c"), "append", "1 second", queryName="reuse")
    try:  # timers of processing time make batches for ever, so the table is watched
        for k, (pause, asked) in enumerate([(0, [(1, "q"), (2, "q"), (3, "other")]), (0, [(4, "q")]), (17, [(5, "q")])]):
            time.sleep(pause)
            (folder / f"{k}.jsonl").write_text("\n".join(json.dumps({"request_id": i, "text": t}) for i, t in asked) + "\n")
            for _ in range(60):
                if spark.table("reuse").where(f"request_id = {asked[0][0]}").count():
                    break
                time.sleep(0.5)
    finally:
        running.stop()
    assert {r.request_id: r.reused for r in spark.table("reuse").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_ticks(spark, tmp_path):
    query = live.start(live.counters(readers.ticks(spark, 50)), "memory", str(tmp_path / "ticks"), "complete", "1 second", queryName="tick_counts")
    try:
        for _ in range(40):
            query.awaitTermination(1)
            if spark.table("tick_counts").count() and spark.table("tick_counts").first().ticks:
                break
        assert spark.table("tick_counts").first().ticks > 0
    finally:
        query.stop()


def test_batches_written_twice_are_there_once(spark, tmp_path):
    out = str(tmp_path / "once")
    put = live.put_batch(out)
    batches = [spark.createDataFrame([(k, f"{n}")], "seq long, text string") for n, k in enumerate((1, 5, 3))]
    for n, batch in enumerate(batches):
        put(batch, n)
    put(batches[1], 1)  # as after a failure between writing and committing
    assert [(r.seq, r.batch) for r in live.newest_first(spark, out, "seq").collect()] == [(3, 2), (5, 1), (1, 0)]


def test_a_replayed_stream_leaves_its_table_as_it_is(spark, tmp_path):
    import shutil

    folder = written(spark, tmp_path, [event(i, i, 1) for i in range(10)])
    out, checkpoint = str(tmp_path / "table"), tmp_path / "commits"
    start = lambda: live.start_once(readers.watch_activity(spark, folder), out, str(checkpoint)).awaitTermination(120)
    start()
    shutil.rmtree(checkpoint / "commits")  # the batch was written, but not committed
    start()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_prices_join_a_stream(spark, tmp_path):
    folder = written(spark, tmp_path, [event(1, 0, 1), event(2, 1, 9)])
    prices = spark.createDataFrame([(1, 2.5)], "user_id long, price double")
    found = ran(spark, live.priced_live(readers.watch_activity(spark, folder), prices, "user_id"), "priced", tmp_path)
    assert {r.event_id: r.price for r in found.collect()} == {1: 2.5, 2: None}


def test_failures_and_recoveries_meet(spark, tmp_path):
    schema = schemas.ACTIVITY
    rows = [[(1, 0, 1, "error"), (2, 60, 1, "purchase"), (3, 100, 2, "error")], [(4, 200, 1, "error"), (5, 4500, 2, "purchase")], [(6, 20_000, 3, "click")], [(7, 40_000, 3, "click")]]
    batches = [[event(i, s, u) | {"event_type": kind} for i, s, u, kind in part] for part in rows]

    def joined(how):
        return lambda d: live.recovered_live(d.where("event_type <> 'purchase'"), d.where("event_type <> 'error'"), "1 hour", "1 minute", how).select("failed_id", "event_id")

    for how, want in (("inner", {(1, 2)}), ("left", {(1, 2), (3, None), (4, None), (6, None)})):
        for _ in fed(spark, tmp_path, f"met_{how}", batches, schema, joined(how)):
            pass
        assert {tuple(r) for r in spark.table(f"met_{how}").collect()} == want
