import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity, distill, graph, prefix, ranking, routing, skeleton, states, usage
from tidemark.sources import readers, schemas, sinks

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    return spark.createDataFrame([(i, at(s), u, kind, 1.0, "{}") for i, (s, u, kind) in enumerate(rows)], schemas.ACTIVITY)


def test_ranking_ties_and_literal_queries(spark):
    stats = spark.createDataFrame([("b", 10, 5, 5, 50.0), ("a", 10, 5, 5, 50.0), ("A%_", 0, 0, 0, None)], "path string, raw long, kept long, savings long, pct double")
    assert [r.path for r in ranking.rank_files(stats, "savings").orderBy("place").collect()] == ["a", "b", "A%_"]
    assert [r.path for r in ranking.rank_files(stats, "pct", " %_ ").collect()] == ["A%_"]
    assert [r.path for r in ranking.rank_files(stats, "unknown").orderBy("place").collect()] == ["A%_", "a", "b"]
    assert [r.path for r in ranking.page(stats, ["path"], 1, 1).collect()] == ["a"]


def test_pareto_front_against_all_pairs(spark):
    rng = random.Random(5)
    points = [(i, rng.randint(0, 12), rng.randint(0, 12)) for i in range(150)] + [(900, None, 1)]
    found = {r.id for r in ranking.pareto(spark.createDataFrame(points, "id int, x int, y int"), "x", "y").collect()}
    real = [p for p in points if p[1] is not None]
    assert found == {p[0] for p in real if not any(q[1] <= p[1] and q[2] <= p[2] and (q[1] < p[1] or q[2] < p[2]) for q in real)}


def test_sessions_at_the_boundary(spark):
    df = events(spark, [(0, 1, "click"), (1200, 1, "click"), (2401, 1, "click"), (0, 2, "click")])
    found = sorted((r.user_id, r.n_events, r.seconds) for r in activity.sessions(df, 1200).collect())
    assert found == [(1, 1, 0), (1, 2, 1200), (2, 1, 0)]
    assert activity.flow(df, 1200, 600).where("user_id = 1").first().flow == 1.0


def test_nearest_events_and_ties(spark):
    df = events(spark, [(0, 1, "error"), (0, 1, "purchase"), (50, 1, "error"), (60, 2, "purchase")])
    found = {r.event_id: r.next_ts for r in activity.next_event(df, F.col("event_type") == "error", F.col("event_type") == "purchase").collect()}
    assert found == {0: at(0), 2: None}
    back = activity.last_event(df, F.col("event_type") == "error", F.col("event_type") == "purchase").collect()
    assert {r.event_id: r.last_ts for r in back} == {0: None, 2: at(0)}


def test_ledger(spark):
    ledger = spark.createDataFrame([("m", 2_000_000, 1_000_000, 5, "observed"), ("n", 10, 0, 1, "estimated")], "model string, input_tokens long, cached_tokens long, output_tokens long, kind string")
    prices = spark.createDataFrame([("m", Decimal("3.00"), Decimal("0.30"), 1024), ("q", Decimal("1"), Decimal("1"), 64)], schemas.PRICES)
    row = usage.priced(ledger, prices).where("model = 'm'").first()
    assert (row.cost_full, row.cost_cached, row.cost_avoided) == (Decimal("6.000000"), Decimal("3.300000"), Decimal("2.700000"))
    assert usage.priced(ledger, prices).where("model = 'n'").first().cost_full is None
    assert usage.observed_and_estimated(ledger).where("model = 'm'").first().estimated_tokens == 0
    assert usage.totals(ledger, F.lit(3), F.lit(1)).first().saved_pct == 25.0
    assert usage.hit_rate(ledger, "model").where("model = 'm'").first().hit_rate == 0.5
    assert [r[0] for r in spark.createDataFrame([(5,), (50,), (500,)], "x int").select(usage.milestone(F.col("x"), [(10, "a"), (100, "b")])).collect()] == [None, "a", "b"]


def test_running_sums_that_meet_the_limit_are_not_over_it(spark):
    values = [0.1, 0.2, 0.3, 0.4, None, 1e-12, 1e300, float("nan")]  # as doubles the first three come to more than 0.6
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("none", 0, None)], "k string, i int, v double")
    found = {(r.k, r.i): (r.running, r.over) for r in usage.running(df, "k", ["i"], "v", 0.6).collect()}
    assert found["k", 2] == (0.6, False) and found["k", 3] == found["k", 4] == (1.0, True)
    assert found["k", 5][0] == 1.0 + 1e-12 and found["k", 6][0] == 1e300 and found["k", 7][0] != found["k", 7][0]
    assert found["none", 0] == (None, None)


def test_milestones_are_of_exact_totals(spark, tmp_path):
    from tidemark.plans.ledger_queries import milestones

    rows = [(i, u, v) for u, values in enumerate([[0.1] * 10, [2999.7, 0.1, 0.1, 0.1], [0.5, None], [None]]) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id int, user_id int, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: (r.total, r.milestone) for r in milestones(spark, str(tmp_path)).collect()} == {0: (1, "start"), 1: (3000, "bronze"), 2: (0, "start"), 3: (None, None)}


def test_tasks_take_turns_of_their_interval(spark):
    turns = spark.createDataFrame([(1, at(0), 5), (1, at(10), 7), (2, at(5), 100)], "user_id long, ts timestamp, tokens long")
    tasks = spark.createDataFrame([("t", 1, at(0), at(10)), ("u", 1, at(10), at(20)), ("v", 3, at(0), at(1))], "task_id string, user_id long, start timestamp, stop timestamp")
    assert {r.task_id: r.tokens for r in usage.per_task(turns, tasks).collect()} == {"t": 5, "u": 7, "v": 0}


def test_drift_and_missing_branches(spark):
    a = spark.createDataFrame([("x", 100.0), ("gone", 1.0), ("zero", 0.0)], "b string, v double")
    b = spark.createDataFrame([("x", 118.4), ("new", 2.0), ("zero", 3.0)], "b string, v double")
    found = {r.b: (r.change_pct, r.kind) for r in usage.drift(a, b, "b", "v").collect()}
    assert found == {"x": (18.4, "more"), "gone": (-100.0, "less"), "new": (None, "new"), "zero": (None, "new")}


def test_closure_ends_on_cycles_and_grows(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (3, 5), (5, 6), (9, 9)], schemas.EDGES)
    roots = spark.createDataFrame([(1,)], "node long")
    near = [dict((r.node, r.depth) for r in graph.closure(edges, roots, d).collect()) for d in range(5)]
    assert near[4] == {1: 0, 2: 1, 4: 1, 3: 2, 5: 2, 6: 3}
    assert all(set(a) <= set(b) for a, b in zip(near, near[1:], strict=False))
    tests = spark.createDataFrame([(1,), (9,)], "node long")
    assert [r.node for r in graph.affected(edges, spark.createDataFrame([(6,)], "node long"), tests, 4).collect()] == [1]


def test_prefix_is_the_same_for_any_order(spark):
    files = [(i, f"text {i % 3}") for i in range(6)]
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    digests = set()
    for seed in range(3):
        shuffled = files[:]
        random.Random(seed).shuffle(shuffled)
        ordered = prefix.topological(spark.createDataFrame(shuffled, "id long, text string"), edges, 4)
        digests.add(prefix.prefix_digest(ordered).first().digest)
        places = {r.id: r.place for r in ordered.collect()}
        assert places[1] < places[2] < places[3]
    assert len(digests) == 1
    parts = spark.createDataFrame([("p", 2, "b", "x"), ("p", 2, "a", "y"), ("p", 1, "z", "s")], "k string, tier int, name string, text string")
    assert prefix.layered(parts, "k").first().prompt == "s\ny\nx"
    tiers = prefix.demoted(spark.createDataFrame([(1,), (9,)], "edited int"), "edited", F.lit(10), 3)
    assert [r.tier for r in tiers.orderBy("edited").collect()] == [1, 3]


RULES = [("database", ["sql", "database"]), ("web", ["http"]), ("incident", ["error", "crash"]), ("filesystem", ["file", "READ"])]


def test_routes_in_order(spark):
    texts = [("a SQL error",), ("error",), ("thread",), ("none",), ("web http",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(routing.route(F.col("t"), RULES, "versions")).collect()] == ["database", "incident", "filesystem", "versions", "web"]


def test_tool_schemas(spark):
    good = '{"type":"object","properties":{"path":{"type":"string"},"n":{"type":"integer"},"o":{"type":"object","properties":{"a":{}}}},"required":["path"]}'
    df = spark.createDataFrame([("f", good), ("g", "{bad"), ("h", "{}")], "name string, schema_json string")
    found = [r[0] for r in df.select(routing.signature(F.col("name"), F.col("schema_json"))).collect()]
    assert found[0] == "f(n?: integer, o?: object, path: string)" and found[2] == "h()"
    audit = routing.schema_audit(df).collect()
    assert (audit[0].n_params, audit[0].too_many, audit[0].depth) == (3, False, 5)
    lacking = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["a"])], "r array<string>, g array<string>").select(routing.missing_parameters(F.col("r"), F.col("g")))
    assert [r[0] for r in lacking.collect()] == ["missing: a", None]


def test_top_matches_pins_and_budget(spark):
    prompts = spark.createDataFrame([(1, "read the file now"), (2, "zzz")], "p long, text string")
    tools = spark.createDataFrame([(10, "read file"), (11, "file"), (12, "file x"), (13, "nothing")], "t long, text string")
    ranked = routing.top_matches(prompts, tools, 2, "p", "t")
    assert [(r.p, r.t, r.score) for r in ranked.orderBy("place").collect()] == [(1, 10, 2), (1, 11, 1)]
    pinned = routing.with_pinned(ranked, spark.createDataFrame([(13,), (10,)], "t long"), "p", "t")
    assert sorted(r.t for r in pinned.collect()) == [10, 11, 13]
    sized = ranked.withColumn("tokens", F.lit(300))
    assert routing.within_budget(sized, "p", ["place"], "tokens", 450).count() == 1


def test_policies(spark):
    calls = spark.createDataFrame([("plan", "read"), ("plan", "write")], "phase string, tool string")
    allowed = spark.createDataFrame([("plan", "read")], "phase string, tool string")
    assert [r.tool for r in routing.violations(calls, allowed, ["phase", "tool"]).collect()] == ["write"]
    commands = [("rm -rf /",), ("ls",), ("git push origin --force",), ("DROP TABLE x",)]
    assert [r[0] for r in spark.createDataFrame(commands, "c string").select(routing.destructive(F.col("c"))).collect()] == [True, False, True, True]


def test_bounded_arrays(spark):
    cases = {0: "[]", 6: "[1,2,3,4,5,6]", 7: '["1","2","3","5","6","7"]'}
    for n, want in cases.items():
        payload = "[" + ",".join(str(i + 1) for i in range(n)) + "]"
        assert spark.createDataFrame([(payload,)], "x string").select(distill.bounded_json(F.col("x"))).first()[0] == want
    assert spark.createDataFrame([("oops",)], "x string").select(distill.bounded_json(F.col("x"))).first()[0] == "oops"


def test_distilled_output(spark):
    lines = [(1, "pytest", i, t) for i, t in enumerate(["a PASSED", "b PASSED", "\x1b[31mc FAILED\x1b[0m", "E  boom", "d PASSED", "e PASSED"])]
    lines += [(2, "pytest", 0, "a PASSED"), (2, "pytest", 1, "1 passed in 2s"), (3, "other", 0, "x PASSED")]
    text = {r.run_id: r.text for r in distill.rejoined(distill.distilled(spark.createDataFrame(lines, schemas.TOOL_OUTPUT))).collect()}
    assert text == {1: "b PASSED\nc FAILED\nE  boom\nd PASSED", 2: "1 passed in 2s", 3: "x PASSED"}


def test_surgery_leaves_the_prefix(spark):
    turns = spark.createDataFrame([(1, "old trace", True), (5, "new trace", True), (6, "open", False)], "turn int, text string, done boolean")
    found = [r.text for r in distill.surgery(turns, "done", F.lit(4)).orderBy("turn").collect()]
    assert found[0] == "old trace" and found[1].startswith("[resolved ") and found[2] == "open"


def test_states(spark):
    runs = {1: ["plan", "guard", "act", "observe", "converged"], 2: ["plan", "act"], 3: ["plan", "guard", "act", "observe"], 4: ["plan", "guard", "act", "observe"] * 6}
    hashes = {3: ["x", "a", "b", "a"]}
    rows = [(r, i, s, hashes.get(r, [f"{r}-{k}" for k in range(99)])[i]) for r, ss in runs.items() for i, s in enumerate(ss)]
    found = {r.run_id: r.verdict for r in states.run_states(spark.createDataFrame(rows, schemas.FSM_STEPS)).collect()}
    assert found == {1: "converged", 2: "illegal", 3: "oscillating", 4: "too long"}


def test_runs_end_at_their_first_fault_or_final_state(spark):
    runs = {1: ["plan", "guard", "rollback", "plan"], 2: ["plan"], 3: ["plan", "act", "rollback"], 4: ["guard", "plan", "guard"]}
    rows = [(r, i, s, f"{r}-{i}") for r, ss in runs.items() for i, s in enumerate(ss)]
    found = {r.run_id: (r.verdict, r.turns, r.last_state) for r in states.run_states(spark.createDataFrame(rows, schemas.FSM_STEPS)).collect()}
    assert found == {1: ("rollback", 1, "rollback"), 2: ("running", 1, "plan"), 3: ("illegal", 1, "act"), 4: ("illegal", 1, "plan")}


def test_wrong_types_tell_quoted_numbers(spark):
    schema = '{"properties": {"p1": {"type": "string"}, "p2": {"type": "integer"}, "p3": {"type": "number"}, "p4": {"type": "object"}, "p5": {"type": "array"}, "p6": {"type": "boolean"}, "p7": {"type": "null"}}}'
    given = [('{"p1":"7","p2":"7"}', ["p2"]), ('{"p1":7,"p2":7,"p3":7}', ["p1"]), ('{"p2":7.0,"p3":7.5}', []), ('{"p2":7.5,"p4":[1],"p5":{"a":1}}', ["p2", "p4", "p5"]), ('{"p6":"true","p7":null,"p4":{},"p5":[]}', ["p6"]), ('{"other":1,"p1":null}', ["p1"]), ("not json", None), (None, None)]
    df = spark.createDataFrame(given, "given string, want array<string>").select("want", routing.wrong_types(F.lit(schema), F.col("given")).alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in given]


def test_skeletons(spark):
    source = 'class A(B):\n    """Doc."""\n    def f(self, x=1) -> int:\n        return x\n'
    df = spark.createDataFrame([("a.py", "python", source), ("b.py", "python", "def ("), ("c.go", "go", "x")], "path string, lang string, text string")
    found = [r.skeleton for r in skeleton.skeletons(df).orderBy("path").collect()]
    assert found == ["class A(B): ...  # Doc.\n    def f(self, x=1) -> int: ...", "def (", "x"]
    assert skeleton.symbol(source, "A.f").startswith("def f") and skeleton.symbol(source, "A.g") is None


def test_headers_find_sources(spark):
    h, s = spark.createDataFrame([("inc/a.h",), ("inc/b.hpp",)], "path string"), spark.createDataFrame([("src/a.cc",), ("src/c.cc",)], "path string")
    assert [(r.header, r.source) for r in graph.header_sources(h, s).collect()] == [("inc/a.h", "src/a.cc")]


def test_origins(spark):
    df = spark.createDataFrame([("x", "human", 3), ("x", "ai", 4), ("y", "human", 1)], "k string, origin string, lines long")
    assert {r.k: (r.human, r.ai) for r in activity.by_origin(df, "k", "origin", "lines").collect()} == {"x": (3, 4), "y": (1, 0)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"req_id": 1, "model": "m", "input_tokens": 5}\nbroken\n')
    log = readers.request_log(spark, str(tmp_path / "log")).cache()
    assert log.where("corrupt is null").first().input_tokens == 5 and log.where("corrupt is not null").count() == 1
    (tmp_path / "ws/d").mkdir(parents=True)
    (tmp_path / "ws/d/x.py").write_text("a\nb")
    snap = readers.snapshot(spark, str(tmp_path / "ws"), "*.py").first()
    assert (snap.text, snap.bytes) == ("a\nb", 3)
    servers = readers.server_configs(spark.createDataFrame([('{"s": {"command": "c", "args": ["1"]}}',), ("bad",)], "text string")).collect()
    assert [(r.name, r.command, r.args) for r in servers] == [("s", "c", ["1"])]
    with pytest.raises(ValueError, match="missing columns: model"):
        readers.require(spark.range(1).select(F.lit(1).alias("full_per_m"), F.lit(1).alias("cached_per_m"), F.lit(1).alias("chunk")), schemas.PRICES)
    with pytest.raises(ValueError):
        readers.ticks(spark, 0)
    df = spark.createDataFrame([(1, "a@b.cd", "/x/y.z")], "i int, t string, p string")
    sinks.export_audit(df, str(tmp_path / "audit"))
    assert len(spark.read.json(str(tmp_path / "audit")).first().sha256) == 64
    sinks.export_diagnostics(df, str(tmp_path / "diag"), ["t"], ["p"])
    assert spark.read.json(str(tmp_path / "diag")).first().asDict() == {"i": 1, "t": "<email>", "p": "y.z"}
    sinks.export_ledger(df, str(tmp_path / "ledger"))
    sinks.export_ledger(df, str(tmp_path / "ledger"), reset=True)
    sinks.export_html(df, str(tmp_path / "html"))
    assert spark.read.text(str(tmp_path / "html")).first()[0].startswith("<tr><td>{&quot;i&quot;")
