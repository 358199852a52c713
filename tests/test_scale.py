"""Operators that leave out or store what others compute anew: retrieval, recursion, snapshots, sketches and reports of failures."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import distill, graph, routing, sketches
from tidemark.sources import snapshots


def some_texts(seed, n, words):
    r = random.Random(seed)
    stop = ["the", "of", "and", "to"]
    return [(i, " ".join([w for w in stop if r.random() < 0.9] + [f"w{int(r.paretovariate(0.7)) % words}" for _ in range(r.randrange(1, 12))])) for i in range(n)]


def all_pairs(prompts, items, k, weighted):
    sets = lambda rows: {i: {w for w in t.lower().split()} for i, t in rows}
    p, c = sets(prompts), sets(items)
    have = {}
    for ws in c.values():
        for w in ws:
            have[w] = have.get(w, 0) + 1
    import math

    weight = {w: int(math.floor(1000 * math.log(1 + len(c) / n) + 0.5)) if weighted else 1 for w, n in have.items()}
    out = set()
    for a, ws in p.items():
        scored = sorted((-sum(weight[w] for w in ws & xs), b) for b, xs in c.items() if ws & xs)
        out |= {(a, b, -s, n + 1) for n, (s, b) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("weighted", [True, False])
def test_retrieval_is_that_of_all_pairs(spark, weighted):
    prompts, items = some_texts(1, 60, 80), some_texts(2, 150, 80)
    p, c = spark.createDataFrame(prompts, "q long, text string"), spark.createDataFrame(items, "item long, text string")
    for k in (1, 3, 200):
        found = routing.ranked_matches(p, c, k, "q", "item", weighted=weighted)
        assert {(r.q, r.item, r.score, r.place) for r in found.collect()} == all_pairs(prompts, items, k, weighted)
    assert routing.ranked_matches(p.where("q < 0"), c, 3, "q", "item").count() == 0
    assert routing.ranked_matches(p, c.where("item < 0"), 3, "q", "item").count() == 0


def test_long_lists_are_not_joined(spark):
    prompts, items = some_texts(3, 100, 400), some_texts(4, 2000, 400)
    p, c = spark.createDataFrame(prompts, "q long, text string"), spark.createDataFrame(items, "item long, text string")
    listed = routing.postings(c, "item")
    wanted = routing.terms(p, "q", "text").join(listed.select("term", "weight", "items").distinct(), "term")
    best = routing.ranked_matches(p, c, 3, "q", "item").where("place = 3").select("q", F.col("score").alias("needed"))
    rows = lambda df: df.agg(F.sum("items")).first()[0]
    assert rows(routing.essential(wanted.join(best, "q"), "q", "needed")) < rows(wanted) / 4


def test_pinned_items_are_bounded(spark):
    ranked = spark.createDataFrame([(1, 5)], "q long, item long")
    many = spark.range(routing.MOST_PINNED + 1).withColumnRenamed("id", "item")
    with pytest.raises(ValueError, match="pinned"):
        routing.with_pinned(ranked, many, "q", "item")
    assert routing.with_pinned(ranked, many.where("item < 0"), "q", "item").count() == 1


def test_closures_are_one_query(spark):
    r = random.Random(7)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    edges, roots = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,), (0,), (3,)], "node int")
    for depth in (0, 1, 3, 30):
        found, front = {0: 0, 3: 0}, {0, 3}
        for d in range(1, depth + 1):
            front = {b for a, b in pairs if a in front} - set(found)
            found |= dict.fromkeys(front, d)
        assert {x.node: x.depth for x in graph.closure(edges, roots, depth).collect()} == found
    level = {x: 0 for p in pairs for x in p}
    for _ in range(9):
        level = {x: min(9, max([level[x], *(level[a] + 1 for a, b in pairs if b == x)])) for x in level}
    assert {x.node: x.level for x in graph.levels(edges, 9).collect()} == level
    assert graph.closure(edges.where("src < 0"), roots, 5).count() == 2


def test_snapshots_outlive_their_files(spark, tmp_path):
    folder, store = tmp_path / "work", f"file://{tmp_path}/store"
    (folder / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("b.txt", "two"), ("sub/c.txt", "one"), ("skip.bin", "x")):
        (folder / name).write_text(text)
    first = snapshots.take(spark, str(folder), store, "first", "*.txt")
    assert {(r.path, r.bytes) for r in first.collect()} == {("a.txt", 3), ("b.txt", 3), ("sub/c.txt", 3)}
    (folder / "a.txt").write_text("changed")
    (folder / "b.txt").unlink()
    (folder / "moved.txt").write_text("two")
    (folder / "new.txt").write_text("n")
    (folder / "empty.txt").write_text("")
    now = snapshots.current(spark, str(folder), "*.txt")
    want = {("a.txt", "changed", 3, 7, None), ("b.txt", "removed", 3, None, None), ("moved.txt", "added", None, 3, "b.txt"), ("new.txt", "added", None, 1, None)}
    assert {tuple(r) for r in snapshots.differences(first, now).collect()} == want
    second = snapshots.take(spark, str(folder), store, "second", "*.txt")
    assert {tuple(r) for r in snapshots.differences(first, second).collect()} == want
    was = {r.path: bytes(r.content).decode() for r in snapshots.read(spark, store, "first").collect()}
    assert was == {"a.txt": "one", "b.txt": "two", "sub/c.txt": "one"}
    assert {r.path for r in snapshots.read(spark, store, "second").collect()} == {"a.txt", "moved.txt", "new.txt", "sub/c.txt"}
    assert spark.read.parquet(f"{store}/contents").count() == 4  # one, two, changed and n
    with pytest.raises(ValueError, match="there is a snapshot"):
        snapshots.take(spark, str(folder), store, "second", "*.txt")
    import hashlib

    assert first.where("path = 'a.txt'").first().digest == hashlib.sha1(b"blob 3\x00one").hexdigest()


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(200_000).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("ts"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.hash("id") % 1000).alias("v"), (F.col("id") % 5000).alias("u"))
    stored = sketches.daily(df, "ts", ["k"], F.col("v"), F.col("u"))
    assert stored.count() == 30  # of 3 keys a day has one
    qs = [0.01, 0.5, 0.99]
    for keys in (["k"], []):
        found = sketches.merged(stored, keys, qs)
        assert all(r.days == (10 if keys else 30) for r in found.collect())
    found = sketches.merged(stored, ["k"], qs)
    held = sketches.rank_errors(df, found, ["k"], F.col("v"), qs).collect()
    assert len(held) == 3 and all(r.rank_error <= sketches.RANK_ERROR for r in held)
    exact = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("u").alias("n")).collect()}
    assert all(abs(r.members - exact[r.k]) <= exact[r.k] * sketches.COUNT_ERROR for r in held)
    wrong = found.withColumn("quantiles", F.transform("quantiles", lambda q: q + 100))
    assert all(r.rank_error > sketches.RANK_ERROR for r in sketches.rank_errors(df, wrong, ["k"], F.col("v"), qs).collect())
    nothing = sketches.merged(sketches.daily(df.withColumn("v", F.lit(None).cast("double")), "ts", ["k"], F.col("v"), F.col("u")), ["k"], qs)
    assert all(r.quantiles is None for r in nothing.collect())


LOGS = {
    "pytest": (["t.py::test_a PASSED", "____ test_b ____", "    def test_b():", ">       assert f() == 2", "E       assert 1 == 2", "", "t.py:4: AssertionError", "==== short test summary ====", "FAILED t.py::test_b"], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 8]),
    "jest": (["PASS a.js", "  ✓ adds", "  ● adds › wrong", "", "    expect(received)", "      at Object.<anonymous> (a.js:3:1)", "Tests: 1 failed"], [2, 3, 4, 5], [2, 3, 4, 5]),
    "go": (["=== RUN   TestA", "--- FAIL: TestA (0.00s)", "    a_test.go:9: got 1", "        want 2", "=== RUN   TestB", "--- PASS: TestB (0.00s)", "panic: boom", "goroutine 1:", "main.f()", "FAIL"], [1, 2, 3, 6, 7, 8], [1, 2, 3, 6, 7, 8, 9]),
    "cargo": (["test a ... ok", "test b ... FAILED", "failures:", "---- b stdout ----", "thread 'b' panicked at src/lib.rs:3:", "left: 1", "note: backtrace", "failures:", "    b", "test result: FAILED. 1 passed"], [3, 4, 5, 6], [1, 3, 4, 5, 6, 9]),
    "junit": (["[INFO] Running A", "[ERROR] a(A)  Time elapsed: 0.1 s  FAILURE!", "java.lang.AssertionError: expected", "\tat A.a(A.java:5)", "\tat B.b(B.java:6)", "[INFO] done"], [1, 2, 3, 4], [1, 2, 3, 4]),
    "gtest": (["[ RUN      ] A.b", "a.cc:5: Failure", "Expected equality", "  1", "  2", "[  FAILED  ] A.b (0 ms)", "[ RUN      ] A.c", "[       OK ] A.c (0 ms)"], [1, 2, 3, 4], [1, 2, 3, 4, 5]),
    "unheard": (["FAIL", "anything"], [], [0, 1]),
}


def test_reports_of_failures_stay_whole(spark):
    rows = [(k, name, i, f"\x1b[31m{line}\x1b[0m" if name == "go" else line) for k, (name, (lines, _, _)) in enumerate(LOGS.items()) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "run_id long, framework string, pos int, line string").repartition(3)
    blocks, left = distill.failure_blocks(df).collect(), distill.failure_digest(df).collect()
    for k, (name, (lines, inside, kept)) in enumerate(LOGS.items()):
        assert sorted(r.pos for r in blocks if r.run_id == k) == inside, name
        assert sorted(r.pos for r in left if r.run_id == k) == kept, name
        assert all(r.line == lines[r.pos] for r in blocks if r.run_id == k)
    assert {(r.pos, r.block) for r in blocks if r.framework == "go"} == {(1, 1), (2, 1), (3, 1), (6, 2), (7, 2), (8, 2)}
    passed = spark.createDataFrame([(1, "go", 0, "=== RUN   A"), (1, "go", 1, "note"), (1, "go", 2, None)], "run_id long, framework string, pos int, line string")
    assert [r.pos for r in distill.failure_digest(passed.where("line is not null")).collect()] == [1]


def test_quantiles_are_exact(spark):
    import numpy as np

    from tidemark.operators import order

    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, 5.0, 5.0, round(r.gauss(0, 9), 2)])) for _ in range(800)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        want = {k: float(np.quantile([v for x, v in rows if x == k and v is not None], q)) for k in ("a", "b", "c", None, "one")}
        assert {x.k: x.quantile for x in order.quantiles(df, ["k"], F.col("v"), q).collect()} == pytest.approx(want)
        whole = order.quantiles(df, [], F.col("v"), q).first().quantile
        assert whole == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], q)))
    assert order.quantiles(df.where("k = 'none'"), ["k"], F.col("v"), 0.5).count() == 0


def test_records_of_declared_schemas(spark, tmp_path):
    from tidemark.sources import readers

    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    history = readers.commits(spark, put("c.jsonl", '{"commit_id":"a1","ts":"2024-01-01T10:00:00","origin":"ai"}', '{"commit_id":', '{"commit_id":"b2","ts":"2024-01-02T10:00:00","origin":"human","more":1}'))
    assert [(r.commit_id, r.origin, r.corrupt) for r in history.orderBy("commit_id").collect()] == [(None, None, '{"commit_id":'), ("a1", "ai", None), ("b2", "human", None)]
    runs = readers.test_runs(spark, put("t.jsonl", '{"ts":"2024-01-01T10:05:00","suite":"s","status":"failed"}', '{"ts":"never","suite":"s","status":"passed"}'))
    assert sorted((r.ts is None, r.corrupt is None) for r in runs.collect()) == [(False, True), (True, False)]
    tools = readers.tool_catalog(spark, put("tools.jsonl", '{"name":"t","descr":"d","schema_json":"{\\"properties\\":{\\"a\\":{\\"type\\":\\"string\\"}}}","essential":true,"tokens":3}'))
    assert tools.select(routing.signature(F.col("name"), F.col("schema_json")).alias("s")).first().s == "t(a?: string)"
    assert readers.commands(spark, put("k.jsonl", '{"cmd":"x","category":"c"}')).first().descr is None
    put("symbols.jsonl", *[f'{{"sym_id":{i},"kind":"f","name":"n{i}","file":"a","line_from":1,"line_to":2,"tokens":5}}' for i in range(4)])
    put("edges.jsonl", '{"src":0,"dst":1}', '{"src":1,"dst":2}', '{"src":2,"dst":9}', "broken")
    symbols, edges = readers.code_graph(spark, str(tmp_path))
    assert symbols.count() == 4 and {r.node: r.depth for r in graph.closure(edges, spark.createDataFrame([(0,)], "node long"), 5).collect()} == {0: 0, 1: 1, 2: 2}


def test_contexts_by_mode(spark):
    from tidemark.operators import prefix

    requests = spark.createDataFrame([(1, "q"), (2, "q"), (3, None)], "request_id long, text string")
    parts = spark.createDataFrame([(1, "workspace", "b", "bbbb", True), (1, "workspace", "a", "aaaa", False), (1, "selection", "z", "zzzz", True), (2, "workspace", "a", "x" * 40, True)], "request_id long, kind string, name string, text string, saved boolean")
    of = lambda *a, **k: {r.request_id: (r.context, r.context_tokens) for r in prefix.contextual(requests, parts, *a, **k).collect()}
    assert of("none") == {1: ("", 0), 2: ("", 0), 3: ("", 0)}
    assert of("selection")[1] == ("zzzz", 1) and of("automatic")[1] == ("zzzz\nbbbb", 2)
    assert of("automatic", True)[1] == ("zzzz\naaaa\nbbbb", 3) and of("automatic", True, 2)[1] == ("zzzz\naaaa", 2)
    assert of("automatic", most_tokens=9)[2] == ("", 0)
    with pytest.raises(ValueError, match="none of"):
        prefix.contextual(requests, parts, "all")
    packed = prefix.contextual(requests, parts, "none")
    known = packed.where("request_id = 1").select(F.sha2(F.concat_ws("\u0000", "text", "context"), 256).alias("digest"), F.lit("old").alias("answer"))
    assert {r.request_id: r.answer for r in prefix.answered(packed, known, True).collect()} == {1: "old", 2: "old", 3: None}
    assert {r.answer for r in prefix.answered(packed, known, False).collect()} == {None}
