import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm.conv_repair import START, Repair, damaged, repair_reports, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, kind int, digest string, again string"
NAME = {"u": "user", "a": "assistant"}


def brute(rows):
    """Cheapest edits of (role, text) rows, over all ways with short runs of insertions."""
    seen, turns = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        turns.append((role, text, not end or (role, text) in seen, end not in tuple(".!?")))
        seen.add((role, text))
    best = None
    runs = [list(itertools.product("ua", repeat=k)) for k in range(3)]
    runs = [r for k in runs for r in k]

    def go(i, cost, audit, letters, lines):
        nonlocal best
        if best and cost > best[0] or not re.fullmatch(r"s?(ua)*u?", letters):
            return
        for run in runs:
            c, a = cost + 2 * len(run), audit + "I" * len(run)
            ls, ln = letters + "".join(run), lines + [f"{NAME[x]}:" for x in run]
            if not re.fullmatch(r"s?(ua)*u?", ls):
                continue
            if i == len(turns):
                if re.fullmatch(r"(s?(ua)+)?", ls) and (best is None or (c, a) < best[:2]):
                    best = (c, a, hashlib.sha256("\n".join(ln).encode()).hexdigest())
                continue
            role, text, forced, cut = turns[i]
            go(i + 1, c + 3, a + "D", ls, ln)
            if not forced:
                if role[:1] in tuple("sua"):
                    go(i + 1, c + cut, a + "K", ls + role[0], [*ln, f"{role}:{text}"])
                for x in "ua":
                    go(i + 1, c + 2 + cut, a + "R", ls + x, [*ln, f"{NAME[x]}:{text}"])

    go(0, 0, "", "", [])
    return best


def reports(spark, rows):
    df = spark.createDataFrame([(*r, 1, "d", "a") for r in rows], SCHEMA)
    return {r.conv_id: r for r in repair_reports(df).collect()}


def some_conversations(n, seed):
    r = random.Random(seed)
    return [[(r.choice(["user", "assistant", "system", "tool", "user"]), r.choice(["a.", "b!", "cut", "", " \n", "d?\t", "e."])) for _ in range(r.randrange(1, 6))] for _ in range(n)]


def test_same_as_brute_force(spark):
    convs = some_conversations(150, 5)
    rows = [(c, t, *x) for c, turns in enumerate(convs) for t, x in enumerate(turns)]
    random.Random(1).shuffle(rows)
    found = reports(spark, rows)
    for c, turns in enumerate(convs):
        assert (found[c].cost, found[c].audit, found[c].repaired_sha256) == brute(turns), turns


def test_counts_and_ties(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 4, "user", " "), (1, 5, "user", "cut"), (1, 9, "user", "a."), (None, None, "user", "q?"), (None, None, None, None), (2, None, "tool", "x."), (3, 0, "", "x.")]
    found = reports(spark, rows)
    assert tuple(found[1])[1:6] == (6, 1, 2, 1, 4)  # turns 0, 4, 5, 9; the third copy comes later, and counts once
    assert found[None].blank == 1 and found[None].audit == brute([(" ", " "), ("user", "q?")])[1]
    assert (found[2].cost, found[2].audit) == (3, "D") and (found[3].cost, found[3].audit) == (3, "D")
    assert found[2].gaps == 0 and found[2].repaired_sha256 == hashlib.sha256().hexdigest()


def test_long_conversations_are_decided_as_they_come(spark):
    r = random.Random(9)
    turns = [(r.choice(["user", "assistant", "user", "tool"]), f"{i}{r.choice('.!x')}") for i in range(3000)]
    rows = [(1, i, *x) for i, x in enumerate(turns)] + [(2, i, "user", f"{i}.") for i in range(2000)] + [(3, 0, "user", "é" * 300_000)]
    df = spark.createDataFrame([(*x, 1, "d", "a") for x in rows], SCHEMA)
    found = {x.conv_id: x for x in repair_reports(df).collect()}
    # the same program without pruning, letting nothing go before the end
    best = {0: (0, "")}
    for role, text in turns:
        new = {}
        for s, (cost, audit) in best.items():
            for run in range(3):
                now = s if run == 0 else {(0, 1): 2, (3, 1): 2, (2, 1): 3, (0, 2): 3, (3, 2): 3, (2, 2): 2}[s, run]
                cut = text[-1] == "x"
                ways = [("D", now, 3)] + ([("K", 2, cut)] if role == "user" and now != 2 else []) + ([("K", 3, cut)] if role == "assistant" and now == 2 else []) + [("R", 3 if now == 2 else 2, 2 + cut)]
                for op, to, c in ways:
                    way = (cost + 2 * run + c, audit + "I" * run + op)
                    new[to] = min(new.get(to, way), way)
        best = new
    want = min((c + 2 * (s == 2), a + "I" * (s == 2)) for s, (c, a) in best.items())
    assert (found[1].cost, found[1].audit) == want
    assert found[2].cost == 2 * 2000 - 2000 and set(found[2].audit) <= set("KRI")
    out = repaired_turns(df)
    for c in (1, 2, 3):
        lines = [f"{x.role}:{x.text}" for x in out.where(f"conv_id = {c}").orderBy("place").collect()]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == found[c].repaired_sha256


def test_few_layers_differ():
    repair, layer, r = Repair(), START, random.Random(4)
    for _ in range(20_000):
        layer, _, _ = repair.step(layer, r.choice(["s", "u", "a", "t", ""]), r.random() < 0.2, r.random() < 0.3)
    assert len({k[0] for k in repair.known}) < 200


@pytest.mark.parametrize("rows", [[], [(1, 2, None, None)]])
def test_no_turns(spark, rows):
    df = spark.createDataFrame([(*r, 1, "d", "a") for r in rows], SCHEMA)
    got = repair_reports(df.where("turn < 0"), df.select("conv_id")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())][: len(rows)]


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 1, 2) for t in (None, *range(60))]
    df = spark.createDataFrame([(*r, 1, "d", "a") for r in rows], SCHEMA)
    got = sorted(map(tuple, damaged(df).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if k == 0 else [(c, t, "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 else text)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=str)
