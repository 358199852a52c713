import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm.prefix_trie import Louds, from_paths, ordered_steps, prefix_nodes, with_lent_heads

SCHEMA = "conv_id long, turn long, role string, text string, key string, n_convs int, part string"


def brute(rows):
    """Nodes of rebuilt conversations, from a dictionary of beginnings."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: (x[0], x[1], x[2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16]))] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    found = []
    for k, cs in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        found.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]), sum(not children[x] for x in below), saved, sha))
    return sorted(found, key=str)


def nodes_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, "k", 1, "p") for r in rows], SCHEMA)
    found = prefix_nodes(with_lent_heads(ordered_steps(df)), **how)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, found.select(*names).collect()), key=str)


def some_rows(seed, n=40, most=9):
    r = random.Random(seed)
    rows = []
    for c in [*r.sample(range(0, 330), n), -5, -100, -101]:
        for t in range(r.randrange(1, most)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ça va", ""])))
    return rows


@pytest.mark.parametrize("how", [{}, {"shared": 2, "segment": 3}, {"shared": 1, "segment": 1}])
def test_same_as_brute_force(spark, how):
    rows = some_rows(3)
    assert nodes_of(spark, rows, **how) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", None), (7, 3, "user", "x" * 200_000), (7, 3, "user", "x" * 200_000), (8, 0, None, "a"), (8, 0, "", "a"), (307, 0, "user", "far"), (100, 5, "user", ""), (104, 5, "user", "")]
    assert nodes_of(spark, rows, shared=1, segment=2) == brute(rows)
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 0, "user", "lost")]) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "short") for c in range(301, 340)]  # no lender, and one turn, which is borrowed away wherever h > 0
    found = nodes_of(spark, rows)
    assert found == brute(rows) and len(found) == 2
    assert nodes_of(spark, rows, shared=3) == found


def test_long_conversations_and_many_alike(spark):
    long = [(c, t, "user", f"{t % 11}") for c in (5, 6, 205) for t in range(60)]
    many = [(1000 + c, 0, "system", "the same") for c in range(300)]
    assert nodes_of(spark, long + many, shared=20, segment=7) == brute(long + many)


def test_louds_gives_parents_degrees_and_sums():
    digest = lambda *path: hashlib.md5(repr(path).encode()).digest()
    paths = [b"".join(digest(*p[: d + 1]) for d in range(len(p))) for p in [(0, 1, 2), (0, 1, 3), (0, 4), (5,), (0, 1, 2)]]
    trie, end, first = from_paths(paths)
    assert trie.n == 6 and len(trie.bits) == 2  # 13 bits
    parents = trie.parents()
    assert sorted(parents[:2].tolist()) == [0, 0] and trie.degrees().sum() == 4  # all but the two tops
    assert end[0] == end[4] != end[1]
    top = [i for i in range(2) if trie.keys()[i] == digest(0)][0]
    assert trie.up(np.bincount(end, minlength=trie.n))[top] == 4
    assert all(trie.keys()[i] == b"".join(paths)[16 * f : 16 * f + 16] for i, f in enumerate(first.tolist()))
    assert Louds(np.empty(0, np.int64), [], np.empty(0, np.uint64), np.empty(0, np.uint64)).parents().tolist() == []
