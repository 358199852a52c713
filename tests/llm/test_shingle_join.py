import random

import numpy as np
import pytest

from tidemark.llm.shingle_join import _members, divide_skip, linked_sets, maybe_similar, merge_skip, parity, prefixes, shingle_classes, shingle_sets

SPACE = " \t\n\v\f\r"


def set_of(text):
    low = (text or "").encode().lower()
    words = low.translate(bytes(32 if chr(b) in SPACE else b for b in range(256))).split(b" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=80):
    """component of each row, by comparing all pairs."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def edited(words, share, r):
    return " ".join(r.choice("xyzvw") * r.randrange(2, 9) if r.random() < share else w for w in words)


def corpus(seed, groups=12, most=9, passage=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    shared = [word() for _ in range(passage)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(3, 120))]
        texts += [edited(base, r.choice([0, 0.01, 0.03, 0.05]), r) for _ in range(r.randrange(1, most))]
        texts.append(" ".join(base + shared))
        texts.append(" ".join(shared + base[:8]))
    r.shuffle(texts)
    return texts


def test_merges_find_what_counting_finds():
    r = random.Random(2)
    for _ in range(300):
        lists = [sorted(r.sample(range(60), r.randrange(1, 50))) for _ in range(r.randrange(1, 25))]
        least = r.randrange(1, 20)
        want = {n: c for n in range(60) if (c := sum(n in x for x in lists)) >= least}
        assert dict(merge_skip(lists, least)) == want
        assert dict(divide_skip(lists, least)) == want


def test_similar_sets_share_a_rare_shingle():
    r = random.Random(6)
    counts = np.array([r.randrange(3) for _ in range(1 << 20)])
    texts = corpus(6)
    sets = [set_of(t) for t in texts]
    text, code = shingle_sets([t.encode() for t in texts])
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(s) for s in sets]
    rare = [set() for _ in texts]
    for t, c in zip(*prefixes(text, code, counts, 80), strict=True):
        rare[t].add(int(c))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                assert rare[i] & rare[j]


def test_links_join_what_all_pairs_join():
    r = random.Random(8)
    for trial in range(60):
        base = r.sample(range(1000), r.randrange(5, 40))
        sets = [np.unique(np.array([x if r.random() < 0.93 else r.randrange(1000) for x in base], np.uint64)) for _ in range(r.randrange(2, 20))] + [np.empty(0, np.uint64)]
        sides = np.array([r.randrange(2) if trial % 2 else 0 for _ in sets])
        root = np.array([r.randrange(len(sets)) if trial % 3 == 0 else k for k in range(len(sets))])

        def classes(links, root=root):
            root = root.copy()
            for i, j in links:
                root[root == root[j]] = root[i]
            return {frozenset(np.flatnonzero(root == x).tolist()) for x in root}

        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (sides.min() == sides.max() or sides[i] != sides[j]) and len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert classes(linked_sets(sets, sides, root)) == classes(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, docs, seed):
    rows = [(i, t) for i, t in enumerate(corpus(seed, 25))]
    found = shingle_classes(docs(rows).repartition(5))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_large_groups_of_unlike_texts(spark, docs):
    """Texts that share most of a passage, so that it is among the rarest that they have, but aren't similar; many blocks."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"q{i % 700}x{k}" for k in range(10 + i % 3)])) for i in range(1500)]
    rows += [(5000 + i, edited(passage * 2, 0.02, r)) for i in range(60)]
    assert sorted(map(tuple, shingle_classes(docs(rows)).collect()), key=str) == brute(rows)


def test_odd_rows(spark, docs, odd_rows):
    rows = [*odd_rows, (20, "A b\vC"), (21, "a B c"), (22, "a b"), (23, "x" * 64 + "ab" + "y" * 62), (24, "x" * 64 + "ba" + "y" * 62)]
    assert sorted(map(tuple, shingle_classes(docs(rows)).collect()), key=str) == [r if r[1] else (r[0], 0, r[0]) for r in brute(rows)]
    assert shingle_classes(docs([])).count() == 0


def test_members_are_texts_that_share_a_shingle(spark):
    r = random.Random(5)
    rows = [(k, f"{k % 25 if k % 25 < 5 else k}-{i}".encode().ljust(16), r.randrange(1, 60)) for k in range(30) for i in range(1 + k % 25 % 4 * (13 if k == 7 else 1))]
    found = _members(spark.createDataFrame(rows + rows[::7], "key long, node binary, n int").repartition(3)).collect()
    groups, want = {}, {}
    for x in found:
        groups.setdefault(x.key, set()).add(bytes(x.node))
    for k, node, _ in rows:
        want.setdefault(k, set()).add(node)
    assert {frozenset(x) for x in groups.values()} == {frozenset(x) for x in want.values() if len(x) > 1}
    assert len(groups) <= sum(len(x) > 1 for x in want.values())


def test_bitmaps_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    for _ in range(200):
        base = r.integers(0, 2**63, int(r.integers(1, 400)), np.uint64)
        other = np.unique(np.where(r.random(len(base)) < r.choice([0.02, 0.1, 0.3]), r.integers(0, 2**63, len(base), np.uint64), base))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        similar = 100 * both >= 80 * (len(base) + len(other) - both)
        found = maybe_similar([len(base), len(other)], [parity(base), parity(other)], np.zeros(2, int), np.arange(2))
        assert found or not similar
    apart = [np.unique(r.integers(0, 2**63, 300, np.uint64)) for _ in range(30)]
    assert maybe_similar([len(x) for x in apart], [parity(x) for x in apart], np.zeros(30, int), np.arange(30)) == []
