import random
from collections import Counter

import numpy as np

from tidemark.llm import near_dup
from tidemark.llm.near_dup import Weights, components, keep_one_of_each, near_duplicates, samples, shingles, similarities, similarity, spanning_links, word_codes, word_weights


def make_texts(rng, n=120):
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randint(1, 150))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = base[:]
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other) + " !")
    return texts


def of(df, n):
    words = sorted(df)
    return Weights.of(word_codes(words)[0], np.array([df[w] for w in words]), n)


def brute(texts):
    """Class of each text, by comparing all pairs exactly."""
    df = Counter(w for t in texts for w in set(t.encode().translate(near_dup.FOLD).split()))
    weights = of(df, len(texts))
    sets = [shingles([t.encode()], weights)[1:] for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    close = []
    for i in range(len(texts)):
        for j in range(i):
            s = similarity(sets[i], sets[j])
            if 0.77 < s < 0.8:
                close.append((i, j))
            if s >= 0.8 or texts[i] == texts[j]:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_classes_against_all_pairs(spark, docs):
    texts = make_texts(random.Random(7))
    want = brute(texts)
    found = {r.doc_id: r.class_id for r in near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert sum(found[i] == want[i] for i in range(len(texts))) >= 0.99 * len(texts)
    assert len(set(want)) < len(texts) - 30


def test_word_counts_cover_all_rows(spark, docs, odd_rows):
    texts = make_texts(random.Random(5), 60)
    df = Counter(w for t in texts for w in set(t.encode().translate(near_dup.FOLD).split()))
    ours, want = word_weights(docs(list(enumerate(texts))).repartition(5)), of(df, len(texts))
    codes = word_codes(sorted(df))[0]
    assert np.allclose(ours(codes), want(codes))
    exact = np.log((len(texts) + 1) / (np.array([df[w] for w in sorted(df)]) + 1))
    assert np.allclose(ours(codes), exact, atol=1e-5)


def test_samples_agree_as_similarity_says():
    rng = random.Random(1)
    weights = of({b"w%d" % i: i + 1 for i in range(400)}, 500)
    for share in (0.05, 0.2):
        agreed = exact = 0
        for _ in range(40):
            a = rng.choices(["w%d" % i for i in range(400)], k=200)
            b = [rng.choice(["w%d" % i for i in range(400)]) if rng.random() < share / 5 else w for w in a]
            x, y = (shingles([" ".join(t).encode()], weights) for t in (a, b))
            exact += similarity(x[1:], y[1:])
            agreed += float((samples(*x)[1] == samples(*y)[1]).mean())
        assert abs(agreed - exact) / 40 < 0.03


def test_blocks_find_what_one_block_finds(spark, docs, monkeypatch):
    rng = random.Random(9)
    base = rng.choices(["w%d" % i for i in range(300)], k=120)
    texts = []
    for _ in range(90):
        other = base[:]
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(120)] = rng.choice(["w%d" % i for i in range(300)])
        texts.append(" ".join(other))
    df = docs(list(enumerate(texts)))
    whole = sorted(map(tuple, near_duplicates(df).collect()))
    monkeypatch.setattr(near_dup, "TOGETHER", 8)
    assert sorted(map(tuple, near_duplicates(df).collect())) == whole


def test_odd_rows(spark, docs, odd_rows):
    found = near_duplicates(docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by = Counter((r.doc_id, r.class_id) for r in found)
    assert by[4, 4] == 2 and by[5, 4] == 1 and by[1, 1] == 1 and by[6, 6] == 1
    assert near_duplicates(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in edges], "a binary, b binary")
    found = {int(bytes(r.node)): int(bytes(r.root)) for r in components(df).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(50):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == root


def test_spanning_links_join_what_all_pairs_join():
    rng = random.Random(2)
    texts = [t.encode() for t in make_texts(rng, 25)]
    weights = of(Counter(w for t in texts for w in set(t.translate(near_dup.FOLD).split())), len(texts))
    sketches, n = np.zeros((len(texts), near_dup.SAMPLES), np.uint8), len(texts)
    sets = [shingles([t], weights)[1:] for t in texts]
    for sides in (np.zeros(n, int), np.arange(n) % 2):
        links = spanning_links(sketches, sides, np.arange(n), texts, weights, 0.8)
        assert all(similarity(sets[x], sets[y]) >= 0.8 for x, y in links) and len(links) < n
        ours, want = list(range(n)), list(range(n))
        across = sides[0] != sides[-1]
        for root, pairs in ((ours, links), (want, [(i, j) for i in range(n) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8 and (not across or sides[i] != sides[j])])):
            for x, y in pairs:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root[:] = [new if r == old else r for r in root]
        assert ours == want
    for k in range(n):
        a, b = dict(zip(*sets[0], strict=True)), dict(zip(*sets[k], strict=True))
        both = sum(min(a[c], b[c]) for c in a if c in b)
        assert abs(similarities(sets[0], sets)[k] - both / max(1e-9, sum(a.values()) + sum(b.values()) - both)) < 1e-5


def test_unspaced_scripts(spark, docs):
    rng = random.Random(4)
    base = [chr(0x4E00 + rng.randrange(3000)) for _ in range(320)]
    other = base[:]
    other[150] = "山"
    mixed = "abc山def".encode()
    assert len(word_codes([mixed])[0]) == 3 and len(word_codes(["ab cd".encode(), "山水".encode()])[0]) == 4
    rows = [(1, "".join(base)), (2, "".join(other)), (3, "".join(rng.sample(base, 320)))]
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(docs(rows)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_rows_that_stay(spark, docs, odd_rows):
    df = docs([*odd_rows, (4, "Same text, here!"), (3, "same text here"), (None, "same text here")])
    kept = sorted(str((r.doc_id, r.text)) for r in keep_one_of_each(df).collect())
    gone = {"same text here", "Same text, here!"}
    assert kept == sorted(str(r) for r in [*[r for r in odd_rows if r[1] not in gone], (3, "same text here")])
    assert keep_one_of_each(df).columns == df.columns and keep_one_of_each(df.limit(0)).count() == 0


def test_versions_that_hang_on_few_pairs(spark, docs):
    rng = random.Random(1)
    first = ["w%d" % rng.randrange(4000) for _ in range(1500)]
    second = first[:]
    for k in range(13):
        second[20 + 105 * k] = "v%d" % k
    texts = []
    for base, nearer in ((first, 3), (second, 0)):
        for i in range(50):
            other = base[:]
            other[rng.randrange(12)] = "x%d" % rng.randrange(4000)
            for k in rng.sample(range(13), 1 if i < nearer else 0):
                other[20 + 105 * k] = second[20 + 105 * k]
            texts.append(" ".join(other))
    want = brute(texts)
    found = {r.doc_id: r.class_id for r in near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert set(want) == {0} and set(found.values()) == {0}
