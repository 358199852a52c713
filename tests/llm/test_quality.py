import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.quality import RULES, fit, judge_quality, keep_good, posterior


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def random_texts(rng, n):
    out = []
    for _ in range(n):
        words = rng.choices(["a", "b", "cc", "#d", "é!", "x\u00a0y"], k=rng.randint(0, 60))
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for w in words) + (" ".join(words) if rng.random() < 0.3 else ""))
    return out


def test_counts_against_brute_force(spark, docs, odd_rows):
    rows = odd_rows + list(enumerate(random_texts(random.Random(1), 200), 100))
    found = judge_quality(docs(rows)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found) == sorted(str((i, *counts(t))) for i, t in rows)
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in found)
    assert judge_quality(docs([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.tuples(*[st.sampled_from([-1, 0, 1])] * len(RULES)), st.integers(1, 1000)), max_size=20))
def test_votes_never_count_against_their_meaning(patterns):
    right = fit(patterns)
    assert 0.42 < right[0] < 0.93
    nothing = (-1,) * len(RULES)
    for r in range(len(RULES)):
        one = lambda v, r=r: tuple(v if k == r else -1 for k in range(len(RULES)))
        assert posterior(one(0), *right) < posterior(nothing, *right) + 1e-12 and posterior(nothing, *right) <= posterior(one(1), *right) + 1e-12


def brute_posteriors(table):
    """EM document by document, in plain loops: what ``fit`` must come to over counted patterns."""
    share, good, bad = 0.85, [0.9] * len(RULES), [0.9] * len(RULES)
    odds = lambda p: p / (1 - p)

    def of(votes):
        x = odds(share)
        for r, v in enumerate(votes):
            x *= odds(good[r]) / odds(share) if v == 1 else 1 / odds(bad[r]) / odds(share) if v == 0 else 1
        return x / (1 + x)

    for _ in range(60):
        p = [of(votes) for votes in table]
        share = (0.85 * len(table) + sum(p)) / (2 * len(table))
        for r in range(len(RULES)):
            yes, no = [x for x, v in zip(p, table, strict=True) if v[r] == 1], [1 - x for x, v in zip(p, table, strict=True) if v[r] == 0]
            good[r] = min(0.995, max(share, (18 + sum(yes)) / (20 + len(yes))))
            bad[r] = min(0.995, max(0.6, 1 - share, (18 + sum(no)) / (20 + len(no))))
    return [of(votes) for votes in table]


def test_fit_against_plain_loops():
    rng = random.Random(3)
    table = [tuple(rng.choice([-1, -1, 0, 1]) if rng.random() < 0.4 else -1 for _ in RULES) for _ in range(300)]
    counted = {v: table.count(v) for v in table}
    right = fit(sorted(counted.items()))
    for votes, want in zip(table, brute_posteriors(table), strict=True):
        assert abs(posterior(votes, *right) - want) < 1e-6


def test_rows_are_kept_one_by_one(spark, docs):
    good, bad = " ".join("".join(chr(97 + (7 * i + 3 * k) % 26) for k in range(3 + i % 7)) for i in range(60)), "short"
    kept = keep_good(docs([(1, good), (1, bad), (None, good), (None, bad), (2, None)]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and kept.columns == docs([]).columns


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.good) for r in found) > 0.98 * len(found)


def test_no_python_in_the_plan(spark, docs):
    plan = judge_quality(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
