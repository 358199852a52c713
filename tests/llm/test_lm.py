import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.lm import CLASSES, Network, Subwords, position_bias, score_texts, train, windows, words_of

VOCABULARY = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 150)


def base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    end = object()
    counts = Counter(w for i, t in rows if not held(i) for w in [*words_of((t or "").encode()), end])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*words_of((t or "").encode()), end]
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out


def test_base_and_odd_rows(spark, docs, odd_rows, monkeypatch):
    rows = [*odd_rows, *[(100 + i, f"The cat{i % 5} sat on the Mat{i} again") for i in range(60)]]
    for common in (lm.COMMON_WORDS, 3):  # counts that are joined give the same
        monkeypatch.setattr(lm, "COMMON_WORDS", common)
        found = score_texts(docs(rows), *VOCABULARY).collect()
        key = lambda r: (str(r[0]), r[2], round(r[5], 6))
        for a, b in zip(sorted((tuple(r) for r in found), key=key), sorted(base(rows), key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert score_texts(docs([]), *VOCABULARY).count() == 0


def test_each_id_is_scored_once_with_what_came_before():
    lengths = np.array([1, 8, 9, 23, 40])
    ids = np.arange(lengths.sum(), dtype=np.int32)
    before, first, target, place = windows(ids, lengths, -7)
    assert (target.ravel()[place] == ids).all() and len(set(place.tolist())) == len(ids)
    start = 0
    flat = before[:, lm.CONTEXT :].ravel()[place]
    for n in lengths.tolist():
        assert flat[start] == -7 and (flat[start + 1 : start + n] == ids[start : start + n - 1]).all()
        start += n
    assert first.sum() == len(lengths)


def slow_log(net, context, cls):
    """One prediction by plain loops, from the ids before; the last of them asks."""
    e, w = net.w["e"].astype(float), {k: v.astype(float) for k, v in net.w.items()}
    x = [e[net.rank[i]] for i in context]
    q = x[-1] @ w["q"] / math.sqrt(lm.DIM)
    a = np.array([q @ (v @ w["k"]) + w["p"][len(x) - 1 - j] for j, v in enumerate(x)])
    a = np.exp(a - a.max())
    o = sum(p * (v @ w["v"]) for p, v in zip(a / a.sum(), x, strict=True))
    y = np.maximum(0, x[-1] @ w["x"] + w["b"] + o @ w["o"]) @ w["c"] + w["d"]
    return y[cls] - np.log(np.exp(y).sum())


@pytest.mark.parametrize("scale", [1, 40])  # beyond what single precision can exponentiate
def test_batched_attention_equals_plain_loops(scale):
    subwords = Subwords(*VOCABULARY)
    net = train([b"the cat sat on the mat and the dog lay by the door of the house again"] * 3, subwords)
    net.w["q"], net.w["c"] = net.w["q"] * scale, net.w["c"] * scale
    net.prepare()
    ids = np.append(subwords.ids(words_of(b"the dog sat by the mat of the cat and lay on the house door again and again"))[0], subwords.end).astype(np.int32)
    before, first, target, place = windows(ids, np.array([len(ids)]), subwords.end)
    found = net.log_classes(net.rank[before], first, net.cls[target]).ravel()[place]
    stream = [subwords.end, *ids.tolist()]
    for j in range(len(ids)):
        begin = max(0, j // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        assert found[j] == pytest.approx(slow_log(net, stream[begin : j + 1], net.cls[ids[j]]), abs=2e-3 * scale)
    assert position_bias(net.w["p"]).shape == (lm.STRIDE, lm.STRIDE + lm.CONTEXT)


def test_classes_are_a_distribution():
    subwords = Subwords(*VOCABULARY)
    net = train([b"a b c d e f g h"] * 5, subwords)
    net.prepare()
    before = np.zeros((1, lm.CONTEXT + lm.STRIDE), np.int32)
    total = sum(np.exp(net.log_classes(before, np.array([True]), np.full((1, lm.STRIDE), k))) for k in range(CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    counts = lm.IdCounts.of(net, np.random.default_rng(0).integers(0, 3, (CLASSES, subwords.size)), np.array([[97, 98, 5], [97, 99, 2]]))
    for k in (int(net.cls[98]), CLASSES - 1):
        ids = np.flatnonzero(net.cls == k)
        assert np.exp(counts.log(np.full(len(ids), 97, np.int32), ids)).sum() == pytest.approx(1, abs=1e-3)
    assert isinstance(net, Network)


def test_training_helps(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 400)
    subwords = Subwords(*VOCABULARY)
    texts = [b"one two three four five six seven eight nine ten " * 6] * 4
    logs = []
    for data in ([], texts):
        net = train(texts, subwords) if data else train(texts[:0], subwords)
        net.prepare()
        ids = np.append(subwords.ids(words_of(texts[0]))[0], subwords.end).astype(np.int32)
        before, first, target, place = windows(ids, np.array([len(ids)]), subwords.end)
        logs.append(net.log_classes(net.rank[before], first, net.cls[target]).ravel()[place].mean())
    assert logs[1] > -0.5


def test_score_counts_rare_words_as_common_ones(docs, monkeypatch):
    rows = [(i, f"The cat{i % 5} sat on the Mat{i} again and again, unseen{i}") for i in range(60)] + [(60, None), (61, "")]
    score = lambda: {r.doc_id: r.score for r in score_texts(docs(rows), *VOCABULARY).collect()}
    want = score()
    monkeypatch.setattr(lm, "COMMON_WORDS", 3)
    assert score() == pytest.approx(want, rel=1e-9)


def test_numbered_words_have_the_ids_of_words_alone():
    subwords = Subwords(*VOCABULARY)
    split = [words_of(t) for t in ("Der Hund, l\u00e4uft 12345 mal".encode(), b"", "\u3000\u4e2d\u6587 it's \xa0x".encode(), b"\xff\xfe the the")]
    numbers, ids, sizes, at_end = subwords.stream(split)
    want, n = [], []
    for words in split:
        for w in words:
            alone = subwords.encoding.encode_ordinary(" " + w.decode("utf-8", "replace"))
            want, n = want + alone, n + [len(alone)]
        want, n = [*want, subwords.end], [*n, 1]
    assert ids.tolist() == want and sizes.tolist() == n and [*subwords.of] == list(dict.fromkeys(w for words in split for w in words))
    assert np.cumsum([len(words) + 1 for words in split]).tolist() == (at_end + 1).tolist()
    age = subwords.age
    subwords.forget()
    assert subwords.age == age + 1 and subwords.stream(split)[1].tolist() == want and len(numbers) == len(n) - len(split)


def test_rows_outside_the_sample_are_learned_from(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_TEXTS", 1)
    found = []
    of = lm.IdCounts.of
    monkeypatch.setattr(lm.IdCounts, "of", lambda network, *counts: found.append(network) or of(network, *counts))
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    drawn = spark.createDataFrame([(i,) for i in learned], "id long").orderBy(F.xxhash64("id")).first().id
    for text in ("the dog lay by the door of the house", "der Hund lag an der Haust\u00fcr"):
        assert score_texts(docs([(i, "the cat sat on the mat" if i == drawn else text) for i in range(40)]), *VOCABULARY).count() == 40
    one, other = found
    assert all((one.w[k] != other.w[k]).any() for k in one.w if k != "d") and (one.cls != other.cls).any() and (one.rank != other.rank).any()


def test_weights_of_tasks_are_averaged_by_windows(spark):
    subwords = Subwords(*VOCABULARY)
    texts = [" ".join(f"w{i}x{j % 7}" for j in range(30 + i)) for i in range(30)]
    net = train([t.encode() for t in texts[:3]], subwords)
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    whole = lm.gone_over(df, net, *VOCABULARY)
    seen, descent = lm.Windows.of([t.encode() for t in texts], subwords, net), lm.Descent(net)
    for part in np.array_split(np.random.default_rng(7).permutation(len(seen.before)), -(-len(seen.before) // lm.PASS_BATCH)):
        descent.step(seen, part, lm.PASS_RATE)
    assert all(np.allclose(whole.w[k], descent.w[k], atol=1e-4) for k in net.w)
    twice = lm.gone_over(df.union(df), net, *VOCABULARY)  # two tasks of the same rows come to the same
    assert all(np.allclose(whole.w[k], twice.w[k], atol=1e-4) for k in net.w)
    assert lm.gone_over(df.where("text is null"), net, *VOCABULARY) is net


def plain_step(self, seen, pick, rate):
    """One step by formulas taken one by one, without anything put side by side."""
    w, m, s, back = self.w, self.m, self.s, self.back
    self.steps += 1
    scale = np.float32(1 / np.sqrt(lm.DIM))
    xi, yt, ok = seen.before[pick], seen.target[pick].ravel(), seen.real[pick].ravel()
    x = w["e"][xi]
    xq = x[:, lm.CONTEXT:]
    q, k, v = xq @ w["q"], x @ w["k"], x @ w["v"]
    a = q @ k.transpose(0, 2, 1) * scale + position_bias(w["p"])
    a[seen.first[pick], :, :lm.CONTEXT] = lm.FAR
    a = np.exp(a - a.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    o = a @ v
    pre = xq @ w["x"] + o @ w["o"] + w["b"]
    h = np.maximum(pre, 0).reshape(-1, lm.HIDDEN)
    y = h @ w["c"] + w["d"]
    y = np.exp(y - y.max(axis=1, keepdims=True))
    y /= y.sum(axis=1, keepdims=True)
    y[np.arange(len(y)), yt] -= 1
    y[~ok] = 0
    y /= max(1, ok.sum())
    g = {"c": h.T @ y, "d": y.sum(axis=0)}
    dp = ((y @ w["c"].T) * (h > 0)).reshape(pre.shape)
    g["x"], g["o"], g["b"] = xq.reshape(-1, lm.DIM).T @ dp.reshape(-1, lm.HIDDEN), o.reshape(-1, lm.DIM).T @ dp.reshape(-1, lm.HIDDEN), dp.sum(axis=(0, 1))
    do = dp @ w["o"].T
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    dv = a.transpose(0, 2, 1) @ do
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    g["p"] = np.bincount(back.ravel(), weights=ds.sum(axis=0).ravel(), minlength=lm.CONTEXT + lm.STRIDE)
    flat = x.reshape(-1, lm.DIM)
    g["q"], g["k"], g["v"] = xq.reshape(-1, lm.DIM).T @ dq.reshape(-1, lm.DIM), flat.T @ dk.reshape(-1, lm.DIM), flat.T @ dv.reshape(-1, lm.DIM)
    dx = dk @ w["k"].T + dv @ w["v"].T
    dx[:, lm.CONTEXT:] += dp @ w["x"].T + dq @ w["q"].T
    g["e"] = np.zeros_like(w["e"])
    order = np.argsort(xi, axis=None)
    asked = xi.ravel()[order]
    begin = np.flatnonzero(np.diff(asked, prepend=-1))
    g["e"][asked[begin]] = np.add.reduceat(dx.reshape(-1, lm.DIM)[order], begin, axis=0)
    rate *= min(1, self.steps / 50)
    for n in w:
        m[n] = 0.9 * m[n] + 0.1 * g[n]
        s[n] = 0.99 * s[n] + 0.01 * g[n] ** 2
        w[n] = (w[n] - rate * (m[n] / (1 - 0.9**self.steps)) / (np.sqrt(s[n] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)


def started():
    subwords = Subwords(*VOCABULARY)
    texts = [" ".join(f"w{i}x{j % 7} the cat{j * i % 11}" for j in range(30 + i)).encode() for i in range(40)]
    net = train(texts[:5], subwords)
    return net, lm.Windows.of(texts, subwords, net)


@pytest.mark.parametrize("scale", [1, 40])  # beyond what single precision can exponentiate
def test_a_step_equals_plain_formulas(scale):
    net, seen = started()
    net.w = net.w | {"q": net.w["q"] * scale, "c": net.w["c"] * scale}
    one, other = lm.Descent(net), lm.Descent(net)
    for pick in np.random.default_rng(3).integers(0, len(seen.before), (12, 50)):
        one.step(seen, pick, 1e-3)
        plain_step(other, seen, pick, 1e-3)
    for k in net.w:
        # A gradient near zero may turn over by rounding, which Adam makes a whole step of.
        assert one.w[k].dtype == np.float32 and np.mean(np.abs(one.w[k] - other.w[k]) > 2e-4) < 0.002, k
        assert (one.w[k] != net.w[k]).any(), k


def test_a_step_takes_less_than_plain_formulas():
    net, seen = started()
    pick, took = np.resize(np.arange(len(seen.before)), lm.PASS_BATCH), []
    for _ in range(5):
        for k, step in enumerate((lm.Descent.step, plain_step)):
            descent, t = lm.Descent(net), time.thread_time()
            for _ in range(10):
                step(descent, seen, pick, 1e-3)
            took.append((k, time.thread_time() - t))
    assert min(t for k, t in took if k == 0) < 0.85 * min(t for k, t in took if k == 1)


def test_texts_are_read_and_encoded_once(spark, docs):
    """Counting, both trainings and scoring read ids; before, each of them read and encoded the texts anew."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = docs([(i, f"the cat{i % 5} sat on mat{i}") for i in range(70)]).select("doc_id", "text")
    assert score_texts(df.mapInArrow(counted, df.schema), *VOCABULARY).count() == 70
    assert read.value == 70


def test_tokens_of_ids_tell_words_apart_as_bytes_do():
    subwords = Subwords(*VOCABULARY)
    texts = [b"the cat the \xff \xef\xbf\xbd \xfe \xff", b"", "antidisestablishmentarianism\u00e9\u4e2d the !! ! !!! a".encode(), b"supercalifragilisticexpialidocious " * 2 + b"\xff"]
    split = [words_of(t) for t in texts]
    _, ids, sizes, at_end = subwords.stream(split)
    odd = pa.array([[{"at": k, "word": w} for k, w in enumerate(words) if w in (b"\xff", b"\xfe")] or None for words in split], pa.list_(pa.struct([("at", pa.int32()), ("word", pa.binary())])))
    tokens = lm.Tokens.of(ids, np.diff(np.cumsum(sizes)[at_end], prepend=0), odd, lm.begins_of(VOCABULARY[0]))
    assert tokens.sizes.tolist() == sizes.tolist() and tokens.at_end.tolist() == at_end.tolist()
    inner = np.setdiff1d(np.arange(len(sizes)), at_end)
    named = [*zip(tokens.key[inner].tolist(), tokens.words(inner, lm.id_type(subwords.size)).to_pylist(), strict=True)]
    words = [w for x in split for w in x]
    assert len(set(zip(named, words))) == len(set(named)) == len(set(words))
    assert {k > 0 for k, _ in named} == {True, False} and {k for k, w in named if w} == {0, -1}


def test_words_that_are_no_utf8_are_counted_apart(spark):
    texts = [bytes([255, 32, 254]), bytes([255]), b"the", "\ufffd the".encode(), bytes([253]) + b" the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 8)], "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    end = object()
    rows = [(i, [*words_of(t), end]) for i, t in enumerate(texts * 8)]
    counts = Counter(w for i, words in rows for w in words if zlib.crc32(str(i).encode()) % 7 != 2)
    n, v = sum(counts.values()), len(counts)
    for r in score_texts(df, *VOCABULARY).collect():
        words = rows[r.doc_id][1]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)


def test_counts_are_handed_over_whole(monkeypatch):
    monkeypatch.setattr(lm, "AT_ONCE", 50)
    counted, want, found = lm.Counted(20), Counter(), Counter()
    for k in range(40):
        more = np.random.default_rng(k).integers(0, 10 + k, 30)
        want.update(more.tolist())
        for keys, n in counted.add(more):
            assert len(keys) > 20
            found.update(dict(zip(keys.tolist(), n.tolist())))
    keys, n = counted.all()
    found.update(dict(zip(keys.tolist(), n.tolist())))
    assert found == want and len(lm.Counted(20).all()[0]) == 0
