import itertools

import numpy as np
import pytest

from tidemark.llm import langid
from tidemark.llm.langid import identify, label, learn, viterbi

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 300 and sum(r.lang == r.lang_pred for r in found) > 0.98 * len(found)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = rng.normal(0, 3, (1, 6, 3)).astype(np.float32)
        path = viterbi(s, 2.0)[0]
        value = lambda p, s=s: sum(float(s[0, i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=6))), abs=1e-4)


def test_short_cut_equals_viterbi():
    rng = np.random.default_rng(1)
    text = np.repeat(np.arange(40), rng.integers(1, 120, 40))
    scores = np.clip(rng.normal(0, 1.5, (len(text), 4)) + 1.5 * np.eye(4)[(np.arange(len(text)) // 37) % 4], -langid.CLIP, langid.CLIP).astype(np.float32)
    found = label(scores, text)
    for t in range(40):
        own = scores[text == t]
        path = viterbi(own[None])[0]
        value = lambda p, own=own: float(own[np.arange(len(p)), p].sum()) - langid.SWITCH * int((np.diff(p) != 0).sum())
        assert value(found[text == t]) == pytest.approx(value(path), abs=1e-2)


def test_mixed_text_and_scripts(spark, docs):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(train)
    fr, en = (train.where(f"lang = '{x}' and n_chars between 1500 and 4000").first().text for x in ("fr", "en"))
    rows = [(1, fr + " " + en, None), (2, "Привет мир это текст", None), (3, "123 !?", None), (4, None, "fr")]
    found = {r.doc_id: r for r in identify(docs(rows), model, with_spans=True).collect()}
    assert [s.lang for s in found[1].spans] == ["fr", "en"]
    assert abs(found[1].spans[0].stop - len(fr.encode())) < 150
    assert found[2].score == 0.0 and found[2].lang_pred in model.langs
    assert (found[3].lang_pred, found[3].score, found[4].lang_pred) == ("und", 0.0, "und")


def test_odd_rows(spark, docs, odd_rows):
    found = identify(docs([(i, t, "en") for i, t in odd_rows])).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in identify(docs(odd_rows)).collect()} == {"und"}  # nothing to learn from
    assert identify(docs([])).count() == 0


def test_letters_by_category(spark, docs):
    model = learn(spark.read.parquet(f"{SF}/documents.parquet"))
    signs = ["🎉🎉", "。。", "×÷", "٠١٢", "— “” …", "́̂", "①②", "१२", "�", "123"]
    letters = ["ＡＢＣ", "ª", "µ", "ⵜⴰⵎⴰ", "ǅ", "ｶﾅ", "हिन्दी", "x", "𝒜𝒷", "ა"]
    rows = [(i, t, None) for i, t in enumerate(signs + letters)]
    found = {r.doc_id: r.lang_pred for r in identify(docs(rows), model).collect()}
    assert {i for i, x in found.items() if x == "und"} == set(range(len(signs)))


def test_words_and_scores_against_plain_python(spark):
    import unicodedata

    train = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    model = learn(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in train], "doc_id long, text string, lang string"))
    text = "Été 12 naïve—word ÿ ÄÖ x𝒜y Über東京 áb don't"
    words = langid.cut([text.encode()], np.zeros(1, np.int64))
    low = "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" else c for c in text)
    want = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low).split()
    raw = text.encode()
    assert [raw[a:b].decode().lower() for a, b in zip(words.first, words.stop, strict=True)] == [w.lower() for w in want]
    # Scores: sums of log frequencies of the n-grams that begin in the word, counted in plain loops.
    size, counts = 1 << langid.BITS, {}
    slot = lambda g: (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS)

    for r in train:
        ws = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in "".join(c.lower() if c < "\x80" or "À" <= c <= "Þ" else c for c in r.text)).encode()
        line = b" " + ws.replace(b"\t", b" ") + b" " * 8
        table = counts.setdefault(r.lang, np.zeros((len(langid.ORDERS), size)))
        for i in range(1, len(line) - 8):
            if line[i] != 32:
                for k, n in enumerate(langid.ORDERS):
                    table[k, slot(line[i - 1 : i - 1 + n])] += 1
    logs = {lang: np.log((t + 0.2) / (t.sum(axis=1, keepdims=True) + 0.2 * size)) for lang, t in counts.items()}
    mine = np.stack([np.log((t + 0.2) / (t.sum(axis=1, keepdims=True) + 0.2 * size)) for _, t in sorted(counts.items())], axis=2)
    assert sorted(logs) == model.langs
    for k in range(len(langid.ORDERS)):
        close = np.isclose(model.tables[k], mine[k], atol=1e-3)  # all but n-grams across the ends of texts
        assert close.mean() > 0.998
