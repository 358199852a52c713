import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontam
from tidemark.llm.decontam import EDITS, Items, banded_distance, contaminated, squash


def least_edits(item, text):
    """Edits between item and its best stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, item, n):
    out = list(item)
    for _ in range(n):
        k, p = rng.choice("sid"), rng.randrange(len(out))
        if k == "s":
            out[p] = rng.choice("abcdefg")
        elif k == "i":
            out.insert(p, rng.choice("abcdefg"))
        elif len(out) > 1:
            del out[p]
    return "".join(out)


def test_no_occurrence_within_the_budget_is_missed():
    rng = random.Random(11)
    items = {i: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(60, 300))) for i in range(30)}
    table = Items([(i, t.encode()) for i, t in items.items()])
    edits = {k: int(e) for (k, _), e in zip(table.items, table.edits, strict=True)}
    texts, planted = [], []
    for i, t in items.items():
        for share in (0.0, 0.5, 1.0):
            noise = ["".join(rng.choices("abcdefghijklmnop ,", k=rng.randint(0, 400))) for _ in range(2)]
            middle = edited(rng, t, int(share * edits[i]))
            planted.append((len(texts), i))
            texts.append(noise[0] + middle.upper() + noise[1])
    found = {(t, k): e for t, k, e, _, _ in table.find([t.encode() for t in texts])}
    for t, i in planted:
        want = least_edits(items[i], squash(texts[t].encode()).decode())
        assert want > edits[i] or found[t, i] == want
    for (t, i), e in found.items():
        assert least_edits(items[i], squash(texts[t].encode()).decode()) == e


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40), st.integers(0, 6))
def test_banded_distance(item, text, most):
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (item, text))
    assert banded_distance(a, b, -len(item), len(text), most)[0] == min(least_edits(item, text), most + 1)


def test_rows_blocks_and_short_items(spark, docs, odd_rows, monkeypatch):
    item = "The first item, which is long enough to be found with edits; and É."
    items = [(1, item), (2, None), (3, " .!"), (4, "Tiny q"), (5, item), (None, "an item without an id that occurs nowhere at all")]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    rows = [*odd_rows, (20, "before " + item.upper().replace(" ", "\n") + " after"), (21, "a tinyq b"), (20, "before " + item + " after")]
    found = contaminated(docs(rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in found) == [(20, 1, 0), (20, 1, 0), (20, 5, 0), (20, 5, 0), (21, 4, 0)]
    text = ("before " + item + " after").encode()
    assert {text[r.first : r.stop].decode() for r in found if r.item_id == 1} >= {item[:-1]}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert sorted(map(str, contaminated(docs(rows), benchmark).collect())) == sorted(map(str, found))
    assert contaminated(docs([]), benchmark).count() == 0 and contaminated(docs(rows), benchmark.limit(0)).count() == 0


def test_budget():
    table = Items([(1, b"x" * 200)])
    assert table.edits[0] == int(200 * EDITS) and table.shared[0] == 200 + 1 - 7 * (table.edits[0] + 1)


def test_item_ids_of_other_types(spark, docs):
    text = "the quick brown fox jumps over the lazy dog near the old river bank"
    for kind in ("double", "date", "decimal(10,2)", "smallint", "string"):
        items = spark.sql(f"select cast({'current_date' if kind == 'date' else '7'} as {kind}) as item_id, '{text}' as text union all select null, '{text} again and again until evening'")
        found = contaminated(docs([(1, f"before {text} after"), (None, text)]), items)
        assert dict(found.dtypes)["item_id"] == kind and found.where("item_id is not null").count() == 2
