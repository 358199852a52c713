import random
import subprocess
import sys

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pieces import Pieces, combine, encode_pieces, model_form, settle

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, OURS = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(PATH)
ALPHABET = "ab  ▁\n\té日🎉xyzthein1234<>."


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=80) | st.text(max_size=30))
def test_like_the_library_and_back(text):
    ids = np.frombuffer(OURS.encode([text])[0], "<i4").tolist()
    assert ids == LIBRARY.encode(text)
    assert OURS.decode(ids) == text.replace("▁", " ").encode("utf-8")


def matrices(text, chunk, context=32):
    form = model_form(text)
    out, parts = [], []
    for k in range((len(form) - 1) // chunk + 1):
        base = max(k * chunk - context, 0)
        part, right = form[base : base + chunk + 2 * context], min((k + 1) * chunk, len(form))
        a, b, m = OURS.transfer(part, k * chunk - base, right - base, base, k == 0)
        out.append((a, b, np.array(m)))
        parts.append((part, base))
    return out, parts


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), min_size=1, max_size=300), st.integers(16, 60))
def test_chunked_scan(text, chunk):
    found, parts = matrices(text, chunk)
    states = settle(found)
    ids = [i for k, (part, base) in enumerate(parts) for i in OURS.trace(part, base, states[k], states[k + 1])]
    assert ids == LIBRARY.encode(text)


def test_matrices_combine_in_any_order():
    found, _ = matrices("".join(random.Random(4).choices(ALPHABET, k=200)), 40)
    a, b, c = found[:3]
    left, right = combine(combine(a, b), c), combine(a, combine(b, c))
    assert left[:2] == right[:2] and (left[2] == right[2]).all()


def test_rows_with_giants(spark, docs, odd_rows):
    rows = [*odd_rows, (9, "ab" * 900), (9, "ab" * 900), (10, " " * 700), (11, "the quick brown fox " * 60)]
    found = encode_pieces(docs(rows), PATH, giant=600, chunk=128).collect()
    assert sorted(str((r.doc_id, r.n_tokens, list(r.ids), r.decodes)) for r in found) == sorted(str((i, len(x := LIBRARY.encode(t or "")), x, True)) for i, t in rows)
    assert encode_pieces(docs([]), PATH).count() == 0


GROWTH = """
import random, resource, sys
from tidemark.llm import pieces as P
ours, rng = P.Pieces(sys.argv[1]), random.Random(3)
texts = [" ".join(f"{rng.getrandbits(28):x}" for _ in range(250)) for _ in range(3_000)]
ours.encode(texts[:1])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
for a, b in P.runs_by_size([len(t) for t in texts], P.AT_ONCE):
    ours.encode(texts[a:b])
print(peak() - before)
"""


def test_a_worker_that_meets_ever_new_words_stays_small():
    out = subprocess.run([sys.executable, "-c", GROWTH, PATH], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 90, "MB"
