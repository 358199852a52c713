import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.token_counts import PieceCounts, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OURS = Tokenizer.from_file(PATH), PieceCounts(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB' \t\n\x0b\x1c\x85\u00a0\u2003sté̈ł日🎉1<|endoftext|>.,"), max_size=60) | st.sampled_from(["<|endoftext|>", "a<|startoftext|> b", "it's they'll"]))
def test_like_the_library(text):
    assert OURS.of([text.encode()]) == [library(text)]


def test_rows(spark, docs, odd_rows):
    found = count_tokens(docs(odd_rows), PATH, 5).collect()
    want = sorted(str((i, len((t or "").encode()), library(t or ""), library(t or "") > 5)) for i, t in odd_rows)
    assert sorted(str(tuple(r)) for r in found) == want
    assert count_tokens(docs([]), PATH).count() == 0
