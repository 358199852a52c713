import pytest

#: Extra columns of names that operators might use themselves.
CLASHING = {"id": 1, "n": "x", "key": "k", "node": "n", "row": 2, "host": "h", "bundle": "b", "slot": 3, "score": "s", "word": "w", "words": "w", "group": "g", "h": 4, "size": 5, "sketch": "q", "held_out": "maybe", "block": 7, "item": "i", "path": "p"}


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents (doc_id, text, lang, ...) with clashing extra columns."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {'int' if isinstance(v, int) else 'string'}" for k, v in CLASHING.items())
        rows = [r if len(r) == 3 else (*r, None) for r in rows]
        return spark.createDataFrame([(i, t, lang, "s", None, *CLASHING.values()) for i, t, lang in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a very long text."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (None, "a null id has words too"), (None, None), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, long), (7, "é" * 70_000), (8, "x\x00y\u00a0z ▁ <|endoftext|>")]
