"""Token counts of whole texts without their token ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw_texts, runs_by_size

#: Distinct pre-tokens that a worker remembers; beyond that it starts anew, which only costs time.
REMEMBERED = 1_000_000
#: Bytes of text whose pre-token frequencies a worker holds at once.
AT_ONCE = 4_000_000


class PieceCounts:
    """Pieces of each distinct pre-token, counted once.

    A pre-token is a run of bytes without ASCII white space. The tokenizer drops white space and
    no piece, special string or normalisation step reaches across it, so a text's count is the
    sum over its pre-tokens.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        new = [w for w in words if w not in self.pieces]
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.pieces.update((w, len(e)) for w, e in zip(part, found, strict=True))

    def of(self, texts: list[bytes | None]) -> list[int]:
        counts: list[int] = []
        for a, b in runs_by_size([len(t or b"") for t in texts], AT_ONCE):
            frequencies = [Counter((t or b"").split()) for t in texts[a:b]]
            self.learn(set().union(*frequencies))
            pieces = self.pieces
            counts += [sum(n * pieces[w] for w, n in f.items()) for f in frequencies]
        return counts


_LOADED: dict[str, PieceCounts] = {}


def _counter(path: str) -> PieceCounts:
    """A worker's own, which outlives a task, so a pre-token is counted once by each worker and not once by each task."""
    if path not in _LOADED:
        _LOADED[path] = PieceCounts(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Each worker counts the pieces of every distinct pre-token once, and joins those counts to the
    pre-token frequencies of each document; ids are never kept. Frequencies of a document are
    complete within its row, so nothing is shuffled, whatever the skew. A null text counts as
    empty (0 bytes, 0 tokens), as does one of white space only (0 tokens); a null id stays null;
    repeated rows give repeated results; other columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts = raw_texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counter.of(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
