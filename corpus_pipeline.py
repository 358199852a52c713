"""A corpus cleaned in five stages, each by one operator over all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import shared_dir, table
from tidemark.llm.decontam import without_items
from tidemark.llm.langid import keep_identified
from tidemark.llm.near_dup import keep_one_of_each
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that have no letters, or most of whose letters are in no learned language.

    Null, empty and blank texts have no letters and go. Rows are judged one by one: null and repeated ids don't matter.
    """
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose posterior quality is low or that fail the base.

    Null and empty texts have under 20 words and go. Rows are judged one by one: null and repeated ids don't matter.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near duplicates one row of the least id.

    Rows of null text stay; a text without an id stays unless it is like one with an id; of rows of equal id and text one stays.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark. Null and empty texts hold none; rows are judged one by one."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with a proof that they decode to its text. Null texts have no pieces; repeated rows give repeated results."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Near duplicates, EM and trained models aren't expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
