"""Stable prefixes of prompts: order, quantisation, digests and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import cached_part, padding
from tidemark.functions.text import blob_sha1, neutralize, redact, token_estimate
from tidemark.operators.graph import levels
from tidemark.operators.order import placed


def quantized(df: DataFrame, tokens: Column, chunks: dict[str, int]) -> DataFrame:
    """One row per row and provider kind: tokens to pad, tokens after padding, and those that a cache of whole chunks holds."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("provider"), F.lit(c).cast("bigint").alias("chunk")) for k, c in sorted(chunks.items())]))
    base = df.withColumn("tokens", tokens.cast("bigint")).select("*", kinds.alias("_k")).select(*df.columns, "tokens", "_k.provider", "_k.chunk")
    return base.withColumn("pad", padding(F.col("tokens"), F.col("chunk"))).withColumn("aligned", F.col("tokens") + F.col("pad")).withColumn("cached", cached_part(F.col("tokens"), F.col("chunk")))


def topological(files: DataFrame, edges: DataFrame, depth: int = 32) -> DataFrame:
    """Files (id, text) in an order that depends on content alone: level in the dependency graph, then digest, then id."""
    with_level = files.join(levels(edges, depth), files["id"] == F.col("node"), "left").select(*files.columns, F.coalesce("level", F.lit(0)).alias("level"), blob_sha1(F.col("text")).alias("digest"))
    return placed(with_level, [F.asc("level"), F.asc("digest"), F.asc("id")])


def prefix_digest(ordered: DataFrame) -> DataFrame:
    """SHA-256 over the digests in place order; the same for any order of the input."""
    return ordered.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])), 256).alias("digest"))


def layered(parts: DataFrame, key: str) -> DataFrame:
    """Prompts from parts (key, tier, name, text): tiers rise, names go A to Z in each."""
    ordered = F.array_sort(F.collect_list(F.struct("tier", "name", "text")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("prompt"))


def neutralized(df: DataFrame, text: Column) -> DataFrame:
    """The text with volatile parts replaced, and whether any was."""
    return df.withColumn("stable", neutralize(text)).withColumn("changed", F.col("stable") != text)


def reused(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Whether an equal text came before, by digest and a total order."""
    return df.withColumn("digest", F.sha2(text, 256)).withColumn("reused", F.row_number().over(W.partitionBy("digest").orderBy(*order)) > 1)


def demoted(edits: DataFrame, last_edit: str, turn: Column, after: int) -> DataFrame:
    """Tier 3 for targets edited in the last ``after`` turns, else 1."""
    return edits.withColumn("tier", F.when(turn - F.col(last_edit) <= after, 3).otherwise(1))


def handoff(turns: DataFrame, last: int = 6, most_chars: int = 4000, key: str = "conv_id") -> DataFrame:
    """Markdown of each conversation's last turns, redacted and cut to ``most_chars``."""
    recent = turns.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("turn"), "role", "text"))).where(F.col("_n") <= last)
    line = F.concat(F.lit("- **"), F.col("role"), F.lit("**: "), redact(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("_n"), line.alias("line"))))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.left(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit(most_chars)).alias("markdown"))


#: Which kinds of text a request may take along: what is selected, the workspace's, and buffers that aren't saved.
CONTEXTS = {"none": [], "selection": ["selection"], "automatic": ["selection", "workspace"]}


def contextual(requests: DataFrame, parts: DataFrame, context: str, unsaved: bool = False, most_tokens: int | None = None, key: str = "request_id") -> DataFrame:
    """Requests (key, text) with what goes along of parts (key, kind, name, text, saved): by mode, without unsaved buffers unless asked for, and within a budget.

    Selections go before the workspace and names A to Z; the longest beginning that stays within ``most_tokens`` is taken. Requests without any have an empty context.
    """
    if context not in CONTEXTS:
        raise ValueError(f"context {context!r} is none of {tuple(CONTEXTS)}")
    kinds = CONTEXTS[context]
    wanted = parts.where(F.col("kind").isin(*kinds) if kinds else F.lit(False)).where(F.lit(True) if unsaved else F.coalesce("saved", F.lit(False)))
    order = W.partitionBy(key).orderBy("kind", "name", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    spent = wanted.withColumn("_spent", F.sum(token_estimate(F.col("text"))).over(order))
    within = spent if most_tokens is None else spent.where(F.col("_spent") <= most_tokens)
    ordered = F.array_sort(F.collect_list(F.struct("kind", "name", "text")))
    packed = within.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("context"), F.max("_spent").alias("tokens"))
    joined = requests.join(packed, key, "left")
    return joined.select(*requests.columns, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("tokens", F.lit(0)).alias("context_tokens"))


def answered(requests: DataFrame, answers: DataFrame, reuse: bool, key: str = "request_id") -> DataFrame:
    """Requests (key, text, context) with the answer that an equal one has had, of answers (digest, answer), if ``reuse``; null where there is none."""
    digest = F.sha2(F.concat_ws("\u0000", "text", "context"), 256)
    if not reuse:
        return requests.withColumn("answer", F.lit(None).cast("string"))
    known = answers.groupBy("digest").agg(F.min("answer").alias("answer"))
    return requests.withColumn("digest", digest).join(known, "digest", "left").drop("digest")
