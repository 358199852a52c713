"""Exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import redact, without_folders


def stamped(df: DataFrame) -> DataFrame:
    """Each row as JSON with its SHA-256."""
    record = F.to_json(F.struct(*df.columns))
    return df.select(record.alias("record"), F.sha2(record, 256).alias("sha256"))


def export_audit(df: DataFrame, path: str) -> None:
    stamped(df).write.mode("errorifexists").json(path)


def export_html(df: DataFrame, path: str) -> None:
    """Rows of an HTML table, each with its stamp."""
    from tidemark.functions.text import html_escape

    stamped(df).select(F.concat(F.lit("<tr><td>"), html_escape(F.col("record")), F.lit("</td><td>"), "sha256", F.lit("</td></tr>")).alias("value")).write.mode("errorifexists").text(path)


def export_diagnostics(df: DataFrame, path: str, text_cols: list[str], path_cols: list[str]) -> None:
    """A log without secrets and folders."""
    df.withColumns({c: redact(F.col(c)) for c in text_cols} | {c: without_folders(F.col(c)) for c in path_cols}).write.mode("errorifexists").json(path)


def export_ledger(df: DataFrame, path: str, reset: bool = False) -> None:
    """``reset`` is the caller's confirmation that what is there may go."""
    df.write.mode("overwrite" if reset else "errorifexists").parquet(path)


def export_handoff(df: DataFrame, path: str) -> None:
    """Markdown of operators.prefix.handoff, one file line each."""
    df.select(F.col("markdown").alias("value")).write.mode("errorifexists").text(path)
