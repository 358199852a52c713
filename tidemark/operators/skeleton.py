"""Outlines of Python sources: headers of classes and functions without bodies."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outline(source: str) -> str | None:
    """Headers with their first doc line, indented as in the source; None if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[str] = []

    def walk(node: ast.AST, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                word = "class" if isinstance(child, ast.ClassDef) else "async def" if isinstance(child, ast.AsyncFunctionDef) else "def"
                head = ", ".join(map(ast.unparse, child.bases)) if isinstance(child, ast.ClassDef) else ast.unparse(child.args)
                returns = f" -> {ast.unparse(child.returns)}" if getattr(child, "returns", None) else ""
                doc = (ast.get_docstring(child) or "").split("\n")[0]
                out.append("    " * depth + f"{word} {child.name}({head}){returns}: ..." + (f"  # {doc}" if doc else ""))
                walk(child, depth + 1)

    walk(tree, 0)
    return "\n".join(out)


def symbol(source: str, name: str) -> str | None:
    """The source of one class or function by its dotted name."""
    try:
        node: ast.AST = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    for part in name.split("."):
        node = next((c for c in ast.iter_child_nodes(node) if getattr(c, "name", None) == part), None)
        if node is None:
            return None
    return ast.get_source_segment(source, node)


def skeletons(files: DataFrame) -> DataFrame:
    """Files (path, lang, text) with their skeleton: Python is outlined, other text comes back unchanged."""

    @F.pandas_udf("string")
    def outlined(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: outline(t) if isinstance(t, str) else None)

    return files.withColumn("skeleton", F.when(F.col("lang") == "python", F.coalesce(outlined("text"), F.col("text"))).otherwise(F.col("text")))
