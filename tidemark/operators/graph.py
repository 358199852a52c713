"""Bounded closures over edges (src, dst), each one recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _recursive(edges: DataFrame, roots: DataFrame, depth: int, pick: str, name: str) -> DataFrame:
    """Of each node the least or greatest number of steps, at most ``depth``, of the ways to it from a root: one recursive query.

    A step gives each node once, so there are at most as many rows as nodes times steps, whatever the number of ways. The engine's bound on
    all rows of a recursion is lifted, as the depth bounds it.
    """
    spark = edges.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    kind = roots.schema["node"].dataType.simpleString()
    return spark.sql(
        f"""with recursive reach(node, depth) max recursion level {int(depth) + 1} as (
                select distinct node, 0 as depth from {{roots}}
                union all
                select distinct cast(e.dst as {kind}) as node, r.depth + 1 as depth from reach r join {{edges}} e on r.node = e.src where r.depth < {int(depth)})
            select node, {pick}(depth) as {name} from reach group by node""",
        edges=edges.select("src", "dst"),
        roots=roots.select("node"),
    )


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Nodes that roots (node) reach in at most ``depth`` steps, with the least depth; cycles end at the bound."""
    return _recursive(edges, roots, depth, "min", "depth")


def affected(edges: DataFrame, changed: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """Which targets (node) depend on changed nodes: the closure over reversed edges, then a semi join."""
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(backward, changed, depth).join(targets, "node", "left_semi")


def levels(edges: DataFrame, depth: int) -> DataFrame:
    """Longest path from a node that nothing leads to, at most ``depth``: nodes of a cycle end at the bound."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return _recursive(edges, nodes, depth, "max", "level")


def header_sources(headers: DataFrame, sources: DataFrame) -> DataFrame:
    """Headers and sources (path) with the same base name without extension."""
    base = lambda df: F.regexp_replace(F.regexp_replace(df["path"], r"^.*/", ""), r"\.[^.]*$", "")
    h, s = headers.select(F.col("path").alias("header"), base(headers).alias("_b")), sources.select(F.col("path").alias("source"), base(sources).alias("_b"))
    return h.join(s, "_b").drop("_b")
