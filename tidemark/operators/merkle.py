"""Tamper evidence: a hash tree over blocks of rows, proofs that a row is in it, and what differs between two.

A row's block is told by the first hex digits of its key's SHA-256, so a row that comes, goes or changes touches its own
block alone. Blocks of the same first digits make a node of the level above, sixteen at most, up to the root. Where the depth is
fixed and rows are many, digits of more bits keep both blocks and nodes small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stages import kept

#: Children of a node, and rows that a block should have.
FANOUT, IN_BLOCK = 16, 16
#: Bits of a hex digit; other digits are written in binary.
HEX = 4
#: Nodes of upper levels that have so many entries at most, all together, are sent to every task.
SENT_ENTRIES = 1 << 16


def depth_for(rows: int, in_block: int = IN_BLOCK) -> int:
    """Levels below the root for blocks of about ``in_block`` rows."""
    return max(1, math.ceil(math.log(max(1, rows / in_block), FANOUT)))


def bits_for(rows: int, depth: int) -> int:
    """Bits of a digit for which blocks have about as many rows as nodes have children, a hex digit's at least: a proof's length grows as the root of rows of degree depth + 1."""
    return min(64 // depth, max(HEX, math.ceil(math.log2(max(1, rows)) / (depth + 1))))


def _width(bits: int) -> int:
    return 1 if bits == HEX else bits


def _block(key: Column, depth: int, bits: int) -> Column:
    digest = F.sha2(key, 256)
    if bits == HEX:
        return F.substring(digest, 1, depth)
    hexes = -(-depth * bits // HEX)  # conv takes 16 at most
    return F.substring(F.lpad(F.conv(F.substring(digest, 1, hexes), 16, 2), HEX * hexes, "0"), 1, depth * bits)


def leaves(df: DataFrame, keys: list[str], depth: int, record: Column | None = None, bits: int = HEX) -> DataFrame:
    """df with ``node``, the row's block, and ``digest``, the SHA-256 of its record (all columns as JSON, if not given)."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if len(keys) > 1 else F.coalesce(F.col(keys[0]).cast("string"), F.lit("null"))
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}) if record is None else record
    return df.withColumn("node", _block(key, depth, bits)).withColumn("digest", F.sha2(record, 256))


def _combined(entries: DataFrame) -> DataFrame:
    """(node, rows, entries, digest) of entries (node, entry, n)."""
    grouped = entries.groupBy("node").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list("entry")).alias("entries"))
    return grouped.withColumn("digest", F.sha2(F.array_join("entries", ""), 256))


def tree(rows: DataFrame, depth: int, bits: int = HEX) -> DataFrame:
    """All nodes of the tree over leaves: level (0 is the root), node, rows, entries and digest.

    A block's entries are its rows' digests with how often each occurs, a node's are its children's last digit and digest; both
    sorted, so the order of rows doesn't matter. Blocks are written once; each level above is a grouping of the one below it. No rows make no nodes.
    """
    counted = rows.groupBy("node", "digest").agg(F.count(F.lit(1)).alias("n"))
    level = kept(_combined(counted.select("node", F.concat("digest", F.lit(":"), F.col("n").cast("string"), F.lit(";")).alias("entry"), "n")))
    out = level.select(F.lit(depth).alias("level"), "*")
    for d in range(depth - 1, -1, -1):
        entry = F.concat(_label(d, bits), F.lit("="), "digest", F.lit(";"))
        level = _combined(level.select(F.substring("node", 1, d * _width(bits)).alias("node"), entry.alias("entry"), F.col("rows").alias("n")))
        out = out.unionByName(level.select(F.lit(d).alias("level"), "*"))
    return out


def _label(d: int, bits: int) -> Column:
    return F.substring("node", d * _width(bits) + 1, _width(bits))


def proofs(chosen: DataFrame, nodes: DataFrame, depth: int, bits: int = HEX) -> DataFrame:
    """Leaves ``chosen`` with ``proof``: of each level, from the block up, what stands before and after the digest so far.

    A digest that isn't in its block has a null proof. A proof has 2^bits digests a level, and those of its block. Blocks take
    their parents along before they meet the leaves, which are moved once.
    """

    def level(d: int) -> DataFrame:
        found = nodes.where(F.col("level") == d).select(F.col("node").alias(f"_node{d}"), F.array_join("entries", "").alias(f"_text{d}"), F.col("digest").alias(f"_up{d}"))
        return F.broadcast(found) if d < depth and bits * (d + 1) <= math.log2(SENT_ENTRIES) else found

    above = lambda node, d: F.substring(node, 1, d * _width(bits)) == F.col(f"_node{d}")
    blocks = level(depth).join(level(depth - 1), above(f"_node{depth}", depth - 1)) if depth else level(0)
    found = chosen.join(blocks, above("node", depth), "left")
    for d in range(depth - 2, -1, -1):
        found = found.join(level(d), above("node", d), "left")
    steps = []
    for d in range(depth, -1, -1):
        label = F.lit("") if d == depth else F.concat(_label(d, bits), F.lit("="))
        # An entry has one digest, and no two of a node the same label and digest, so there is one place at most, and something after it.
        own = F.concat(label, F.col("digest") if d == depth else F.col(f"_up{d + 1}"))
        before, after = (F.split_part(F.col(f"_text{d}"), own, F.lit(k)) for k in (1, 2))
        steps.append(F.when(after != "", F.array(F.struct(F.concat(before, label).alias("before"), after.alias("after")))))
    return found.select(*chosen.columns, F.concat(*steps).alias("proof"))


def proved(digest: Column, proof: Column, root: Column) -> Column:
    """Whether a proof leads from a row's digest to the root; false if there is none."""
    return F.coalesce(F.aggregate(proof, digest, lambda sofar, s: F.sha2(F.concat(s["before"], sofar, s["after"]), 256)) == root, F.lit(False))


def changed_blocks(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """Blocks (node) in which two trees of one depth differ: added, removed or changed, with their rows before and after.

    Levels are compared from the root down, each only below nodes that differ.
    """
    differing = None
    for d in range(depth + 1):
        a, b = (t.where(F.col("level") == d).select("node", F.col("rows").alias(f"rows_{n}"), F.col("digest").alias(f"_{n}")) for t, n in ((before, "before"), (after, "after")))
        if differing is not None:
            above = differing.select(F.col("node").alias("_above"))
            a, b = (t.join(above, F.substring("node", 1, d - 1) == F.col("_above"), "left_semi") for t in (a, b))
        differing = a.join(b, "node", "full").where(~F.col("_before").eqNullSafe(F.col("_after")))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed")
    return differing.select("node", change.alias("change"), "rows_before", "rows_after")


def changed_rows(before: DataFrame, after: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of leaves that were added, removed or changed, comparing rows of differing blocks alone. Keys must be unique."""
    a, b = (t.join(blocks.select("node"), "node", "left_semi").select(*keys, F.col("digest").alias(n)) for t, n in ((before, "_before"), (after, "_after")))
    both = a.join(b, keys, "full").where(~F.col("_before").eqNullSafe(F.col("_after")))
    return both.select(*keys, F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed").alias("change"))
