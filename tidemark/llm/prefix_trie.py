"""Trie of conversations' shared beginnings: LOUDS bit vectors by prefix shard, the levels that many conversations share apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Turns of a conversation that are kept in one row; a shard holds at most so many levels.
SEGMENT = 1024
#: A node that more conversations share is merged apart from the shards. All nodes together have as many members as there are
#: turns, so that bound, raised to turns / MOST_HEAVY, leaves at most MOST_HEAVY of them: what is broadcast and what one task merges.
SHARED, MOST_HEAVY = 1024, 1 << 18
#: Shards are built together, as one forest, up to about so many members.
TOGETHER = 1 << 14
#: Ids of one part of a node's list of ends: those that agree above so many bits.
END_BITS = 16

ROOT = bytes(16)
EMPTY = hashlib.sha256().hexdigest()
NODE = "key binary, conv_id long, depth long, parent_key binary, parent_shard binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


class Louds:
    """A forest in level order: of each node, its virtual root first, a one for each child and then a zero.

    The i-th one is node i; the zeros before it tell its parent's number, 0 for a tree's top.
    """

    def __init__(self, parents: np.ndarray, levels: list[int], hi: np.ndarray, lo: np.ndarray):
        n = len(parents)
        degree = np.bincount(parents, minlength=n + 1)
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(degree) + np.arange(n + 1)] = 0
        self.n, self.bits, self.levels, self.hi, self.lo = n, np.packbits(bits), levels, hi, lo

    def _ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1))

    def parents(self) -> np.ndarray:
        return self._ones() - np.arange(self.n)

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.n + 1) == 0)
        return (np.diff(zeros) - 1).astype(np.int64)

    def keys(self) -> list[bytes]:
        raw = np.stack([self.hi, self.lo], axis=1).astype(">u8").tobytes()
        return [raw[i : i + 16] for i in range(0, 16 * self.n, 16)]

    def up(self, values: np.ndarray, combine: np.ufunc = np.add) -> np.ndarray:
        """Of each node the values of its subtree: levels from the deepest up, each added to its parents."""
        total, parent = values.copy(), self.parents() - 1
        bounds = [*self.levels, self.n]
        for a, b in reversed(list(zip(bounds[1:], bounds[2:], strict=False))):
            combine.at(total, parent[a:b], total[a:b])
        return total


def _split(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(blob, ">u8").astype(np.uint64)
    return words[0::2], words[1::2]


def from_paths(blobs: list[bytes]) -> tuple[Louds, np.ndarray, np.ndarray]:
    """The forest of some paths of 16-byte keys, each key a digest of all that leads to it; of each path the number (from 0) of its
    last node, and of each node the place in the joined paths where it stands first."""
    sizes = np.array([len(b) // 16 for b in blobs])
    hi, lo = _split(b"".join(blobs))
    offset = np.cumsum(sizes) - sizes
    rows, at = np.arange(len(blobs)), np.zeros(len(blobs), np.int64)
    parents, levels, where, made = [], [], [], 0
    for level in range(int(sizes.max(initial=0))):
        rows = rows[sizes[rows] > level]
        place = offset[rows] + level
        order = np.lexsort((place, lo[place], hi[place], at[rows]))
        rows, place = rows[order], place[order]
        new = np.ones(len(rows), bool)
        new[1:] = (hi[place[1:]] != hi[place[:-1]]) | (lo[place[1:]] != lo[place[:-1]]) | (at[rows[1:]] != at[rows[:-1]])
        parents.append(at[rows[new]])
        where.append(place[new])
        levels.append(made)
        at[rows] = made + np.cumsum(new)
        made += int(new.sum())
    first = np.concatenate(where) if where else np.empty(0, np.int64)
    return Louds(np.concatenate(parents) if parents else np.empty(0, np.int64), levels, hi[first], lo[first]), at - 1, first


def ordered_steps(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of conversations (conv_id, turn, role, text), pos from 1 by turn, null first.

    Null role or text is empty. Turns of equal number go by role and then by digest, so texts aren't moved.
    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"), F.length(text).cast("bigint").alias("chars"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest"))
    return rows.select("conv_id", place.cast("bigint").alias("pos"), "digest", "chars")


def with_lent_heads(steps: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """Conversations that share beginnings: the first h turns of c - c % every, then c's own after its first h; h is crc32(c) % longest.

    Columns conv_id, part, pos, digest, chars; a row of part -1 and null digest stands for the conversation itself.
    """
    steps = written(steps, "trie-steps")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = steps.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("lender"))
    heads = steps.where((F.col("conv_id") % every == 0) & (F.col("pos") < longest)).select(F.col("conv_id").alias("lender"), "pos", "digest", "chars")
    lent = convs.join(heads, "lender").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "chars")
    own = steps.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "chars")
    none = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("chars"))
    return none.unionByName(lent).unionByName(own)


def _segments(steps: DataFrame, segment: int) -> DataFrame:
    """Rows of at most ``segment`` nodes of a conversation's path: their keys, and those of the row before."""

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key, start, keys, chars, before = None, ROOT, 0, [], [], []
        out: list[tuple] = []
        for batch in batches:
            for c, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "digest", "chars")), strict=True):
                if digest is None:
                    if conv is not None:
                        out.append((conv, start, keys, chars, before, True))
                    conv, key, start, keys, chars, before = c, ROOT, 0, [ROOT], [0], []
                    continue
                if len(keys) == segment:
                    out.append((conv, start, keys, chars, before, False))
                    start, before, keys, chars = start + segment, keys, [], []
                key = hashlib.blake2b(key + digest, digest_size=16).digest()
                keys.append(key)
                chars.append(n)
            yield _rows(out)
            out = []
        if conv is not None:
            yield _rows([(conv, start, keys, chars, before, True)])

    names = ["conv_id", "start", "keys", "chars", "before", "last"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.bool_()]
    _rows = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
    sorted_ = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "digest", "chars")
    return sorted_.mapInArrow(trace, "conv_id long, start long, keys array<binary>, chars array<long>, before array<binary>, last boolean")


def _sharded(paths: DataFrame, heavy) -> DataFrame:
    """Of each row of paths the part below all heavy nodes, by its shard, the key it starts with; or, if it ends at a heavy node, that node's key."""

    def light_from(keys: list[bytes], known: dict) -> int:
        a, b = 0, len(keys)
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if keys[m] in known else (a, m)
        return a

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            out: list[tuple] = []
            for conv, start, keys, chars, before, last in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "start", "keys", "chars", "before", "last")), strict=True):
                i = light_from(keys, known)
                if i == len(keys):
                    if last:
                        out.append((None, conv, None, None, None, None, None, None, True, keys[-1]))
                    continue
                parent = keys[i - 1] if i else before[-1] if before else None
                shard = None
                if i == 0 and before and (k := light_from(before, known)) < len(before):
                    shard = before[k]
                out.append((keys[i], conv, start + i, parent, shard, known.get(parent), b"".join(keys[i:]), np.array(chars[i:], np.int64).tobytes(), last, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    names = ["shard", "conv_id", "start", "parent_key", "parent_shard", "parent_conv_id", "keys", "chars", "last", "ends_at"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
    return paths.mapInArrow(deal, "shard binary, conv_id long, start long, parent_key binary, parent_shard binary, parent_conv_id long, keys binary, chars binary, last boolean, ends_at binary")


def _forest(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole shards: their members' paths, and rows without keys that add to a node what lies below it in other shards."""
    given = rows.column("keys").is_null().to_numpy()
    paths, below = rows.filter(pa.array(~given)), rows.filter(pa.array(given))
    blobs = paths.column("keys").to_pylist()
    trie, end, first = from_paths(blobs)
    conv = paths.column("conv_id").to_numpy()
    chars = np.frombuffer(b"".join(paths.column("chars").to_pylist()), np.int64)[first]
    sizes = np.array([len(b) // 16 for b in blobs])
    row = np.repeat(np.arange(len(blobs)), sizes)[first]
    depth = paths.column("start").to_numpy()[row] + first - (np.cumsum(sizes) - sizes)[row]
    members = np.bincount(end, minlength=trie.n)
    least = np.full(trie.n, np.iinfo(np.int64).max)
    np.minimum.at(least, end, conv)
    n_convs, least, children = trie.up(members), trie.up(least, np.minimum), trie.degrees()
    keys = trie.keys()
    more = np.zeros((3, trie.n), np.int64)
    if len(below):
        number = {k: i for i, k in enumerate(keys)}
        at = [number[k] for k in below.column("parent_key").to_pylist()]
        for k, name in enumerate(("n_children", "n_leaves", "saved_tokens")):
            np.add.at(more[k], at, below.column(name).to_numpy())
    children = children + more[0]
    leaves = trie.up((children == 0) + more[1])
    saved = trie.up((n_convs - 1) * chars + more[2])
    parent = trie.parents() - 1
    top = parent < 0
    of_top = dict(zip(np.flatnonzero(top).tolist(), row[top].tolist(), strict=True))
    outer = paths.select(["parent_key", "parent_shard", "parent_conv_id"]).take(pa.array(list(of_top.values()), pa.int64())).to_pylist()
    outer_of = dict(zip(of_top, outer, strict=True))
    inner = least[np.maximum(parent, 0)].tolist()
    ends = [EMPTY] * trie.n
    last = np.flatnonzero(paths.column("last").to_numpy())
    last = last[np.lexsort((conv[last], end[last]))]
    bounds = np.flatnonzero(np.diff(end[last], prepend=-1)).tolist()
    ids, at_end = conv[last].tolist(), end[last].tolist()
    for a, b in zip(bounds, [*bounds[1:], len(ids)], strict=False):
        ends[at_end[a]] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
    columns = [
        pa.array(keys, pa.binary()), pa.array(least), pa.array(depth), *[pa.array([outer_of[i][c] if i in outer_of else None for i in range(trie.n)], pa.binary()) for c in ("parent_key", "parent_shard")],
        pa.array([outer_of[i]["parent_conv_id"] if i in outer_of else inner[i] for i in range(trie.n)], pa.int64()), *map(pa.array, (n_convs, children, leaves, saved)), pa.array(ends), pa.array(top),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NODE.split(", ")])


def _rolled(rows: DataFrame) -> DataFrame:
    """Nodes of the shards that rows (members, and sums from below) are of."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) < TOGETHER:
                continue
            now = pa.Table.from_batches(rest)
            shards = now.column("shard").to_pylist()
            cut = len(shards)
            while cut and shards[cut - 1] == shards[-1]:  # the last shard may go on in the next batch
                cut -= 1
            if cut:
                yield _forest(now.slice(0, cut).combine_chunks())
            rest = now.slice(cut).to_batches()
        if sum(map(len, rest)):
            yield _forest(pa.Table.from_batches(rest).combine_chunks())

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(roll, NODE)


def _upper(heavy: DataFrame, below: DataFrame) -> DataFrame:
    """The heavy nodes (key, conv_id, depth, parent_key, n_convs, chars) with the sums of the shards below them, merged by one task: there are at most MOST_HEAVY."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [n for batch in batches for n in batch.to_pylist()]
        if not nodes:
            return
        number: dict[bytes | None, int] = {None: 0}
        by_depth: dict[int, list[dict]] = {}
        for n in nodes:
            by_depth.setdefault(n["depth"], []).append(n)
        nodes, levels = [], []
        for d in sorted(by_depth):
            levels.append(len(nodes))
            for n in sorted(by_depth[d], key=lambda n: (number[n["parent_key"]], n["key"])):
                nodes.append(n)
                number[n["key"]] = len(nodes)
        of = lambda name: np.array([n[name] for n in nodes], np.int64)
        trie = Louds(np.array([number[n["parent_key"]] for n in nodes]), levels, *_split(b"".join(n["key"] for n in nodes)))
        children = trie.degrees() + of("more_children")
        leaves = trie.up((children == 0) + of("more_leaves"))
        saved = trie.up((of("n_convs") - 1) * of("chars") + of("more_saved"))
        least, parent = of("conv_id"), trie.parents()
        over = [int(least[p - 1]) if p else None for p in parent.tolist()]
        none = pa.nulls(trie.n, pa.binary())
        columns = [pa.array(trie.keys(), pa.binary()), pa.array(least), pa.array(of("depth")), none, none, pa.array(over, pa.int64()), pa.array(of("n_convs")), *map(pa.array, (children, leaves, saved)), pa.nulls(trie.n, pa.string()), pa.array(np.zeros(trie.n, bool))]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NODE.split(", ")])

    sums = below.groupBy(F.col("parent_key").alias("_p")).agg(*[F.sum(a).alias(b) for a, b in (("n_children", "more_children"), ("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))])
    joined = heavy.join(sums, heavy["key"] == sums["_p"], "left").drop("_p").fillna(0, ["more_children", "more_leaves", "more_saved"])
    return joined.repartition(1).mapInArrow(merge, NODE)


def _end_lists(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of heavy nodes: ids are joined in parts of a range, and a node's parts are hashed in order, one after the other."""
    parts = ends.groupBy(F.col("ends_at").alias("key"), F.shiftright("conv_id", END_BITS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends"])

    return parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(digest, "key binary, ends string")


def prefix_nodes(steps: DataFrame, shared: int = SHARED, segment: int = SEGMENT) -> DataFrame:
    """The trie of sequences (conv_id, part, pos, digest, chars), in order of part and pos; each conversation has one row without a digest, its root.

    One row for each node, a distinct beginning: key (digest of it), conv_id (least member), depth,
    parent_conv_id, n_convs (members), n_children, n_leaves and saved_tokens (both of its subtree; a node saves its last turn's chars for
    every member but one) and ends_sha256 (SHA-256 of the ids, ascending and joined by commas, of members that end there).

    Nodes with over ``shared`` members are counted by a shuffle with partial sums and merged apart. All below one
    of them that hangs together is a shard, of ``shared`` members and ``segment`` levels at most, whatever the input; shards go by bands of as many
    levels, deepest first, so conversations of more turns take one round for each band. No conversations make no nodes.
    """
    paths = written(_segments(steps, segment), "trie-paths")
    total, bands = paths.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.max("start"), F.lit(0))).first()
    limit = max(shared, -(-total // MOST_HEAVY))
    before = F.when(F.size("before") > 0, F.element_at("before", -1))
    node = lambda key, i: F.struct(key.alias("key"), (F.col("start") + i).alias("depth"), F.get("chars", i).alias("chars"), F.when(i > 0, F.get("keys", i - 1)).otherwise(before).alias("parent_key"))
    nodes = paths.select("conv_id", F.explode(F.transform("keys", node)).alias("n")).select("conv_id", "n.*")
    counted = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.min("parent_key").alias("parent_key"))
    heavy = written(counted.where(F.col("n_convs") > limit), "trie-heavy")
    found = heavy.select("key", "conv_id").toArrow()  # at most MOST_HEAVY
    known = paths.sparkSession.sparkContext.broadcast(dict(zip(found["key"].to_pylist(), found["conv_id"].to_pylist(), strict=True)))
    dealt = written(_sharded(paths, known), "trie-shards")
    members = dealt.where("shard is not null").select("shard", "conv_id", "start", "parent_key", "parent_shard", "parent_conv_id", "keys", "chars", "last", *[F.lit(0).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    below, made, tops = None, None, None
    for band in range(bands // segment, -1, -1):
        rows = members.where(F.floor(F.col("start") / segment) == band)
        rolled = written(_rolled(rows if below is None else rows.unionByName(below)), "trie-nodes")
        made = rolled if made is None else made.unionByName(rolled)
        top = rolled.where("top and parent_key is not null").select("parent_shard", "parent_key", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens")
        tops = top if tops is None else tops.unionByName(top)
        sums = top.where("parent_shard is not null").groupBy("parent_shard", "parent_key").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
        nothing = {"conv_id": "bigint", "start": "bigint", "parent_conv_id": "bigint", "keys": "binary", "chars": "binary", "last": "boolean"}
        below = sums.select(F.col("parent_shard").alias("shard"), F.lit(None).cast("binary").alias("parent_shard"), "parent_key", "n_children", "n_leaves", "saved_tokens", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    upper = _upper(heavy, tops.where("parent_shard is null"))
    upper = upper.join(_end_lists(dealt.where("ends_at is not null")), "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends")
    over = made.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("over"))
    across = made.where("parent_shard is not null").join(over, "parent_key", "left").withColumn("parent_conv_id", F.col("over")).drop("over")
    return made.where("parent_shard is null").unionByName(across).unionByName(upper).drop("parent_key", "parent_shard", "top")
