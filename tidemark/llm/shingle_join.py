"""Exact similarity join of texts by their word shingles: rare shingles find candidates, T-occurrence search (DivideSkip) over inverted lists decides."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import raw_texts, runs_by_size, written
from tidemark.llm.near_dup import BYTE_CODE, SHINGLE_CODE, TOGETHER_BYTES, _across, _in_blocks, _marked, _node, components, mix

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bits of the table that counts shingles; a shingle's slot tells how common it may be.
COUNT_BITS, COUNT_PARTS = 20, 64
#: Weight of the longest list's logarithm when long lists are told from short ones.
LONG = 0.01
AT_ONCE = 1_000_000
#: Bitmaps, and texts, that a task compares with each other at once.
BITMAPS, TEXTS = 4096, 4096

#: Capitals A-Z become small, ASCII white space a space; nothing else changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, STEP)]))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: a 64-bit code of its bytes, and the number of its text."""
    codes = np.frombuffer(b" " + b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    inside = codes != 0x20
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = (np.cumsum(inside) - 1)[first]
    n = int(inside.sum())
    lengths = np.diff(np.append(at, n))
    offset = np.arange(n) - np.repeat(at, lengths)
    total = np.add.reduceat(BYTE_CODE[codes[inside]] * powers(int(lengths.max()))[offset], at)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return mix(total + lengths.astype(np.uint64)), np.searchsorted(starts, first - 1, "right") - 1


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of some texts (at most 65,536): text's number and 64-bit code, sorted by both. A text of fewer words has one, of all of them."""
    words, text = word_codes(texts)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    code, size = words * SHINGLE_CODE[0], np.ones(n, np.int64)
    for k in range(1, min(SHINGLE, n)):
        same = text[k:] == text[:-k]
        code[:-k] += np.where(same, words[k:] * SHINGLE_CODE[k], np.uint64(0))
        size[:-k] += same
    full = (size == SHINGLE) | (np.diff(text, prepend=-1) != 0)
    code, text = mix(code[full] + size[full].astype(np.uint64)), text[full].astype(np.uint16)
    order = np.argsort(code)
    order = order[np.argsort(text[order], kind="stable")]
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    return text[new].astype(np.int64), code[new]


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that two sets of sizes a and b must share to be similar."""
    return -(-percent * (a + b) // (100 + percent))


class Lists:
    """Inverted lists of some sets, numbered by size: of each shingle the numbers of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        codes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.numbers = np.repeat(np.arange(len(sets)), self.sizes)[order]
        codes = codes[order]
        new = np.flatnonzero(np.diff(codes, prepend=codes[:1] + np.uint64(1)))
        self.codes, self.bounds = codes[new], np.append(new, len(codes))

    def of(self, wanted: np.ndarray, start: int, stop: int, open_: np.ndarray) -> list[list[int]]:
        """The lists of some shingles, from set ``start`` on to before ``stop``, without sets that aren't open; empty ones left out."""
        place = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        place = place[self.codes[place] == wanted]
        a, b = self.bounds[place], self.bounds[place + 1]
        many = b - a > 1  # else only the set itself has it
        found = []
        for x, y in zip(a[many].tolist(), b[many].tolist(), strict=True):
            part = self.numbers[x:y]
            part = part[(part >= start) & (part < stop)]
            part = part[open_[part]]
            if len(part):
                found.append(part.tolist())
        return found


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers that stand in at least ``least`` of some ascending lists, and in how many: a heap holds each list's next number, and
    numbers that too few lists can still reach are jumped over by binary search."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        number = heap[0][0]
        popped = []
        while heap and heap[0][0] == number:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield number, len(popped)
            following = number + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            following = heap[0][0]
        for k in popped:
            at[k] = bisect_left(lists[k], following, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def divide_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """The same: the long lists are put aside, short ones merged for what the long ones can't give, and what that finds is looked up in the long ones."""
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    n_long = min(least - 1, len(lists), int(least / (LONG * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for number, count in merge_skip(short, least - n_long):
        for k, x in enumerate(long):
            if count + len(long) - k < least:
                break
            i = bisect_left(x, number)
            count += i < len(x) and x[i] == number
        if count >= least:
            yield number, count


def linked_sets(sets: list[np.ndarray], sides: np.ndarray, root: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join all classes of some sets (ascending codes) which any similar pair of them, on different sides if there are two, links.

    Each set is searched for among the larger ones that aren't yet in its class; pairs within a class aren't looked at.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    lists, root, side = Lists([sets[k] for k in order]), root[order].copy(), sides[order]
    two, links, sizes = sides.min() != sides.max() if len(sides) else False, [], lists.sizes
    for i in range(len(order) - 1):
        if not sizes[i]:
            continue
        stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        open_ = (root != root[i]) & ((side != side[i]) | (not two))
        if not open_[i + 1 : stop].any():
            continue
        found = lists.of(sets[order[i]], i + 1, stop, open_)
        for j, count in list(divide_skip(found, least_overlap(int(sizes[i]), int(sizes[i]), percent))):
            if root[j] != root[i] and count >= least_overlap(int(sizes[i]), int(sizes[j]), percent):
                links.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return links


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in runs_by_size([len(t) for t in texts], AT_ONCE):
        for c in range(a, b, 30_000):
            yield c, min(b, c + 30_000)


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """Of each slot of a table of fixed size, in how many texts' sets its shingles are. Each task sends the table's parts, which are added up part by part."""
    slots = 1 << COUNT_BITS
    width = slots // COUNT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            raw = [t or b"" for t in raw_texts(batch)]
            for a, b in _runs(raw):
                code = shingle_sets(raw[a:b])[1]
                total += np.bincount((code >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=slots)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array([total[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(COUNT_PARTS)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(width, np.int64))
                sums[part] += np.frombuffer(raw, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    counted = rows.select("text").mapInArrow(count, "part int, counts binary")
    table = np.zeros((COUNT_PARTS, width), np.int64)
    for part, raw in counted.repartition("part").mapInArrow(add, "part int, counts binary").collect():  # COUNT_PARTS rows
        table[part] += np.frombuffer(raw, np.int64)
    return table.reshape(-1)


def prefixes(text: np.ndarray, code: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the shingles of which two similar sets share at least one: all but as many as a similar set must share, and one more; the rarest by ``counts``."""
    order = np.lexsort((code, counts[(code >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], text))
    text, code = text[order], code[order]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(np.append(first, len(text)))
    taken = size - -(-percent * size // 100) + 1
    keep = np.arange(len(text)) - np.repeat(first, size) < np.repeat(taken, size)
    return text[keep], code[keep]


def parity(code: np.ndarray) -> bytes:
    """A set's bitmap: as many bits as the next power of two, 64 at least; each shingle flips one.

    Bits in which two sets' bitmaps differ (the longer folded to the shorter) are no more than shingles that only one of them has.
    """
    bits = max(64, 1 << (len(code) - 1).bit_length())
    return np.packbits((np.bincount((code & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, width: int) -> bytes:
    return bits if len(bits) == width else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).tobytes()


def maybe_similar(sizes: list[int], bits: list[bytes], sides: np.ndarray, root: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that join all classes of some sets (by size and bitmap) which any pair that may be similar, on different sides if there are two, joins."""
    two, links, root = sides.min() != sides.max(), [], root.tolist()
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    as_number = {w: [int.from_bytes(folded(b, w), "big") if len(b) >= w else 0 for b in bits] for w in {len(b) for b in bits}}
    for k, i in enumerate(order):
        mine, width, most = as_number[len(bits[i])], len(bits[i]), sizes[i] * 100 // percent
        number = mine[i]
        for j in order[k + 1 :]:
            if sizes[j] > most:
                break
            if root[i] == root[j] or (two and sides[i] == sides[j]):
                continue
            both = sizes[i] + sizes[j]
            if (number ^ mine[j]).bit_count() <= both - 2 * least_overlap(sizes[i], sizes[j], percent) and width:
                links.append((i, j))
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root]
    return links


def _members(rare: DataFrame) -> DataFrame:
    """(key, node, n) of texts that have a shingle in their prefixes which other texts have in theirs.

    Groups of the same texts get the same key, a sum over their members, so that they are one, unless they lie across batches.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row, whose group may go on
        goes_on = False  # whether other members of its group are told already, and it as well
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if not len(now):
                continue
            now = pa.concat_tables([held, now]) if held is not None else now
            key = now.column("key").to_numpy()
            node = np.frombuffer(b"".join(now.column("node").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            again = np.zeros(len(now), bool)
            again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1]).all(axis=1)
            if again.any():
                now, key, node = now.filter(pa.array(~again)), key[~again], node[~again]
            new = np.ones(len(now), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(now)))
            several = np.repeat(size > 1, size)
            sums = np.add.reduceat(mix(node[:, 0] + mix(node[:, 1])), first).view(np.int64)
            whole = size > 1
            whole[-1] = False  # it may go on
            if goes_on:
                several[0], whole[0] = False, False
            told = np.flatnonzero(several)
            if len(told):
                named = np.where(np.repeat(whole, size), np.repeat(sums, size), key)
                yield pa.RecordBatch.from_arrays([pa.array(named[told]), now.column("node").combine_chunks().take(pa.array(told)), now.column("n").combine_chunks().take(pa.array(told))], ["key", "node", "n"])
            goes_on = bool(several[-1]) or (goes_on and len(now) == 1)
            held = now.slice(len(now) - 1)

    return rare.repartition("key").sortWithinPartitions("key", "node").mapInArrow(group, "key long, node binary, n int")


def _maximal(members: DataFrame) -> DataFrame:
    """members without groups that lie within another one: those all of whose texts have the same group as their largest."""
    sized = members.withColumn("c", F.count(F.lit(1)).over(W.partitionBy("key")))
    topped = sized.withColumn("top", F.max(F.struct("c", "key")).over(W.partitionBy("node")))
    within = topped.groupBy("key").agg(F.min("top.key").alias("lo"), F.max("top.key").alias("hi")).where("lo = hi and lo <> key")
    return members.join(within.select("key"), "key", "left_anti")


Linker = Callable[[pa.Table, np.ndarray, np.ndarray], list[tuple[int, int]]]


def _linked(groups: DataFrame, roots: DataFrame | None, held: DataFrame, link_rows: Linker) -> DataFrame:
    """Links (a, b) within groups (g, side, node) that join the classes (node, root) of those of a group which ``link_rows`` links; held has what it reads of each node."""
    if roots is None:
        rows = groups.join(held, "node").withColumn("root", F.col("node"))
    else:
        rows = groups.join(held.join(roots, "node", "left"), "node").withColumn("root", F.coalesce("root", "node"))

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        g, sides = rows.column("g").to_numpy(), rows.column("side").to_numpy()
        nodes, raw_roots = rows.column("node").to_pylist(), rows.column("root").to_pylist()
        starts = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)).tolist()
        found: list[tuple[bytes, bytes]] = []
        for a, b in zip(starts, starts[1:], strict=False):
            number = {r: k for k, r in enumerate(dict.fromkeys(raw_roots[a:b]))}
            if len(number) > 1:
                root = np.array([number[r] for r in raw_roots[a:b]])
                found += [(max(u, v), min(u, v)) for x, y in link_rows(rows.slice(a, b - a), sides[a:b], root) for u, v in [(nodes[a + x], nodes[a + y])]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            if not len(now):
                continue
            g = now.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))  # the last group waits for the next batch
            if last:
                yield links_of(now.slice(0, last))
            rest = now.slice(last)
        if rest is not None and len(rest):
            yield links_of(rest)

    rows = rows.repartition("g").sortWithinPartitions("g", "side", "node")
    return written(rows.mapInArrow(link, "a binary, b binary").distinct(), "join-links")


def _settled(banded: DataFrame, held: DataFrame, link_rows: Linker, together: int) -> DataFrame:
    """(node, root) of the classes that link_rows makes of buckets (node, size, key): within blocks of ``together`` nodes, or TOGETHER_BYTES, first, and then across blocks between classes."""
    sized = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("least")).where("n > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / together), F.ceil(F.col("bytes") / TOGETHER_BYTES)).cast("int")
    shared = written(sized.select("key", blocks.alias("blocks"), "least"), "join-buckets")
    roots = components(_linked(_in_blocks(banded, shared), None, held, link_rows))
    large = shared.where("blocks > 1")
    if not large.isEmpty():
        keys = banded.join(large.select("key"), "key").groupBy("node").agg(F.max("size").alias("size"), F.collect_set("key").alias("keys"))
        apart = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = _linked(_across(apart, large), roots, held, link_rows)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return roots


def shingle_classes(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_shingles (distinct shingles of five words) and component_id, the least id among all rows it is linked to, over any number of links.

    Two rows are linked if their sets' intersection is at least ``percent`` of their union; nothing is estimated. Words are
    runs of other than ASCII white space, A-Z in small letters. A text of under five words has one shingle of all of them; a null text, or one without words, has none and is linked to
    nothing, not even its like. A null id never names a class of rows with ids. Extra columns are not read.

    Similar sets share one of their rarest shingles (as many as may differ, and one more). Texts that have one in common
    are compared by bitmaps, which rule out most pairs and never a similar one; what is left hangs together in neighbourhoods,
    little more than the classes themselves. Each neighbourhood's texts are moved once and searched, in blocks if there are many. Every pair of
    different classes is searched, so no link between them is lost; links inside a class aren't counted, as there may be as many as pairs.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = rows.sparkSession.sparkContext.broadcast(shingle_counts(rows))  # 2 ** COUNT_BITS numbers

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, node = [t or b"" for t in raw_texts(batch)], batch.column("node").to_pylist()
            sizes, rare, bits, seen = np.zeros(len(raw), np.int32), [None] * len(raw), [None] * len(raw), set()
            for a, b in _runs(raw):
                text, code = shingle_sets(raw[a:b])
                sizes[a:b] = np.bincount(text, minlength=b - a)
                at, picked = prefixes(text, code, counts.value, percent)
                split = lambda number, values, n=b - a: np.split(values, np.searchsorted(number, np.arange(1, n)))
                for k, (part, whole) in enumerate(zip(split(at, picked.view(np.int64)), split(text, code), strict=True)):
                    if node[a + k] not in seen and len(whole):
                        rare[a + k], bits[a + k] = part, parity(whole)
                    seen.add(node[a + k])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(sizes), pa.array(rare, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["id", "node", "n", "rare", "bits"])

    def by_bits(rows: pa.Table, sides: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
        return maybe_similar(rows.column("n").to_pylist(), rows.column("bits").to_pylist(), sides, root, percent)

    def by_search(rows: pa.Table, sides: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
        sets, texts = [], rows.column("text").cast(pa.binary()).to_pylist()
        for x, y in _runs(texts):
            text, code = shingle_sets(texts[x:y])
            sets += np.split(code, np.searchsorted(text, np.arange(1, y - x)))
        return linked_sets(sets, sides, root, percent)

    signed = written(rows.select("id", _node().alias("node"), "text").mapInArrow(sign, f"id {kind}, node binary, n int, rare array<long>, bits binary"), "join-signed")
    first = signed.where("rare is not null")
    members = written(_members(first.select(F.explode("rare").alias("key"), "node", "n")).distinct(), "join-members")
    banded = written(_maximal(members), "join-groups").select("node", (F.ceil(F.col("n") / 8)).alias("size"), "key")
    near = _settled(banded, first.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), by_bits, BITMAPS)
    hoods = written(near.join(first.groupBy("node").agg((F.first("n") * 8).alias("size")), "node").select("node", "size", F.xxhash64("root").alias("key")), "join-hoods")
    texts = rows.where("text is not null").select(_node().alias("node"), "text")
    held = _marked(texts, hoods.select("node")).where("marked").groupBy("node").agg(F.first("text").alias("text"))
    roots = _settled(hoods, held, by_search, TEXTS)
    nodes = signed.groupBy("node").agg(F.min("id").alias("first"), F.max("n").alias("n"))
    classes = nodes.where("n > 0").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    found = signed.join(classes.join(named, "root").select("node", "class_id"), "node", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("component_id"))
