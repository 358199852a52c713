"""Benchmark items inside documents, found by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let_go, raw_texts, runs_by_size

#: Bytes of a q-gram: 7, so that it fits a 64-bit word.
Q = 7
#: Edits allowed for each byte of an item, as far as the lemma still asks for shared q-grams.
EDITS = 0.125
#: Least number of shared q-grams that a region must have; a larger one for longer items follows from the lemma.
LEAST_SHARED = 3
#: Bytes of items that are sent to the workers at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 8_000_000
#: Bytes of text that are searched at once.
AT_ONCE = 500_000
COUNTERS = 1 << 19

#: Bytes that stay when a text is squashed: ASCII letters and digits and all of other characters.
KEEP = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
DROPPED = bytes(np.flatnonzero(~KEEP).tolist())
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def squash(text: bytes) -> bytes:
    """Lower-case, without white space, punctuation and control characters of ASCII; two-byte Latin capitals are folded as well."""
    out = text.translate(FOLD, DROPPED)
    if out.isascii():
        return out
    codes = np.frombuffer(out, np.uint8).copy()
    after = np.flatnonzero(codes[:-1] == 0xC3) + 1
    capital = after[(codes[after] >= 0x80) & (codes[after] <= 0x9E) & (codes[after] != 0x97)]
    codes[capital] += 0x20
    return codes.tobytes()


def grams(codes: bytes) -> np.ndarray:
    """The q-grams that start at each byte, as numbers. The buffer is padded, so there is one for each byte but the last Q-1."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = codes + b"\0"
    return np.ndarray((n,), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * Q) - 1)


def banded_distance(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int]:
    """Least edits between item and any stretch of text whose alignment stays on diagonals first-most to last+most; and where the best one ends.

    A diagonal is text offset minus item offset. Above ``most`` edits the distance is ``most + 1``.
    """
    lo, width = first - most, last - first + 2 * most + 1
    far = most + 1
    at = np.arange(lo, lo + width)
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    steps = np.arange(width)
    for i, c in enumerate(item):
        j = at + i  # the text byte that this row consumes on each diagonal
        inside = (j >= 0) & (j < len(text))
        differs = np.ones(width, np.int64)
        differs[inside] = text[j[inside]] != c
        new = np.where(inside, cost + differs, far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        cost = np.minimum(new, far)
        if cost.min() >= far:
            return far, 0
    cost = np.where((at + len(item) >= 0) & (at + len(item) <= len(text)), cost, far)
    best = int(cost.argmin())
    return int(cost[best]), int(at[best] + len(item))


def dense(diagonal: np.ndarray, offset: np.ndarray, edits: int, shared: int) -> list[tuple[int, int]]:
    """Diagonal bands of at most edits + 1 diagonals that hold q-grams of at least ``shared`` distinct offsets of the item; diagonals rise."""
    if len(diagonal) < shared:
        return []
    begins = np.flatnonzero(diagonal[shared - 1 :] - diagonal[: len(diagonal) - shared + 1] <= edits)
    found: list[tuple[int, int]] = []
    ends = np.searchsorted(diagonal, diagonal[begins] + edits, "right")
    begins = begins[np.diff(ends, prepend=-1) > 0]  # a band that ends where the one before does lies in it
    for i, j in zip(begins.tolist(), ends[np.diff(ends, prepend=-1) > 0].tolist(), strict=True):
        if len(np.unique(offset[i:j])) >= shared:
            first, last = int(diagonal[i]), int(diagonal[j - 1])
            if not found or found[-1][1] < last:
                found.append((first, last))
    return found


class Items:
    """The q-gram table of some benchmark items, with each item's budget of edits and bound of shared q-grams."""

    def __init__(self, texts: list[tuple[object, bytes]]):
        squashed = [(k, squash(t)) for k, t in texts]
        squashed = [(k, t) for k, t in squashed if t]
        self.short = [(k, t) for k, t in squashed if len(t) < Q + LEAST_SHARED]
        self.items = [(k, t) for k, t in squashed if len(t) >= Q + LEAST_SHARED]
        length = np.array([len(t) for _, t in self.items], np.int64)
        lemma = (length + 1 - LEAST_SHARED) // Q - 1  # most edits for which the lemma still asks for LEAST_SHARED q-grams
        self.edits = np.maximum(0, np.minimum((length * EDITS).astype(np.int64), lemma))
        self.shared = length + 1 - Q * (self.edits + 1)
        self.longest = int(length.max(initial=0))
        codes = [grams(t) for _, t in self.items]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order] if codes else np.empty(0, np.int64)
        self.offset = np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else np.empty(0, np.int64)
        self.codes, self.start, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.bits = max(16, math.ceil(math.log2(len(self.codes) + 1)) + 4)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.codes)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def regions(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of all overlapping diagonal bands that share enough q-grams with an item.

        Counters of neighbouring bins of diagonals sort out most q-grams; bands are then counted exactly.
        """
        code = grams(text)
        at = np.flatnonzero(self.seen[self._slot(code)]) if len(code) and len(self.codes) else np.empty(0, np.int64)
        row = np.minimum(np.searchsorted(self.codes, code[at]), max(0, len(self.codes) - 1))
        real = self.codes[row] == code[at] if len(at) else np.empty(0, bool)
        at, row = at[real], row[real]
        if not len(at):
            return []
        n = self.count[row]
        which = np.repeat(self.start[row] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diagonal = self.item[which], np.repeat(at, n) - self.offset[which] + self.longest
        step = self.edits[item] + 1
        bins = diagonal // step
        per_item = (len(text) + 2 * self.longest) + 2
        key = item * per_item + bins  # its neighbour is the next bin of the same item
        slots = key & (COUNTERS - 1)
        counts = np.bincount(slots, minlength=COUNTERS)
        around = np.maximum(counts[slots] + counts[(slots + 1) & (COUNTERS - 1)], counts[slots] + counts[slots - 1])
        near = around >= self.shared[item]  # never misses: a counter can only count too much
        # Of what is left, each distinct (bin, item's offset, diagonal) once, in order of diagonal within the item.
        item, diagonal, offset = item[near], diagonal[near], self.offset[which[near]]
        order = np.lexsort((offset, diagonal, item))
        item, diagonal, offset = item[order], diagonal[order], offset[order]
        found: list[tuple[int, int, int]] = []
        starts = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item)).tolist()
        for a, b in zip(starts, starts[1:], strict=False):
            i = int(item[a])
            found += [(i, first - self.longest, last - self.longest) for first, last in dense(diagonal[a:b], offset[a:b], int(self.edits[i]), int(self.shared[i]))]
        return found

    def find(self, texts: list[bytes | None]) -> Iterator[tuple[int, object, int, int, int]]:
        """(text's number, item's key, edits, first byte, byte after the last) of the best place of each item in each text; bytes of the text as given."""
        for a, b in runs_by_size([len(t or b"") for t in texts], AT_ONCE):
            squashed = [squash(t or b"") for t in texts[a:b]]
            starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in squashed])])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            joined = b"\0".join(squashed)
            for i, first, last in self.regions(joined):
                key, item = self.items[i]
                middle = (first + last + len(item)) // 2
                for d in {int(np.searchsorted(starts, x, "right")) - 1 for x in (max(0, first), min(max(0, middle), len(joined)), min(max(0, last + len(item) - 1), len(joined)))}:
                    if not 0 <= d < len(squashed) or (known := best.get((d, i), (len(item), 0, 0)))[0] == 0:
                        continue
                    lo, hi = int(first - starts[d]), int(last - starts[d])
                    region = squashed[d][max(0, lo) : max(0, hi) + len(item)]
                    if (p := region.find(item)) >= 0:
                        edits, end = 0, max(0, lo) + p + len(item)
                    else:
                        most = int(self.edits[i])
                        low = max(0, lo - most)
                        edits, end = banded_distance(np.frombuffer(item, np.uint8), np.frombuffer(squashed[d][low : max(0, hi + most) + len(item) + most], np.uint8), lo - low, hi - low, most)
                        end += low
                    if edits <= self.edits[i] and edits < known[0]:
                        best[d, i] = (edits, max(0, end - len(item)), end)
            rows = [(d, self.items[i][0], *x) for (d, i), x in best.items()]
            for d, s in enumerate(squashed):
                rows += [(d, k, 0, p, p + len(t)) for k, t in self.short if (p := s.find(t)) >= 0]
            for d, key, edits, first, end in sorted(rows, key=lambda r: r[0]):
                place = np.flatnonzero(KEEP[np.frombuffer(texts[a + d] or b"", np.uint8)])
                yield a + d, key, edits, int(place[first]), int(place[end - 1]) + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each item in each row of docs that holds it: id, item id, edits, first and stop (bytes of the text).

    Texts are compared without case, white space and ASCII punctuation. An occurrence with at
    most k edits shares at least m + 1 - Q(k + 1) q-grams with an item of m bytes, all on k + 1
    neighbouring diagonals; k is EDITS of the item's bytes, less where the bound would fall under
    LEAST_SHARED. Items shorter than Q + LEAST_SHARED bytes are looked for exactly; items that are
    null or squash to nothing match nothing, and neither do null or empty texts. Repeated rows and
    equal items are each reported, as are items of null id. Item ids may be of any type that text can be cast to. Documents stay where they are; only the benchmark is sent out,
    in blocks of BLOCK_BYTES, one pass over docs for each. Extra columns are not read.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = None
    for part in blocks_of(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            let_go("decontam")
            table = None
            for batch in batches:
                table = table or Items(part)
                hits = list(table.find(raw_texts(batch)))
                ids = batch.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.string()), *[pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3, 4)]], ["id", "item", "edits", "first", "stop"])

        hits = rows.mapInArrow(run, f"id {id_kind}, item string, edits long, first long, stop long")
        found = hits if found is None else found.unionByName(hits)
    return found.select(F.col("id").alias(id_col), F.col("item").cast(item_kind).alias(item_col), "edits", "first", "stop")


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items (key, text) in blocks of about BLOCK_BYTES; one block, of none, if there are none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    for block in range(blocks):
        yield [(r["item"], r["text"].encode()) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item. Rows are judged one by one, so null and repeated ids are like any other; null texts stay."""
    for part in blocks_of(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            let_go("decontam")
            table = None
            for batch in batches:
                table = table or Items(part)
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in table.find(raw_texts(batch, text_col))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
