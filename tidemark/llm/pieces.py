"""SentencePiece encoding and decoding by a max-plus scan over the lattice of pieces.

The model is of the BPE kind: a piece's score is its merge priority. A row of pieces is the BPE
encoding of its text if and only if each two neighbours are the encoding of their own text, so in
the max-plus semiring a step between neighbours weighs 0 if they are such a pair and -inf if not,
and one path is left. Forward, each text position then has one last piece. A giant text is cut
into chunks; for each chunk a transfer matrix leads from the pieces that may lie over its left
bound to those that may lie over its right one. Matrices are combined associatively, which settles
the pieces at all bounds, and each chunk is then traced back by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, runs_by_size

#: The model's sign for a space.
SPACE = "▁"
#: Characters above which a text is cut, and characters of a chunk.
GIANT, CHUNK = 65_536, 16_384
#: Distinct words, and distinct pairs of pieces, that a worker remembers; beyond, it starts anew.
REMEMBERED = 200_000
PAIR_BITS = 21
AT_ONCE = 1_000_000
NEVER = -np.inf


class Table:
    """Numbers by number, looked up for whole arrays: a hash table with linear probing."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys."""
        self.size += len(keys)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several that want a slot one gets it
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & mask

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(default))
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(rest):
            slot = (slot if len(slot) == len(rest) else slot[rest]) + 1 & (1 << self.bits) - 1
            wanted = keys[rest]
            seen = self.keys[slot]
            hit = seen == wanted
            out[rest[hit]] = self.values[slot[hit]]
            on = ~hit & (seen >= 0)
            rest, slot = rest[on], slot[on]
        return out


class Pieces:
    """A BPE model's vocabulary and the lattice steps over it."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        if len(self.byte_ids) < 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("the model must have byte pieces, and no piece that goes on over a space")
        self.bytes_of = [b""] * n
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        # Of each piece and each beginning of one: 1 a piece, 2 a longer piece begins so, 3 both.
        self.kinds = {p[:k]: 2 for p in self.ids for k in range(1, len(p))}
        self.kinds |= {p: self.kinds.get(p, 0) + 1 for p in self.ids}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        # The same for arrays of words: a trie by (node, character), the piece at each node, and known pairs of pieces.
        nodes = {"": 0} | {p: k + 1 for k, p in enumerate(self.kinds)}
        self.trie = Table(19)
        self.trie.put(np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in self.kinds], np.int64), np.array([nodes[p] for p in self.kinds], np.int32))
        self.piece_at = np.array([-1, *[self.ids.get(p, -1) for p in self.kinds]], np.int32)
        self.names = {i: p for p, i in self.ids.items()}
        self.start_id, self.other_id = n, n + 1
        self.known_pairs = Table(PAIR_BITS)
        self.grown: dict[str, tuple[list[float], list[str], list[str]]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.words: dict[str, bytes] = {}

    def growth(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How BPE makes a piece out of its characters: the scores of its joins, and the outer parts on the left and right before each and at the end.

        A join takes the neighbours of best score, leftmost first. The last score is -inf: nothing is left to join.
        """
        known = self.grown.get(piece)
        if known is None:
            parts, scores, lefts, rights = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                offers = [self.scores.get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
                top = max(offers)
                if top == NEVER:
                    break
                at = offers.index(top)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(top)
                lefts.append(parts[0])
                rights.append(parts[-1])
            known = self.grown[piece] = (scores + [NEVER], lefts, rights) if len(parts) == 1 else ([], [], [])
        return known

    def pair(self, a: str, b: str) -> bool:
        """Whether the step from a to b weighs 0: both grow to their ends before anything joins over their bound.

        At equal scores the leftmost join comes first: a's, then the one over the bound, then b's.
        """
        (sa, _, right), (sb, left, _) = self.growth(a), self.growth(b)
        if not sa or not sb:
            return False
        i = j = 0
        while True:
            across = self.scores.get(right[i] + left[j], NEVER)
            if across != NEVER and across > sa[i] and across >= sb[j]:
                return False
            if sa[i] == sb[j] == NEVER:
                return True
            if sa[i] >= sb[j]:
                i += 1
            else:
                j += 1

    def last_pieces(self, text: str, first: str | None = None) -> list[str | None]:
        """Forward pass: of each end in text, the last piece of the one path that reaches it; None if no path does.

        With ``first``, paths begin with that piece. A character outside the vocabulary is a piece.
        """
        kinds, pairs = self.kinds, self.pairs
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        start = 0
        if first:
            start = len(first)
            last[start] = first
        for start in range(start, n):
            before = last[start]
            if before is None:
                continue
            steps = pairs.get(before)
            if steps is None:
                if self.n_pairs > 2 * REMEMBERED:
                    pairs.clear()
                    self.n_pairs = 0
                steps = pairs[before] = {}
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                kind = kinds.get(piece, 0)
                if kind & 1 or end == start + 1:
                    good = steps.get(piece)
                    if good is None:
                        good = steps[piece] = not before or self.pair(before, piece)
                        self.n_pairs += 1
                    if good:
                        last[end] = piece
                if kind < 2:
                    break
        return last

    def back(self, last: list[str | None], end: int) -> list[str]:
        """Trace back from an end."""
        found = []
        while end:
            found.append(last[end])
            end -= len(last[end])
        return found[::-1]

    def numbers(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def word(self, text: str) -> bytes:
        """Ids, as 4-byte numbers, of a stretch that no piece reaches over."""
        packed, last, end, found = self.packed, self.last_pieces(text), len(text), []
        while end:
            piece = last[end]
            end -= len(piece)
            found.append(packed.get(piece) or b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode("utf-8", "surrogatepass")))
        return b"".join(found[::-1])

    def _steps(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each step weighs 0; pairs that aren't known yet are worked out once."""
        keys = before.astype(np.int64) << 24 | piece
        good = self.known_pairs.get(keys, -1)
        if (unknown := good < 0).any():
            new = np.unique(keys[unknown])
            if self.known_pairs.size + len(new) > 1 << PAIR_BITS - 1:
                self.known_pairs = Table(PAIR_BITS)
            found = [self._step(k >> 24, k & 0xFFFFFF) for k in new.tolist()]
            self.known_pairs.put(new, np.array(found, np.int32))
            good = self.known_pairs.get(keys, 0)
        return good > 0

    def _step(self, before: int, piece: int) -> bool:
        if before == self.start_id:
            return True
        if self.other_id in (before, piece):  # a character outside the vocabulary joins nothing
            return True
        return self.pair(self.names[before], self.names[piece])

    def trace_words(self, words: list[str]) -> list[bytes]:
        """``word`` for many words of like length at once: the forward pass goes over all of them position by position."""
        lengths = np.array([len(w) for w in words])
        most = int(lengths.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.zeros((len(words), most), np.int64)
        chars[np.arange(most)[None, :] < lengths[:, None]] = flat
        last = np.full((len(words), most + 1), -1, np.int32)
        came = np.zeros((len(words), most + 1), np.int16)
        last[:, 0] = self.start_id
        for start in range(most):
            row = np.flatnonzero((lengths > start) & (last[:, start] >= 0))
            node = np.zeros(len(row), np.int64)
            for end in range(start + 1, most + 1):
                inside = lengths[row] >= end
                row, node = row[inside], node[inside]
                if not len(row):
                    break
                node = self.trie.get(node << 21 | chars[row, end - 1], -1)
                piece = self.piece_at[node]
                piece = np.where((node < 0) | (piece < 0), self.other_id if end == start + 1 else -1, piece)
                some = np.flatnonzero(piece >= 0)
                if len(some):
                    good = some[self._steps(last[row[some], start], piece[some])]
                    last[row[good], end], came[row[good], end] = piece[good], start
                on = node >= 0
                row, node = row[on], node[on].astype(np.int64)
        place, found = lengths.copy(), []
        rows = np.arange(len(words))
        while len(rows):
            ids = last[rows, place[rows]]
            found.append((rows, place[rows], ids))
            place[rows] = came[rows, place[rows]]
            rows = rows[place[rows] > 0]
        at = np.concatenate([f[0] for f in found])
        order = np.lexsort((np.concatenate([f[1] for f in found]), at))
        ids, at, ends = np.concatenate([f[2] for f in found])[order], at[order], np.concatenate([f[1] for f in found])[order]
        bounds = np.searchsorted(at, np.arange(len(words) + 1))
        raw = ids.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.unique(at[ids == self.other_id]).tolist():
            a, b = bounds[i], bounds[i + 1]
            out[i] = b"".join(b"".join(self.byte_ids[x].to_bytes(4, "little") for x in words[i][e - 1].encode("utf-8", "surrogatepass")) if k == self.other_id else k.to_bytes(4, "little") for k, e in zip(ids[a:b].tolist(), ends[a:b].tolist(), strict=True))
        return out

    def learn(self, words: set[str]) -> None:
        """Trace words that aren't remembered; long ones by themselves."""
        new = sorted((w for w in words if w not in self.words), key=len)
        short = [w for w in new if len(w) < 64]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            self.words.update(zip(part, self.trace_words([SPACE + w for w in part]), strict=True))
        self.words.update((w, self.word(SPACE + w)) for w in new[len(short) :])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as 4-byte numbers; each distinct word is traced once."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts = [stretches(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, without the space that encoding puts in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]

    # Chunks of giant texts. Bound b of a text in model form (spaces as SPACE, one in front) lies before its character b.

    def over(self, text: str, bound: int, base: int = 0) -> list[tuple[int, int]]:
        """States of a bound: (start, end) of each piece that may hold the character before it."""
        if bound <= 0:
            return [(0, 0)]
        states = []
        for start in range(max(0, bound - self.longest), bound):
            for end in range(bound, min(len(text), start + self.longest) + 1):
                if text[start:end] in self.ids or end - start == 1:
                    states.append((start + base, end + base))
        return states

    def transfer(self, text: str, left: int, right: int, base: int, at_start: bool) -> tuple[list, list, list[list[float]]]:
        """The chunk [left, right) of text, which goes on around it: states of both bounds and the weights between them.

        base: where text begins in the whole. Paths from different states mostly meet soon; from
        there on their last pieces are the same, yet each is followed by itself, as a chunk is short.
        """
        rows = self.over(text, left, base) if not at_start else [(0, 0)]
        columns = self.over(text, right, base)
        matrix = []
        for start, end in rows:
            s, e = start - base, end - base
            last = self.last_pieces(text[s:], text[s:e] or None)
            row = []
            for x, y in columns:
                a, b = x - base - s, y - base - s
                meets = (x, y) == (start, end) or (a >= e - s and last[b] is not None and len(last[b]) == b - a)
                row.append(0.0 if meets else NEVER)
            matrix.append(row)
        return rows, columns, matrix

    def trace(self, text: str, base: int, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
        """Ids of the pieces after the left bound's up to the right bound's, which belongs to this chunk."""
        if left == right:
            return []
        s, e = left[0] - base, left[1] - base
        last = self.last_pieces(text[s : right[1] - base], text[s:e] or None)
        pieces = self.back(last, right[1] - base - s)
        return self.numbers(pieces[1:] if e > s else pieces)


def stretches(text: str) -> list[str]:
    """Cut a text before each run of spaces; the first space of every stretch, put in front or the text's own, is left out."""
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [s[1:] for s in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]


def model_form(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def combine(a: tuple[list, list, np.ndarray], b: tuple[list, list, np.ndarray]) -> tuple[list, list, np.ndarray]:
    """The max-plus product of neighbouring chunks' matrices: the right states of one are the left states of the other."""
    return a[0], b[1], (a[2][:, :, None] + b[2][None, :, :]).max(axis=1)


def settle(matrices: list[tuple[list, list, np.ndarray]]) -> list[tuple[int, int]]:
    """The states at all bounds on the path: prefixes of the product forward, then the choice that each allows backward."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    n = max(y for _, y in matrices[-1][1])
    states = [next(s for s, w in zip(matrices[-1][1], prefix[-1][2][0], strict=True) if w == 0 and s[1] == n)]
    for k in range(len(matrices) - 1, 0, -1):
        _, columns, weights = matrices[k]
        to = columns.index(states[-1])
        reach = prefix[k - 1][2][0] + weights[:, to]
        states.append(matrices[k][0][int(reach.argmax())])
    return [matrices[0][0][0], *states[::-1]]


def _pieces(path: str) -> Pieces:
    """A worker's own copy, which outlives a task until another operator's begins."""
    return held("pieces", path, Pieces)


def _encoded(ids: pa.Array, texts: list[str | None], encoded: list[bytes], pieces: Pieces) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(encoded), "<i4")
    lengths = np.array([len(e) // 4 for e in encoded], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    same = [pieces.decode(values[a:b].tolist()) == (t or "").replace(SPACE, " ").encode() for a, b, t in zip(offsets, offsets[1:], texts, strict=False)]
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(same)], ["id", "n_tokens", "ids", "decodes"])


def encode_pieces(df: DataFrame, model_path: str, giant: int = GIANT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_tokens, ids (the library's own for the model) and decodes.

    decodes: the ids decode to the text, in which the model takes its sign for a space, U+2581, as
    one. Null and empty texts have no ids. Texts of more than ``giant`` characters go through the
    chunked scan as rows of their own; others are traced whole, word by word. Repeated rows give
    repeated results; ids of rows may be null. Extra columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, n_tokens long, ids array<int>, decodes boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            sizes = batch.column("text").cast(pa.binary())
            lengths = [len(x.as_buffer()) for x in sizes]
            for a, b in runs_by_size(lengths, AT_ONCE):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                yield _encoded(batch.column("id").slice(a, b - a), texts, pieces.encode(texts), pieces)

    usual = rows.where(F.length("text") <= giant).mapInArrow(whole, schema)
    return usual.unionByName(_giants(rows.where(F.length("text") > giant), model_path, chunk, kind, schema)).select(F.col("id").alias(id_col), "n_tokens", "ids", "decodes")


def _giants(rows: DataFrame, model_path: str, chunk: int, kind: str, schema: str) -> DataFrame:
    """The chunked scan: matrices by chunk, a product by text, a trace by chunk, and the chunks' ids in order.

    A row's key is its id and its text's digest; repeated rows are traced once and repeated at the end.
    """
    context = 2 * 16
    keyed = rows.withColumn("key", F.sha2("text", 256))
    form = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    n = F.length("form")
    chunks = (
        keyed.select("key", "text").dropDuplicates(["key"]).select("key", form.alias("form"))
        .select("key", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda k: F.struct(k.alias("k"), F.substring("form", F.greatest(k * chunk - context, F.lit(0)) + 1, F.lit(chunk + 2 * context)).alias("part")))).alias("c"))
        .select("key", "c.k", F.greatest(F.col("c.k") * chunk - context, F.lit(0)).cast("int").alias("base"), F.least((F.col("c.k") + 1) * chunk, F.col("n")).cast("int").alias("right"), "c.part")
    )
    state = "array<array<int>>"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = r["k"] * chunk - r["base"], r["right"] - r["base"]
                a, b, m = pieces.transfer(r["part"], left, right, r["base"], r["k"] == 0)
                out.append({"key": r["key"], "k": r["k"], "lefts": [list(s) for s in a], "rights": [list(s) for s in b], "weights": m})
            ints, floats = pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("k", pa.int32()), ("lefts", ints), ("rights", ints), ("weights", floats)]))

    def products(_: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        states = settle([([tuple(s) for s in r["lefts"]], [tuple(s) for s in r["rights"]], np.array(r["weights"])) for r in rows])
        return pa.table({"key": [r["key"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "l0": pa.array([s[0] for s in states[:-1]], pa.int32()), "l1": pa.array([s[1] for s in states[:-1]], pa.int32()), "r0": pa.array([s[0] for s in states[1:]], pa.int32()), "r1": pa.array([s[1] for s in states[1:]], pa.int32())})

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            out = [{"key": r["key"], "k": r["k"], "ids": pieces.trace(r["part"], r["base"], (r["l0"], r["l1"]), (r["r0"], r["r1"]))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("k", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            encoded = [np.array(x, "<i4").tobytes() for x in batch.column("ids").to_pylist()]
            yield _encoded(batch.column("id"), batch.column("text").to_pylist(), encoded, pieces)

    spread = chunks.repartition("key", "k")
    settled = spread.mapInArrow(matrices, f"key string, k int, lefts {state}, rights {state}, weights array<array<double>>").groupBy("key").applyInArrow(products, "key string, k int, l0 int, l1 int, r0 int, r1 int")
    traced = spread.join(settled, ["key", "k"]).mapInArrow(traces, "key string, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return keyed.join(whole, "key").select("id", "text", "ids").mapInArrow(checked, schema)
