"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let_go, raw_texts, runs_by_size, written

#: Words of a shingle, and the similarity from which on two texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and samples in each; two texts of similarity 0.8 share a band with probability 0.9992.
BANDS, ROWS = 10, 3
#: All samples; one byte of each makes a text's sketch.
SAMPLES = 60
#: Rows of the table of document counts, and bits of a row. A word's count is the least over the rows of its slots' counts.
COUNT_ROWS, COUNT_BITS = 2, 20
#: Least weight of a shingle, so that one of common words only still counts.
LEAST_WEIGHT = 0.05
#: Pairs that agree in fewer bytes of their sketches aren't verified; for a similarity of 0.8 that is 4.8 standard deviations away.
MAYBE = 33
#: Texts, and bytes of text, of a bucket that a task compares with each other at once; a larger bucket is dealt out in blocks.
TOGETHER, TOGETHER_BYTES = 512, 8_000_000
#: Candidates of a text that are verified before those already linked to it are taken out again.
VERIFIED_AT_ONCE = 64
#: Bits of the filter that tells which texts take part; more set bits only let more texts through.
FILTER_BITS = 1 << 22
AT_ONCE = 1_000_000

#: ASCII other than letters and digits becomes space, capitals become small.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: First bytes of three-byte characters of scripts without spaces (Thai to Khmer, kana, han): each is a word by itself.
UNSPACED = np.isin(np.arange(256), [*range(0xE3, 0xEA)])
_random = np.random.default_rng(20240229)
BYTE_CODE = _random.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
PLACE_CODE = _random.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
SHINGLE_CODE = _random.integers(1, 2**63, SHINGLE, np.uint64) | np.uint64(1)
SAMPLE_CODE = _random.integers(1, 2**63, SAMPLES, np.uint64) | np.uint64(1)
# Gamma(2, 1) at the middles of 2^16 steps of probability, by Newton's method on 1 - (1 + x) exp(-x).
_p = (np.arange(1 << 16) + 0.5) / (1 << 16)
_x = np.where(_p < 0.5, np.sqrt(2 * _p) + _p, 2 - 2 * np.log(1 - _p))
for _ in range(60):
    _x = np.maximum(_x - (1 - (1 + _x) * np.exp(-_x) - _p) / np.maximum(_x * np.exp(-_x), 1e-12) * 0.9, 1e-6)
GAMMA, LOG_GAMMA = _x.astype(np.float32), np.log(_x).astype(np.float32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: a 64-bit code of its bytes, and the number of its text. A han or kana character is a word by itself."""
    buffer = b" " + b" ".join(texts).translate(FOLD) + b" "
    codes = np.frombuffer(buffer, np.uint8)
    inside = codes != 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if not buffer.isascii():
        lead = UNSPACED[codes]
        if lead.any():
            single = lead.copy()
            single[1:] |= lead[:-1]
            single[2:] |= lead[:-2]
            begins |= lead
            begins[1:] |= inside[1:] & single[:-1] & ~single[1:]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = (np.cumsum(inside) - 1)[first]
    n = int(inside.sum())
    lengths = np.diff(np.append(at, n))
    offset = np.arange(n) - np.repeat(at, lengths)
    total = np.add.reduceat(BYTE_CODE[codes[inside]] * PLACE_CODE[offset & 63], at)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    return mix(total + lengths.astype(np.uint64)), np.searchsorted(starts, first - 1, "right") - 1


def count_slots(codes: np.ndarray) -> list[np.ndarray]:
    """Of each row of the table of document counts, the words' slots."""
    return [((codes >> np.uint64(64 - COUNT_BITS * (k + 1))) & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64) for k in range(COUNT_ROWS)]


class Weights:
    """Inverse document frequencies of all words, by a table of counts of fixed size.

    A slot holds the sum of the document counts of its words, so a word's least slot is its count, or
    a little more. Every word of every text is counted, and what a count may have too much is the same share of all
    texts at any size.
    """

    def __init__(self, counts: np.ndarray, texts: int):
        self.values = np.log((texts + 1) / (np.minimum(counts, texts) + 1)).astype(np.float32)

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, texts: int) -> Weights:
        return cls(np.stack([np.bincount(slot, weights=counts, minlength=1 << COUNT_BITS) for slot in count_slots(codes)]), texts)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return np.maximum.reduce([row[slot] for row, slot in zip(self.values, count_slots(codes), strict=True)])


def shingles(texts: list[bytes], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of some texts (at most 65,536): text's number, 48-bit code and weight; sorted by both.

    A weight is the shingle's count in the text times the mean inverse document frequency of its
    words. That of the shingle itself would fall as a text is copied, and so part its near copies.
    A text of fewer than SHINGLE words has one shingle, of all its words.
    """
    words, text = word_codes(texts)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float32)
    idf = weights(words)
    code, total, size = words * SHINGLE_CODE[0], idf.astype(np.float64), np.ones(n, np.int64)
    for k in range(1, min(SHINGLE, n)):
        same = text[k:] == text[:-k]
        code[:-k] += np.where(same, words[k:] * SHINGLE_CODE[k], np.uint64(0))
        total[:-k] += np.where(same, idf[k:], 0)
        size[:-k] += same
    first = np.diff(text, prepend=-1) != 0
    full = (size == SHINGLE) | first
    key = (text[full].astype(np.uint64) << np.uint64(48)) | (mix(code[full]) >> np.uint64(16))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)) != 0)
    count = np.diff(np.append(new, len(key)))
    weight = np.maximum(LEAST_WEIGHT, (total / size)[full][order][new]) * count
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight.astype(np.float32)


def samples(text: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and of each the codes of its SAMPLES consistent weighted samples.

    Of each sample the shingle k with least ln a = ln c - r (t - b) - r is drawn, t = floor(ln weight / r + b),
    where r and c are Gamma(2, 1) and b uniform by the shingle's code alone; (k, t) is the sample.
    """
    first = np.flatnonzero(np.diff(text, prepend=-1))
    lengths = np.diff(np.append(first, len(text)))
    log_weight = np.log(weight)
    drawn = np.empty((len(first), len(SAMPLE_CODE)), np.uint32)
    low = np.uint64(0xFFFF)
    for j, salt in enumerate(SAMPLE_CODE):
        z = mix((code + salt) * (salt | np.uint64(1)))
        r = GAMMA[(z & low).astype(np.int32)]
        c = LOG_GAMMA[((z >> np.uint64(16)) & low).astype(np.int32)]
        b = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + b)
        a = c - r * (t - b + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), lengths))
        if len(least) > len(first):
            least = least[np.diff(text[least], prepend=-1) != 0]
        drawn[:, j] = (mix(code[least] + (t[least].astype(np.int64).astype(np.uint64) << np.uint64(48))) >> np.uint64(32)).astype(np.uint32)
    return text[first], drawn


Shingles = tuple[np.ndarray, np.ndarray]


def similarity(a: Shingles, b: Shingles) -> float:
    """Weighted Jaccard similarity of two texts' (codes, weights), codes sorted."""
    return float(similarities(a, [b])[0])


def similarities(a: Shingles, others: list[Shingles]) -> np.ndarray:
    """Weighted Jaccard similarity of one text to each of some others; 0 if both have no shingles."""
    sizes = np.array([len(c) for c, _ in others])
    codes, weights = (np.concatenate([x[k] for x in others]) for k in (0, 1))
    bound = np.concatenate([[0], np.cumsum(sizes)])
    if len(a[0]):
        place = np.minimum(np.searchsorted(a[0], codes), len(a[0]) - 1)
        shared = np.where(a[0][place] == codes, np.minimum(a[1][place], weights), 0)
    else:
        shared = np.zeros(len(codes))
    both, own = (np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[bound]) for x in (shared, weights))
    total = float(a[1].sum(dtype=np.float64)) + own - both
    return np.divide(both, total, out=np.zeros(len(others)), where=total > 0)


def word_weights(df: DataFrame) -> Weights:
    """Document counts of all words of all rows, added up in the slots of a table; its size is that of the table however many words there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near_dup")
        total = np.zeros(COUNT_ROWS << COUNT_BITS, np.int64)
        for batch in batches:
            raw = [t or b"" for t in raw_texts(batch)]
            for a, b in _runs(raw):
                words, text = word_codes(raw[a:b])
                order = np.lexsort((words, text))
                words, text = words[order], text[order]
                first = (np.diff(words, prepend=~words[:1]) != 0) | (np.diff(text, prepend=-1) != 0)
                for k, slot in enumerate(count_slots(words[first])):
                    total[k << COUNT_BITS : (k + 1) << COUNT_BITS] += np.bincount(slot, minlength=1 << COUNT_BITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["slot", "n"])

    found = df.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_ROWS << COUNT_BITS)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return Weights(counts.reshape(COUNT_ROWS, -1), df.count())


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in runs_by_size([len(t) for t in texts], AT_ONCE):
        for c in range(a, b, 30_000):
            yield c, min(b, c + 30_000)


def _node(text: str = "text"):
    """Digest of a text, which stands for all equal texts."""
    return F.unhex(F.md5(text))


def classify(rows: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text) with texts that aren't null: (id, node) of each row, and of each distinct text its node, rows,
    class_id and the node of the text that has it.

    A null id never names a class of rows with ids.
    """
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(word_weights(rows))  # bounded by COUNT_ROWS and COUNT_BITS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near_dup")
        for batch in batches:
            raw = raw_texts(batch)
            keys: list[np.ndarray | None] = [None] * len(raw)
            sketches: list[bytes | None] = [None] * len(raw)
            for a, b in _runs(raw):
                which, drawn = samples(*shingles(raw[a:b], sent.value))
                if len(which):
                    banded = (drawn[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) * SHINGLE_CODE[:ROWS]).sum(axis=2, dtype=np.uint64)
                    banded = mix(banded + SAMPLE_CODE[:BANDS]).view(np.int64)
                for k, t in enumerate(which.tolist()):
                    keys[a + t], sketches[a + t] = banded[k], drawn[k].astype(np.uint8).tobytes()
            sizes = pa.array([len(t) for t in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), sizes, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "node", "size", "keys", "sketch"])

    signed = written(rows.select("id", _node().alias("node"), "text").mapInArrow(sign, f"id {kind}, node binary, size long, keys array<long>, sketch binary"), "near-signed")
    nodes = written(signed.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "near-nodes")
    banded = nodes.where("sketch is not null").select("node", "size", F.explode("keys").alias("key"))
    texts = rows.select(_node().alias("node"), "text")
    shared = written(_shared(banded), "near-buckets")
    links = _linked(_in_blocks(banded, shared), nodes.withColumn("root", F.col("node")), texts, sent, similar)
    roots = components(links)
    large = shared.where("blocks > 1")
    if not large.isEmpty():
        rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = _linked(_across(rooted, large), rooted, texts, sent, similar)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    classes = nodes.select("node", "first", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("node").alias("node")))
    named = classes.groupBy("root").agg(least.alias("least")).select("root", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"))
    return signed.select("id", "node"), classes.join(named, "root").select("node", "n_rows", "class_id", "class_node")


def near_duplicates(df: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id and class_id, the least id among all texts linked to its own.

    Two texts are linked if they are equal, or if the weighted Jaccard similarity of their
    shingles of five words is ``similar`` or more; classes are the connected components. Case and
    ASCII punctuation don't count. Equal texts are sampled and compared once. Candidates share a band
    of samples and agree in their sketches; each is verified unless links found before have put both texts into one
    class, so no link between classes is lost. A bucket of any size is dealt out in blocks: first each block
    by itself, with the bucket's least text in all of them, and then texts of different classes across blocks.
    A null text is linked to nothing, a text without words to equal ones only. A null id never
    names a class of rows with ids. Extra columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, classes = classify(rows.where("text is not null"), similar)
    found = signed.join(classes.select("node", "class_id"), "node", "left").select(F.col("id").alias(id_col), "class_id")
    alone = rows.where("text is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"))
    return found.unionByName(alone)


def keep_one_of_each(df: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, without near copies: of each class one row of the least id stays.

    Rows of null text stay, as do texts without an id that are like none with an id, once. Of repeated rows (equal id and text)
    one stays. Texts of classes of one row are not moved.
    """
    columns = df.columns
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*df.columns).alias("row")).withColumn("node", _node())
    _, classes = classify(rows.where("text is not null").select("id", "text"), similar)
    classes = written(classes, "near-classes")
    touched = classes.where("n_rows > 1 or node <> class_node").select("node")
    tested = _marked(rows, touched)
    quiet = tested.where("not coalesce(marked, false)").select("row")
    least = tested.where("marked").groupBy("node", "id").agg(F.first("row").alias("row"))
    heads = classes.where("node = class_node").select(F.col("node").alias("head"), "class_id")
    chosen = least.join(heads, (F.col("node") == F.col("head")) & F.col("id").eqNullSafe(F.col("class_id"))).select("row")
    return quiet.unionByName(chosen).select(*[F.col("row").getField(c).alias(c) for c in columns])


def _shared(banded: DataFrame) -> DataFrame:
    """Buckets of two texts or more: key, blocks it is dealt out in, and its least text."""
    sized = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("least")).where("n > 1")
    return sized.select("key", _blocks("n", "bytes").alias("blocks"), "least")


def _blocks(n: str, size: str):
    return F.greatest(F.lit(1), F.ceil(F.col(n) / TOGETHER), F.ceil(F.col(size) / TOGETHER_BYTES)).cast("int")


def _in_blocks(banded: DataFrame, shared: DataFrame) -> DataFrame:
    """(g, side, node): each block of each bucket is a group; the bucket's least text is in all of its blocks."""
    members = banded.join(shared, "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    return members.select("node", "key", F.explode(every).alias("block")).select(F.xxhash64("key", "block").alias("g"), F.lit(0).alias("side"), "node")


def _across(rooted: DataFrame, large: DataFrame) -> DataFrame:
    """(g, side, node) of buckets that were dealt out and hold texts of several classes: groups in which all pairs of texts of different classes meet.

    Texts of a bucket's largest class are never paired with each other: its blocks meet those of the
    other classes only, and these also each other.
    """
    banded = rooted.select("node", "root", "size", F.explode("keys").alias("key")).join(large.select("key"), "key")
    of_root = banded.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    hot = of_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", "bytes")).alias("hot"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("roots > 1")
    hot = hot.select("key", F.col("hot.root").alias("hot"), F.col("hot.n").alias("hot_n"), F.col("hot.bytes").alias("hot_bytes"), (F.col("n") - F.col("hot.n")).alias("n"), (F.col("bytes") - F.col("hot.bytes")).alias("bytes"))
    hot = hot.select("key", "hot", _blocks("hot_n", "hot_bytes").alias("h"), _blocks("n", "bytes").alias("o"))
    members = banded.join(hot, "key").withColumn("in_hot", F.col("root") == F.col("hot"))
    hashed = F.xxhash64("node")
    members = members.withColumn("side", F.when(F.col("in_hot"), F.pmod(hashed, F.col("h"))).otherwise(F.col("h") + F.pmod(hashed, F.col("o"))).cast("int"))
    others = F.when(F.col("in_hot"), F.sequence(F.col("h"), F.col("h") + F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("h") + F.col("o") - 1))
    dealt = members.select("key", "node", "side", F.explode(others).alias("other"))
    return dealt.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("g"), "side", "node")


def _marked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """texts with ``marked``: true if their node is among nodes, and for some others. A filter of FILTER_BITS bits is all that is broadcast."""
    slot = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    bits = nodes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    tested = texts.withColumn("s", slot).withColumn("word", F.shiftright("s", 6)).join(F.broadcast(bits), "word", "left")
    return tested.withColumn("marked", F.expr("node is not null and bits is not null and (shiftright(bits, cast(s & 63 as int)) & 1) = 1")).drop("s", "word", "bits")


def _linked(groups: DataFrame, rooted: DataFrame, texts: DataFrame, sent, similar: float) -> DataFrame:
    """Verified links (a, b) out of groups (g, side, node): as many as it takes to join all texts of a group that are linked in it.

    rooted has the sketch of each node and the class it is known to be in. Only texts of groups are moved, each distinct one once, and then to its groups.
    """
    groups = written(groups, "near-groups")
    wanted = groups.select("node").distinct().join(rooted.select("node", "sketch", "root"), "node")
    held = _marked(texts, groups.select("node")).where("marked").groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("near_dup")
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            if not len(now):
                continue
            g = now.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))  # the last group waits for the next batch
            if last:
                yield _links_of(now.slice(0, last), sent.value, similar)
            rest = now.slice(last)
        if rest is not None and len(rest):
            yield _links_of(rest, sent.value, similar)

    rows = groups.join(held, "node").select("g", "side", "node", "sketch", "root", "text").repartition("g").sortWithinPartitions("g", "side", "node")
    return written(rows.mapInArrow(link, "a binary, b binary"), "near-links")


def _links_of(rows: pa.Table, weights: Weights, similar: float) -> pa.RecordBatch:
    """Links within each group of rows (g, side, node, sketch, root, text), sorted by g and side."""
    g, sides = rows.column("g").to_numpy(), rows.column("side").to_numpy()
    nodes, texts = rows.column("node").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()
    root = np.unique(np.array([r.hex() for r in rows.column("root").to_pylist()]), return_inverse=True)[1]
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(g), SAMPLES)
    starts = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)).tolist()
    found: list[tuple[bytes, bytes]] = []
    for a, b in zip(starts, starts[1:], strict=False):
        for x, y in spanning_links(sketches[a:b], sides[a:b], root[a:b], texts[a:b], weights, similar):
            u, v = nodes[a + x], nodes[a + y]
            found.append((max(u, v), min(u, v)))
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def spanning_links(sketches: np.ndarray, sides: np.ndarray, root: np.ndarray, texts: list[bytes], weights: Weights, similar: float) -> list[tuple[int, int]]:
    """Verified pairs that join all classes of a group which any pair of its texts (across sides, if there are two) links.

    Every pair of different classes whose sketches agree enough is verified, best ones first, unless pairs
    before it have joined its classes.
    """
    across, links = sides[0] != sides[-1], []
    held: dict[int, Shingles] = {}

    def of(k: int) -> Shingles:
        if k not in held:
            held[k] = shingles([texts[k]], weights)[1:]
        return held[k]

    root = root.copy()
    for i in range(len(root) - 1):
        other = np.flatnonzero((root[i + 1 :] != root[i]) & ((sides[i + 1 :] != sides[i]) | (not across))) + i + 1
        if not len(other):
            continue
        agreed = (sketches[other] == sketches[i]).sum(axis=1)
        other, agreed = other[agreed >= MAYBE], agreed[agreed >= MAYBE]
        other = other[np.argsort(-agreed, kind="stable")]
        while len(other):
            part, other = other[:VERIFIED_AT_ONCE], other[VERIFIED_AT_ONCE:]
            for j in part[similarities(of(i), [of(k) for k in part.tolist()]) >= similar].tolist():
                if root[j] != root[i]:
                    links.append((i, j))
                    root[root == root[j]] = root[i]
            other = other[root[other] != root[i]]
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in links (a, b): root is the least node of its connected component.

    Each round every node takes the least root among its neighbours' and then the root of that
    root, until nothing changes; rounds end after about the logarithm of the longest path.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        of_low = roots.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        new = written(lower.join(of_low, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("new"), "root"), "roots")
        roots = new.select("node", F.col("new").alias("root"))
        if new.where("new <> root").isEmpty():
            return roots
