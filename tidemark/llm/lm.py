"""Log-probabilities of texts by a causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import base64
import itertools
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_training, raw_texts, runs_by_size, written

#: Texts on which the weights of the network are begun at most, chosen by a hash of their id. All training texts are then gone over; all counts are over all texts.
TRAIN_TEXTS = 2_500
#: Bytes of these texts at most, so that the driver's memory doesn't hang on their length; in order of hash, and without texts that are longer alone.
TRAIN_BYTES = 16_000_000
#: Windows that go through the network at once; few enough that what is between stays in a core's cache.
AT_A_TIME = 128
#: Scored tokens of a window, and tokens of context before them, which the window before has scored.
STRIDE, CONTEXT = 16, 8
#: Sizes of the network: dimension, hidden units, classes of ids that it predicts, ids that it tells apart.
DIM, HIDDEN, CLASSES, KNOWN_IDS = 16, 32, 64, 4096
#: Ids so frequent that each is a class of its own.
ALONE = 40
STEPS, BATCH, RATE = 2_500, 96, 0.006
#: Windows of a step, and the rate, when all texts are gone over; tasks that add up the weights so found.
PASS_BATCH, PASS_RATE, ADDERS = 384, 0.1 * RATE, 16
#: Weights are added up as whole multiples of this share, so that their sum doesn't depend on its order.
UNIT = 2.0**-24
#: Commonest words whose counts are sent to the workers; counts of the others are joined.
COMMON_WORDS = 1 << 18
#: Share of a common word's probability that comes from its count, the rest from the network.
COUNT_SHARE = 0.3
#: Commonest pairs of neighbouring ids whose counts are sent to the workers, and bits of their table.
PAIRS, PAIR_BITS = 1 << 19, 21
#: Counts' worth of the wider distribution in that of ids by class and class before, and in that of ids by class and id before.
SMOOTH, PAIR_SMOOTH = 50.0, 20.0
REMEMBERED, AT_ONCE = 300_000, 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FAR = np.float32(-1e9)


def begins_of(path: str) -> np.ndarray:
    """Of each id of a vocabulary whether it begins with a space, as each word's first one does and no other; then the end, which is a token of its own."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a)[:1] == b" " for a, b in map(bytes.split, lines)}
    begins = np.zeros(max(ranks) + 2, bool)
    begins[[r for r, begin in ranks.items() if begin] + [-1]] = True
    return begins


class Subwords:
    """Ids of distinct words by a public byte-level vocabulary; the first id after it ends a text and stands before one."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.begins = begins_of(path)
        self.age = 0
        self.forget()

    def forget(self) -> None:
        self.age += 1
        self.of: dict[bytes, int] = {}  # of each distinct word met, its number
        self.odd: list[int] = []  # numbers of words that are no UTF-8, which have the ids of other words
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)  # the words' ids by number, and where each begins

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words in order; new ones are encoded."""
        try:
            return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in self.of]
        flat, starts, end = [self.flat], [self.starts], len(self.flat)
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            try:
                text = (b" " + b" ".join(some)).decode()
            except UnicodeDecodeError:
                text = "".join(" " + w.decode("utf-8", "replace") for w in some)
                self.odd += [len(self.of) + i + j for j, w in enumerate(some) if w.decode("utf-8", "replace").encode() != w]
            ids = self.encoding.encode_to_numpy(text).astype(np.int32)
            begun = np.flatnonzero(self.begins[ids])
            flat.append(ids)
            starts.append(end + np.append(begun[1:], len(ids)))
            end += len(ids)
        self.flat, self.starts = np.concatenate(flat), np.concatenate(starts)
        self.of.update(zip(new, range(len(self.of), len(self.of) + len(new))))
        if len(self.starts) != len(self.of) + 1:
            raise ValueError("a word's first id doesn't begin with a space")
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words in order, and how many each has."""
        first = self.starts[numbers]
        n = self.starts[numbers + 1] - first
        return self.flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.spread(self.numbers(words))

    def stream(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' words: their numbers, the ids of all in order with an end after each text, how many ids each word and end has, and where the ends are among words."""
        words = np.array([len(x) for x in split])
        numbers = self.numbers(list(itertools.chain.from_iterable(split)))
        ids, n = self.spread(numbers)
        at_end = np.cumsum(words + 1) - 1
        sizes = np.ones(len(n) + len(words), np.int64)
        inner = np.ones(len(sizes), bool)
        inner[at_end] = False
        sizes[inner] = n
        out = np.full(len(ids) + len(words), self.end, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes)[at_end] - 1] = False
        out[inner] = ids
        return numbers, out, sizes, at_end


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


_LOADED: dict[tuple[str, str], Subwords] = {}


def _subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Subwords(path, pattern)
    return _LOADED[path, pattern]


@dataclass
class Network:
    """One causal attention layer and one hidden layer: from the ids before to the class of the next id."""

    rank: np.ndarray  # of each id, its row of the embedding
    cls: np.ndarray  # of each id, its class
    w: dict[str, np.ndarray]
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def prepare(self) -> None:
        """With one layer, queries, keys and values depend on the id alone and are looked up."""
        e, w = self.w["e"], self.w
        one = np.ones((len(e), 1), np.float32)  # a hidden unit that is always one carries the bias of the classes
        self.tables = {"kv": np.concatenate([e @ w["k"], e @ w["v"]], axis=1), "qx": np.concatenate([(e @ w["q"]) / np.float32(np.sqrt(DIM)), e @ w["x"] + w["b"], one], axis=1)}
        self.tables |= {"o": np.pad(w["o"], ((0, 0), (0, 1))), "c": np.concatenate([w["c"], w["d"][None]])}

    def attention(self, asks: np.ndarray, keys: np.ndarray, bias: np.ndarray, first: np.ndarray) -> np.ndarray:
        a = asks @ keys.transpose(0, 2, 1)
        a += bias
        if first.any():
            a[first, :, :CONTEXT] = FAR
        return a

    def log_classes(self, before: np.ndarray, first: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the target classes (windows x STRIDE).

        before: embedding rows of the ids before (windows x CONTEXT + STRIDE); first: windows that begin a text, whose context is masked.
        """
        t, out = self.tables, np.empty(target.shape, np.float32)
        bias = position_bias(self.w["p"])
        ones = np.ones((max(CONTEXT + STRIDE, CLASSES), 1), np.float32)  # sums by products take a third of the time
        for i in range(0, len(before), AT_A_TIME):
            part, begins = before[i : i + AT_A_TIME].astype(np.intp), first[i : i + AT_A_TIME]
            kv = np.take(t["kv"], part, axis=0, mode="clip")
            qx = np.take(t["qx"], part[:, CONTEXT:], axis=0, mode="clip")
            asks, keys = qx[:, :, :DIM], kv[:, :, :DIM]
            with np.errstate(over="ignore"):
                a = self.attention(asks, keys, bias, begins)
                np.exp(a, out=a)
                total = a @ ones[: CONTEXT + STRIDE]
            if not (total.min() > 1e-30 and total.max() < 1e30):  # rare: from the start, less the greatest
                a = self.attention(asks, keys, bias, begins)
                a -= a.max(axis=2, keepdims=True)
                np.exp(a, out=a)
                total = a @ ones[: CONTEXT + STRIDE]
            o = a @ kv[:, :, DIM:]
            o /= total
            h = o.reshape(-1, DIM) @ t["o"]
            h += qx.reshape(-1, DIM + HIDDEN + 1)[:, DIM:]
            np.maximum(h, 0, out=h)
            y = h @ t["c"]
            own = y[np.arange(len(y)), target[i : i + AT_A_TIME].ravel()]
            with np.errstate(over="ignore"):
                total = (np.exp(y, out=y) @ ones[:CLASSES]).ravel()
            if not (total.min() > 1e-30 and total.max() < 1e30):
                y = h @ t["c"]
                top = y.max(axis=1)
                own -= top
                total = np.exp(y - top[:, None]).sum(axis=1)
            out[i : i + AT_A_TIME] = (own - np.log(total)).reshape(-1, STRIDE)
        return out


def position_bias(p: np.ndarray) -> np.ndarray:
    """STRIDE x (CONTEXT + STRIDE): the bias of each distance back, and the mask of what comes later."""
    back = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(CONTEXT + STRIDE)[None, :]
    return np.where(back >= 0, p[np.clip(back, 0, None)], FAR).astype(np.float32)


def windows(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of ``lengths`` ids each: ids before (windows x CONTEXT + STRIDE), first, targets, and where each id is scored.

    Each text is filled up to whole strides of its own, so its score depends on nothing else.
    """
    strides = -(-lengths // STRIDE)
    starts = np.concatenate([[0], np.cumsum(strides)])
    shift = np.repeat(starts[:-1] * STRIDE - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    place = np.arange(len(ids)) + shift
    target = np.full(starts[-1] * STRIDE, end, np.int32)
    target[place] = ids
    before = np.concatenate([np.full(CONTEXT + 1, end, np.int32), target[:-1]])
    first = np.zeros(starts[-1], bool)
    first[starts[:-1][lengths > 0]] = True
    before[CONTEXT:][starts[:-1][lengths > 0] * STRIDE] = end
    rolled = np.lib.stride_tricks.sliding_window_view(before, CONTEXT + STRIDE)[::STRIDE]
    return rolled, first, target.reshape(-1, STRIDE), place


def neighbours(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are grouped by the company they keep, and of each id its column as company: the 255 most frequent have their own."""
    order = np.argsort(-counts, kind="stable")
    others = order[ALONE:KNOWN_IDS]
    near = np.full(len(counts), 255)
    near[order[:255]] = np.arange(min(255, len(counts)))
    return others[counts[others] > 0], near


def classes_of(counts: np.ndarray, others: np.ndarray, company: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class of each id: the most frequent ids alone, the others by the company they keep (others x columns of ids before and after); ids not seen share the last."""
    cls = np.full(len(counts), CLASSES - 1, np.int32)
    cls[np.argsort(-counts, kind="stable")[:ALONE]] = np.arange(ALONE)
    k = min(CLASSES - 1 - ALONE, len(others))
    if k <= 0:
        return cls
    company = np.sqrt(company / np.maximum(1, company.sum(axis=1, keepdims=True))).astype(np.float32)
    centres = company[rng.choice(len(others), k, replace=False, p=counts[others] / counts[others].sum())]
    for _ in range(12):
        mine = (company @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for j in range(k):
            if (mine == j).any():
                centres[j] = company[mine == j].mean(axis=0)
    cls[others] = ALONE + mine
    return cls


def company_of(others: np.ndarray, size: int, *sides: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of what stands before and after: others x 512, of (id, column, count) for each side."""
    row = np.full(size, -1)
    row[others] = np.arange(len(others))
    company = np.zeros((len(others), 512), np.float64)
    for k, (ids, column, n) in enumerate(sides):
        own = row[ids] >= 0
        np.add.at(company, (row[ids][own], 256 * k + column[own]), n[own])
    return company


def begun(counts: np.ndarray, others: np.ndarray, company: np.ndarray, rng: np.random.Generator) -> Network:
    """A network before training: classes and rows by counts of ids, classes' biases by their shares, other weights at random."""
    cls = classes_of(counts, others, company, rng)
    order = np.argsort(-counts, kind="stable")
    rank = np.full(len(counts), KNOWN_IDS - 1, np.int32)
    rank[order[: KNOWN_IDS - 1]] = np.arange(KNOWN_IDS - 1)
    shapes = {"e": (KNOWN_IDS, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "x": (DIM, HIDDEN), "o": (DIM, HIDDEN), "c": (HIDDEN, CLASSES)}
    w = {n: (rng.standard_normal(s) / np.sqrt(s[0] if n != "e" else 1)).astype(np.float32) for n, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN, np.float32), "d": np.log(np.bincount(cls, weights=counts, minlength=CLASSES) + 0.5).astype(np.float32), "p": (-0.1 * np.arange(CONTEXT + STRIDE)).astype(np.float32)}
    w["d"] -= w["d"].max()
    return Network(rank, cls, w)


@dataclass
class Windows:
    """Windows of texts as a network reads them."""

    before: np.ndarray
    first: np.ndarray
    target: np.ndarray
    real: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], subwords: Subwords, network: Network) -> Windows:
        _, ids, sizes, at_end = subwords.stream([words_of(t) for t in texts])
        return cls.of_ids(ids, np.diff(np.cumsum(sizes)[at_end], prepend=0), network)

    @classmethod
    def of_ids(cls, ids: np.ndarray, lengths: np.ndarray, network: Network) -> Windows:
        before, first, target, place = windows(ids, lengths, len(network.cls) - 1)
        real = np.zeros(target.size, bool)
        real[place] = True
        return cls(network.rank[before], first, network.cls[target], real.reshape(-1, STRIDE))

    @classmethod
    def joined(cls, parts: list[Windows]) -> Windows:
        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("before", "first", "target", "real")))


class Descent:
    """Adam on windows, from a network's weights on."""

    def __init__(self, network: Network):
        self.w = dict(network.w)
        self.m, self.s = {n: np.zeros_like(x) for n, x in self.w.items()}, {n: np.zeros_like(x) for n, x in self.w.items()}
        self.steps = 0
        self.back = np.clip(np.arange(STRIDE)[:, None] + CONTEXT - np.arange(CONTEXT + STRIDE)[None, :], 0, None)

    def step(self, seen: Windows, pick: np.ndarray, rate: float) -> None:
        """Products over all windows at once, of weights side by side; a column of ones carries the biases."""
        w, back, n, length = self.w, self.back, len(pick), CONTEXT + STRIDE
        self.steps += 1
        scale = np.float32(1 / np.sqrt(DIM))
        xi, yt, ok, first = seen.before[pick], seen.target[pick].ravel(), seen.real[pick].ravel(), seen.first[pick]
        wq, wkv, wxo = w["q"] * scale, np.concatenate([w["k"], w["v"]], axis=1), np.concatenate([w["x"], w["o"]])
        x = np.take(w["e"], xi.astype(np.intp), axis=0)
        flat, z = x.reshape(-1, DIM), np.ones((n * STRIDE, 2 * DIM + 1), np.float32)
        xq = x[:, CONTEXT:].reshape(-1, DIM)
        q, kv = (xq @ wq).reshape(n, STRIDE, DIM), (flat @ wkv).reshape(n, length, 2 * DIM)
        k, v = kv[:, :, :DIM], kv[:, :, DIM:]
        bias = position_bias(w["p"])

        def attention() -> np.ndarray:
            a = q @ k.transpose(0, 2, 1)
            a += bias
            a[first, :, :CONTEXT] = FAR
            return a.reshape(-1, length)

        a, total = exp_sums(attention)
        a /= total[:, None]
        a = a.reshape(n, STRIDE, length)
        z[:, :DIM], z[:, DIM:-1] = xq, (a @ v).reshape(-1, DIM)
        h = z @ np.block([[wxo, np.zeros((2 * DIM, 1), np.float32)], [w["b"], np.ones(1, np.float32)]])
        np.maximum(h, 0, out=h)
        wc = np.concatenate([w["c"], w["d"][None]])
        y, total = exp_sums(lambda: h @ wc)
        each = ok * np.float32(1 / max(1, ok.sum()))
        y *= (each / total)[:, None]
        y[np.arange(len(y)), yt] -= each
        gc = h.T @ y
        dp = y @ w["c"].T
        dp *= h[:, :-1] > 0
        gz = z.T @ dp
        dz = dp @ wxo.T
        do = dz.reshape(n, STRIDE, 2 * DIM)[:, :, DIM:]
        ds = do @ v.transpose(0, 2, 1)
        ds *= a
        ds -= a * (ds.reshape(-1, length) @ np.ones(length, np.float32)).reshape(n, STRIDE, 1)
        dkv = np.empty((n, length, 2 * DIM), np.float32)
        dkv[:, :, :DIM], dkv[:, :, DIM:] = ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
        dq, dkv = (ds @ k).reshape(-1, DIM), dkv.reshape(-1, 2 * DIM)
        gkv = flat.T @ dkv
        g = {"q": xq.T @ dq * scale, "k": gkv[:, :DIM], "v": gkv[:, DIM:], "x": gz[:DIM], "o": gz[DIM:-1], "b": gz[-1], "c": gc[:-1], "d": gc[-1]}
        g["p"] = np.bincount(back.ravel(), weights=ds.sum(axis=0).ravel(), minlength=length)
        dx = (dkv @ wkv.T).reshape(n, length, DIM)
        dx[:, CONTEXT:] += (dz[:, :DIM] + dq @ wq.T).reshape(n, STRIDE, DIM)
        g["e"] = np.zeros_like(w["e"])
        order = np.argsort(xi, axis=None)
        asked = xi.ravel()[order]
        begin = np.flatnonzero(np.diff(asked, prepend=-1))
        g["e"][asked[begin]] = np.add.reduceat(np.take(dx.reshape(-1, DIM), order, axis=0), begin, axis=0)
        rate *= min(1, self.steps / 50) / (1 - 0.9**self.steps)
        for name, m in self.m.items():
            s, by = self.s[name], g[name].astype(np.float32)
            m *= 0.9
            m += 0.1 * by
            s *= 0.99
            np.square(by, out=by)
            by *= 0.01
            s += by
            np.sqrt(s, out=by)
            by *= 1 / np.sqrt(1 - 0.99**self.steps)
            by += 1e-8
            np.divide(m, by, out=by)
            by *= rate
            w[name] = w[name] - by


def exp_sums(logs: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows and their sums, up to a factor for each row; rows are lessened by their greatest only where single precision needs it."""
    a = logs()
    ones = np.ones(a.shape[1], np.float32)
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
        total = a @ ones
    if not (total.min() > 1e-30 and total.max() < 1e30):
        a = logs()
        a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        total = a @ ones
    return a, total


def fitted(network: Network, parts: list[Windows], seed: int = 7) -> Network:
    """The network after STEPS steps on windows drawn from those of some texts; without texts as it was."""
    if not parts:
        return network
    rng = np.random.default_rng(seed)
    seen, descent = Windows.joined(parts), Descent(network)
    for step in range(1, STEPS + 1):
        descent.step(seen, rng.integers(0, len(seen.before), BATCH), RATE * (1 - 0.9 * step / STEPS))
    return Network(network.rank, network.cls, descent.w)


def train(texts: list[bytes], subwords: Subwords, seed: int = 7) -> Network:
    """A network from some texts alone. Without texts it is an untrained one."""
    rng = np.random.default_rng(seed)
    runs = list(runs_by_size([len(t) + 1 for t in texts], AT_ONCE))
    ids = np.concatenate([subwords.stream([words_of(t) for t in texts[a:b]])[1] for a, b in runs] or [subwords.stream([[]])[1]])
    counts = np.bincount(ids, minlength=subwords.size)
    others, near = neighbours(counts)
    one = np.ones(len(ids) - 1)
    company = company_of(others, subwords.size, (ids[1:], near[ids[:-1]], one), (ids[:-1], near[ids[1:]], one))
    network = begun(counts, others, company, rng)
    return fitted(network, [Windows.of(texts[a:b], subwords, network) for a, b in runs], seed)


def encoded(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """df with the ids of its texts, each with an end after it, in place of ``text``.

    ids: their bytes, of the type that id_type tells; odd: words that are no UTF-8, by their places among the text's words, as their ids are those of other words.
    """
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(vocabulary, pattern)
        kind = id_type(subwords.size)
        for batch in batches:
            texts = raw_texts(batch)
            for a, b in runs_by_size([len(t or b"") + 1 for t in texts], AT_ONCE):
                if len(subwords.of) > REMEMBERED:
                    subwords.forget()
                split = [words_of(t) for t in texts[a:b]]
                numbers, ids, sizes, at_end = subwords.stream(split)
                odd: list[list | None] = [None] * (b - a)
                if subwords.odd:
                    at = np.flatnonzero(np.isin(numbers, subwords.odd))
                    for t, k in zip(*texts_and_places(at, np.array([len(x) for x in split]))):
                        odd[t] = [*(odd[t] or []), {"at": k, "word": split[t][k]}]
                offsets = np.append(0, np.cumsum(sizes)[at_end] * kind().itemsize).astype(np.int32)
                part = batch.slice(a, b - a)
                arrays = [pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))]), pa.array(odd, pa.list_(pa.struct([("at", pa.int32()), ("word", pa.binary())])))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], [*names, "ids", "odd"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.mapInArrow(run, ", ".join(filter(None, [kinds, "ids binary, odd array<struct<at: int, word: binary>>"])))


def id_type(size: int) -> type[np.unsignedinteger]:
    return np.uint16 if size <= 1 << 16 else np.uint32


def texts_and_places(at: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """Of places among the words of texts of n words each: the text, and the place in it."""
    ends = np.cumsum(n)
    text = np.searchsorted(ends, at, side="right")
    return text.tolist(), (at - ends[text] + n[text]).tolist()


def ids_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of encoded texts: first and last row, the ids of all in order, and how many each text has."""
    kind, texts = id_type(size), raw_texts(batch, "ids")
    for a, b in runs_by_size([len(t) for t in texts], AT_ONCE):
        lengths = np.array([len(t) for t in texts[a:b]]) // kind().itemsize
        yield a, b, np.frombuffer(b"".join(texts[a:b]), kind).astype(np.int32), lengths


@dataclass
class Tokens:
    """The words and ends of encoded texts, and a key of each that tells words apart: its ids as digits of one number (0: too many), or -1 for one that is no UTF-8."""

    ids: np.ndarray
    starts: np.ndarray  # of each token, its first id
    sizes: np.ndarray  # and how many it has
    at_end: np.ndarray  # of each text, its end among the tokens
    key: np.ndarray
    odd: dict[int, bytes]  # words that are no UTF-8, by their places

    @classmethod
    def of(cls, ids: np.ndarray, lengths: np.ndarray, odd: pa.Array, begins: np.ndarray) -> Tokens:
        starts = np.flatnonzero(begins[ids])
        sizes = np.diff(starts, append=len(ids))
        at_end = np.searchsorted(starts, np.cumsum(lengths) - 1)
        base = len(begins) + 1
        key = ids[starts].astype(np.int64) + 1
        for k in range(1, most := int(63 / np.log2(base))):
            more = np.flatnonzero(sizes > k)
            key[more] = key[more] * base + (ids[starts[more] + k] + 1)
        key[sizes > most] = 0
        found = {}
        if odd.null_count < len(odd):
            first = np.append(0, at_end[:-1] + 1).tolist()
            found = {first[t] + x["at"]: x["word"] for t, xs in enumerate(odd.to_pylist()) for x in xs or []}
            key[list(found)] = -1
        return cls(ids, starts, sizes, at_end, key, found)

    def words(self, at: np.ndarray, kind: type[np.unsignedinteger]) -> pa.Array:
        """What tells tokens of one key apart: the bytes of ids too many for a key, the word itself if it is no UTF-8, else nothing."""
        n = np.where(self.key[at] == 0, self.sizes[at], 0)
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.starts[at] - ends + n, n) + np.arange(n.sum())].astype(kind)
        offsets = np.append(0, ends * kind().itemsize).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        if self.odd:
            words = pa.array([self.odd.get(i, w) for i, w in zip(at.tolist(), words.to_pylist(), strict=True)], pa.binary())
        return words


def gone_over(df: DataFrame, network: Network, vocabulary: str, pattern: str) -> Network:
    """The network after every window of every text of df has been learned from once.

    Each task goes on from the same weights over all windows of its rows, of texts or ``encoded`` ones; what the tasks come to is averaged by their numbers of windows.
    """
    spark = df.sparkSession
    if "ids" not in df.columns:
        df = encoded(df.select("text"), vocabulary, pattern)
    sent = spark.sparkContext.broadcast(network)
    names = sorted(network.w)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        descent, rng, n = Descent(network), np.random.default_rng(7), 0
        for batch in batches:
            for _, _, ids, lengths in ids_of(batch, len(network.cls)):
                seen = Windows.of_ids(ids, lengths, network)
                order = rng.permutation(len(seen.before))
                for part in np.array_split(order, -(-len(order) // PASS_BATCH)):
                    descent.step(seen, part, PASS_RATE)
                n += len(order)
        if n:
            total = np.rint(np.concatenate([descent.w[k].ravel() for k in names]).astype(np.float64) / UNIT).astype(np.int64) * n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(sum(sent.value.w[k].size for k in names), np.int64)
        for batch in batches:
            for m, t in zip(batch.column("n").to_pylist(), batch.column("total").to_pylist(), strict=True):
                n, total = n + m, total + np.frombuffer(t, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    n, total = 0, 0
    for r in df.select("ids").mapInArrow(learn, "n long, total binary").repartition(ADDERS).mapInArrow(add, "n long, total binary").collect():
        n, total = n + r["n"], total + np.frombuffer(r["total"], np.int64)
    if not n:
        return network
    mean = np.split((total / n * UNIT).astype(np.float32), np.cumsum([network.w[k].size for k in names])[:-1])
    return Network(network.rank, network.cls, {k: x.reshape(network.w[k].shape) for k, x in zip(names, mean, strict=True)})


@dataclass
class IdCounts:
    """Probabilities of an id given its class: by the class before, and, for common pairs of ids, by the id before."""

    network: Network
    by_class: np.ndarray  # p(id | its class, the class before): classes before x ids
    keys: np.ndarray  # a table of pairs, by hash
    counts: np.ndarray
    sums: np.ndarray  # counts of the table's pairs, by the row of the id before and the class of the id

    @classmethod
    def of(cls, network: Network, class_pairs: np.ndarray, pairs: np.ndarray) -> IdCounts:
        """class_pairs: counts, classes before x ids; pairs: (id before, id, count) of the commonest pairs, in falling order."""
        member = np.eye(CLASSES)[network.cls]
        total = class_pairs.sum(axis=0) + 0.5
        own = total / (total @ member)[network.cls]
        by_class = (class_pairs + SMOOTH * own) / ((class_pairs @ member)[:, network.cls] + SMOOTH)
        pairs = pairs[network.rank[pairs[:, 0]] < KNOWN_IDS - 1][::-1]
        keys, counts = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, np.float32)
        key = pairs[:, 0] * len(network.cls) + pairs[:, 1]
        slot = _slot(key)
        keys[slot], counts[slot] = key, pairs[:, 2]  # of pairs in one slot the commonest is written last and stays
        held = keys >= 0
        sums = np.zeros((KNOWN_IDS, CLASSES), np.float64)
        np.add.at(sums, (network.rank[keys[held] // len(network.cls)], network.cls[keys[held] % len(network.cls)]), counts[held])
        return cls(network, by_class.astype(np.float32), keys, counts, sums.astype(np.float32))

    def log(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        net = self.network
        of = net.cls[ids]
        wide = self.by_class[net.cls[before], ids]
        key = before.astype(np.int64) * len(net.cls) + ids
        slot = _slot(key)
        n = np.where(self.keys[slot] == key, self.counts[slot], np.float32(0))
        return np.log((n + np.float32(PAIR_SMOOTH) * wide) / (self.sums[net.rank[before], of] + np.float32(PAIR_SMOOTH)))


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


@dataclass
class WordCounts:
    """Counts of common words. Of words in one slot of the table the commonest stays; the others are found as 0, and joined like all that are not common."""

    keys: np.ndarray
    counts: np.ndarray
    others: dict[tuple[int, bytes], int]  # of words that have no key of their own

    @classmethod
    def of(cls, key: np.ndarray, word: list[bytes], n: np.ndarray) -> WordCounts:
        """In falling order of counts."""
        own = key > 0
        keys, counts = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, np.int64)
        slot = _slot(key[own][::-1])
        keys[slot], counts[slot] = key[own][::-1], n[own][::-1]
        return cls(keys, counts, {(k, w): c for k, w, c in zip(key[~own].tolist(), itertools.compress(word, ~own), n[~own].tolist(), strict=True)})

    def get(self, tokens: Tokens, kind: type[np.unsignedinteger]) -> np.ndarray:
        slot = _slot(tokens.key)
        c = np.where(self.keys[slot] == tokens.key, self.counts[slot], 0)
        at = np.flatnonzero(tokens.key <= 0)
        if self.others and len(at):
            c[at] = [self.others.get(x, 0) for x in zip(tokens.key[at].tolist(), tokens.words(at, kind).to_pylist(), strict=True)]
        return c


@dataclass
class Scorer:
    """All that scoring needs; its size is bounded by the vocabulary's and by COMMON_WORDS."""

    network: Network
    ids: IdCounts
    counts: WordCounts
    tokens: int
    distinct: int
    ends: int
    begins: np.ndarray

    def score(self, ids: np.ndarray, lengths: np.ndarray, odd: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
        """Of each encoded text: tokens, and among common words and the end: known ones, log10 sum of the base and the model's; and each other word with its natural log-probability by the network."""
        net, end, kind = self.network, len(self.begins) - 1, id_type(len(self.begins))
        tokens = Tokens.of(ids, lengths, odd, self.begins)
        at_end = tokens.at_end
        starts = np.append(0, at_end[:-1] + 1)
        before, first, target, place = windows(ids, lengths, end)
        logs = net.log_classes(net.rank[before], first, net.cls[target]).ravel()[place]
        logs = logs + self.ids.log(before[:, CONTEXT:].ravel()[place], ids)
        word = np.add.reduceat(logs.astype(np.float64), tokens.starts)
        c = self.counts.get(tokens, kind)
        c[at_end] = self.ends
        counted = np.log(np.maximum(c, 1) * (COUNT_SHARE / max(1, self.tokens)) + (1 - COUNT_SHARE) * np.exp(word))
        mixed = np.where(c > 0, counted, np.log(1 - COUNT_SHARE) + word) / np.log(10)
        base = np.where(c > 0, np.log10((c + 1) / (self.tokens + self.distinct + 1)), 0.0)
        other = c == 0
        other[at_end] = False
        known, base, mixed, others = (np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, np.where(other, 0.0, mixed), other.astype(np.int64)))
        at = np.flatnonzero(other)
        rest = pa.StructArray.from_arrays([pa.array(tokens.key[at]), tokens.words(at, kind), pa.array(word[at])], ["key", "word", "log"])
        return [at_end - starts + 1, known, base, mixed], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(others)), pa.int32()), rest)


def score_texts(df: DataFrame, vocabulary: str, pattern: str, mod: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words, A-Z in lower case, and one end. A word's probability in ``score`` is,
    for a word of the training texts, COUNT_SHARE of its share of the training tokens, and for the rest the network's:
    the product over its subword ids of p(class | ids before) p(id | class, id before).

    Ids are read in windows of CONTEXT + STRIDE; each is scored once, in the window where it has
    CONTEXT ids or its text's whole beginning before it. Counts, classes of ids and weights are
    learned from all training rows: weights are begun on TRAIN_TEXTS of them, then every row is gone over once (``gone_over``). Null and empty texts have the
    end alone. Repeated rows get equal scores; rows with a null id are trained on; extra columns
    are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (~in_training(id_col, mod, held)).alias("held_out"), F.xxhash64(id_col).alias("id_hash"), F.xxhash64(text).alias("text_hash"), F.octet_length(F.coalesce(text, F.lit(""))).alias("bytes"), text.alias("text"))
    # Words are encoded once; all that follows reads ids.
    rows = written(encoded(rows, vocabulary, pattern), "lm-ids", "zstd")
    learned = rows.where("not held_out")
    begins = begins_of(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, kind = len(begins), id_type(len(begins))
        words, pairs, others = Counted(2 * AT_ONCE), Counted(2 * PAIRS), Counter()

        def out(key: np.ndarray | None, word: list[bytes] | None, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            arrays = [pa.nulls(len(n), pa.int64()) if key is None else pa.array(key, pa.int64()), pa.array(word or [None if key is None else b""] * len(n), pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(pairs // size, pa.int32()), pa.array(pairs % size, pa.int32()), pa.array(n, pa.int64())], ["key", "word", "before", "of", "n"])

        def of_words(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return out(keys, None, np.zeros(len(n), np.int64), n)

        def of_others() -> pa.RecordBatch:
            return out(np.array([k for k, _ in others]), [w for _, w in others], np.zeros(len(others), np.int64), np.fromiter(others.values(), np.int64, len(others)))

        def of_pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return out(None, None, keys, n)

        for batch in batches:
            for a, b, ids, lengths in ids_of(batch, size):
                tokens = Tokens.of(ids, lengths, batch.column("odd").slice(a, b - a), begins)
                inner = np.ones(len(tokens.key), bool)
                inner[tokens.at_end] = False
                yield from itertools.starmap(of_words, words.add(tokens.key[inner & (tokens.key > 0)]))
                at = np.flatnonzero(tokens.key <= 0)
                others.update(zip(tokens.key[at].tolist(), tokens.words(at, kind).to_pylist(), strict=True))
                if len(others) > REMEMBERED:
                    yield of_others()
                    others.clear()
                ids = ids.astype(np.int64)
                # An end is before each text, as it is after the text before.
                yield from itertools.starmap(of_pairs, pairs.add(np.append(size - 1, ids[:-1]) * size + ids))
        yield of_words(*words.all())
        yield of_others()
        yield of_pairs(*pairs.all())

    counted = written(learned.select("ids", "odd").mapInArrow(count, "key long, word binary, before int, of int, n long").groupBy("key", "word", "before", "of").agg(F.sum("n").alias("n")), "lm-counts")
    words = counted.where("key is not null").select("key", "word", F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = words.orderBy(F.desc("c"), "key", "word").limit(COMMON_WORDS).toArrow()
    id_pairs = counted.where("key is null").select("before", "of", "n")
    # What comes to the driver: a row for each id, KNOWN_IDS times 256 for either side, PAIRS rows, and at most classes times ids.
    by_id = id_pairs.groupBy("of").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(begins), np.int64)
    counts[by_id["of"].to_numpy()] = by_id["n"].to_numpy()
    others, near = neighbours(counts)
    columns = spark.createDataFrame(pa.table({"_near": np.arange(len(near), dtype=np.int32), "column": near.astype(np.int32)}))
    grouped = spark.createDataFrame(pa.table({"_id": others.astype(np.int32)}))

    def beside(own: str, other: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = id_pairs.join(F.broadcast(grouped), F.col(own) == F.col("_id")).join(F.broadcast(columns), F.col(other) == F.col("_near"))
        found = met.groupBy("_id", "column").agg(F.sum("n").alias("n")).orderBy("_id", "column").toArrow()
        return tuple(found[c].to_numpy() for c in ("_id", "column", "n"))

    start = begun(counts, others, company_of(others, len(counts), beside("of", "before"), beside("before", "of")), np.random.default_rng(7))
    order = ["id_hash", "text_hash"]
    drawn, taken = learned.select(*order, "bytes").where(F.col("bytes") <= TRAIN_BYTES).orderBy(*order).limit(TRAIN_TEXTS).collect(), []
    for r in drawn:
        if sum(n for *_, n in taken) + r["bytes"] <= TRAIN_BYTES:
            taken.append((r["id_hash"], r["text_hash"], r["bytes"]))
    names = spark.createDataFrame(taken, "id_hash long, text_hash long, bytes int").select(*order)
    sample = learned.join(F.broadcast(names.distinct()), order).groupBy(*order).agg(F.first("ids").alias("ids")).repartition(1).sortWithinPartitions(*order).select("ids")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fitted(start, [Windows.of_ids(ids, lengths, start) for batch in batches for _, _, ids, lengths in ids_of(batch, len(begins))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["network"])

    # One task reads the sample, which is bounded, and begins on one core; a lost executor's task begins anew. Then all tasks go over all rows.
    network = pickle.loads(sample.mapInArrow(fit, "network binary").first()["network"]) if taken else start
    network = gone_over(learned, network, vocabulary, pattern)
    network.prepare()
    top_pairs = id_pairs.orderBy(F.desc("n"), "before", "of").limit(PAIRS).toArrow()
    classes = spark.createDataFrame(pa.table({"before": np.arange(len(network.cls), dtype=np.int32), "class": network.cls}))
    by_class = id_pairs.join(F.broadcast(classes), "before").groupBy("class", "of").agg(F.sum("n").alias("n")).toArrow()
    class_pairs = np.zeros((CLASSES, len(network.cls)))
    class_pairs[by_class["class"].to_numpy(), by_class["of"].to_numpy()] = by_class["n"].to_numpy()
    ends = int(class_pairs[:, -1].sum())
    tokens, distinct = total + ends, distinct + (ends > 0)
    pairs = np.stack([top_pairs[c].to_numpy().astype(np.int64) for c in ("before", "of", "n")], axis=1)
    of_words = WordCounts.of(common["key"].to_numpy(), common["word"].to_pylist(), common["c"].to_numpy())
    sent = spark.sparkContext.broadcast(Scorer(network, IdCounts.of(network, class_pairs, pairs), of_words, tokens, distinct, ends, begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, lengths in ids_of(batch, len(sent.value.begins)):
                part = batch.slice(a, b - a)
                plain, rest = sent.value.score(ids, lengths, part.column("odd"))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), part.column("held_out"), *map(pa.array, plain), rest], ["row", "id", "held_out", "n_tokens", "known", "base", "score", "rest"])

    scored = written(rows.select("row", "id", "held_out", "ids", "odd").mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<struct<key: long, word: binary, log: double>>"), "lm-scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(words, ["key", "word"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10((F.col("c") + 1) / F.lit(float(tokens + distinct + 1)))
    # log(p + q) as the greater of both logs and a rest, since the network's probability may be less than a double holds
    count, net = F.log(F.col("c") * F.lit(COUNT_SHARE / max(1, tokens))), F.col("log") + F.lit(float(np.log(1 - COUNT_SHARE)))
    both = F.when(F.col("c") > 0, F.greatest(count, net) + F.log1p(F.exp(-F.abs(count - net)))).otherwise(net)
    sums = rare.groupBy("row").agg(F.sum(log).alias("more"), F.count_if(F.col("c") > 0).alias("also"), (F.sum(both) / F.lit(float(np.log(10)))).alias("mixed"))
    return scored.drop("rest").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + (0.0 if ends else float(-np.log10(tokens + distinct + 1)))).alias("base_score"), (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )


class Counted:
    """Counts of whole numbers, that are handed over when there are more distinct ones than ``most``."""

    def __init__(self, most: int):
        self.most, self.keys, self.counts = most, np.empty(0, np.int64), np.empty(0, np.int64)
        self.more: list[np.ndarray] = []

    def add(self, more: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.more.append(more)
        if sum(map(len, self.more)) > AT_ONCE:
            found = self.all()
            if len(found[0]) > self.most:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
                yield found

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([self.keys[:0], *self.more]), return_counts=True)
        keys, counts = np.concatenate([self.keys, new]), np.concatenate([self.counts, n])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        keys = keys[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts, self.more = keys[begin], np.add.reduceat(counts[order], begin) if len(begin) else counts, []
        return self.keys, self.counts
