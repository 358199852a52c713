"""Languages of texts: script ranges narrow the candidates, and Viterbi over scores of words labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_training, let_go, raw_texts, runs_by_size

#: Labelled documents that a model is fitted on at most, chosen by a hash of their id.
TRAIN_DOCS = 4_000
#: Bytes of each order of n-gram, and bits of its table.
ORDERS, BITS = (3, 5), 17
#: A word's score for a language is held within this of the mean over languages.
CLIP = 4.0
#: What a change of language from one word to the next costs.
SWITCH = 20.0
#: A language whose script share is under this doesn't use the script.
SCRIPT_SHARE = 0.01
AT_ONCE = 1_000_000

#: Scripts by ranges of the first byte of a UTF-8 character: (first, last, script).
SCRIPT_RANGES = [
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC2, 0xCA, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD4, "cyrillic"), (0xD5, 0xD5, "armenian"),
    (0xD6, 0xD7, "hebrew"), (0xD8, 0xDD, "arabic"), (0xE0, 0xE0, "indic"), (0xE1, 0xE2, "other"), (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xEE, 0xF4, "other"),
]
SCRIPTS = sorted({s for *_, s in SCRIPT_RANGES})
SCRIPT_BIT = np.zeros(256, np.uint16)
for _first, _last, _script in SCRIPT_RANGES:
    SCRIPT_BIT[_first : _last + 1] = 1 << SCRIPTS.index(_script)
#: ASCII other than letters becomes space, capitals become small.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

@cache
def character_kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark that belongs to the letter before it, 0 for anything else."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            kinds[c] = 2 if kind == "L" else 1
    return kinds


def character_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the characters of more than one byte begin in UTF-8 that ends in four bytes of ASCII, their lengths and code points."""
    lead = np.flatnonzero(codes >= 0xC0)
    size = 2 + (codes[lead] >= 0xE0).astype(np.int64) + (codes[lead] >= 0xF0)
    point = codes[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = (point[more] << 6) | (codes[lead[more] + k] & 0x3F)
    return lead, size, np.minimum(point, 0x10FFFF)



@dataclass
class Words:
    """The words of some joined texts: bounds in the buffer, the text of each, n-gram slots of their letters."""

    first: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    at: np.ndarray  # where in the letters each word begins
    scripts: np.ndarray
    slots: list[np.ndarray]


def cut(texts: list[bytes], starts: np.ndarray) -> Words:
    """Words of the texts, joined as in b' '.join; starts[i]: where text i begins, counted from the buffer's second byte on."""
    buffer = b" " + b" ".join(texts).translate(FOLD) + b" " * 8
    codes = np.frombuffer(buffer, np.uint8)
    if not buffer.isascii():
        codes = codes.copy()
        after = np.flatnonzero(codes[:-1] == 0xC3) + 1
        codes[after[(codes[after] >= 0x80) & (codes[after] <= 0x9E) & (codes[after] != 0x97)]] += 0x20
        lead, size, point = character_starts(codes)
        kind = character_kinds()[point]
        for k in range(4):
            codes[(lead + k)[(kind == 0) & (size > k)]] = 0x20
        codes = _without_lone_marks(codes, lead[kind == 1], lead[kind == 2])
        buffer = codes.tobytes()
    letters = codes != 0x20
    edge = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    first, stop = edge[::2], edge[1::2]
    place = np.flatnonzero(letters)
    at = np.concatenate([[0], np.cumsum(stop - first)[:-1]]).astype(np.int64) if len(first) else np.empty(0, np.int64)
    window = np.ndarray((len(buffer) - 8,), "<u8", buffer, strides=(1,))[place - 1] if len(place) else np.empty(0, np.uint64)
    slots = [(((window & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32) for n in ORDERS]
    scripts = np.bitwise_or.reduceat(SCRIPT_BIT[codes[place]], at) if len(at) else np.empty(0, np.uint16)
    return Words(first - 1, stop - 1, np.searchsorted(starts, first - 1, "right") - 1, at, scripts, slots)


def _without_lone_marks(codes: np.ndarray, marks: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The same without words that have marks but no letter."""
    if not len(marks):
        return codes
    inside = codes != 0x20
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, stop = edge[::2], edge[1::2]
    real = (codes < 0x80) & inside
    real[letters] = True
    total = np.concatenate([[0], np.cumsum(real)])
    for a, b in zip(first[total[stop] == total[first]].tolist(), stop[total[stop] == total[first]].tolist(), strict=True):
        codes[a:b] = 0x20
    return codes


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # of each order, scores by slot and language
    allowed: np.ndarray  # by bit of script and language

    def scores(self, words: Words) -> np.ndarray:
        """Of each word and language. Languages that don't use its scripts get the least; a word in scripts of none gets zeros."""
        total = np.zeros((len(words.at), len(self.langs)), np.float32)
        if not len(words.at):
            return total
        for table, slot in zip(self.tables, words.slots, strict=True):
            total += np.add.reduceat(table[slot], words.at, axis=0)
        total -= total.mean(axis=1, keepdims=True)
        np.clip(total, -CLIP, CLIP, out=total)
        masks, which = np.unique(words.scripts, return_inverse=True)
        fits = np.ones((len(masks), len(self.langs)), bool)
        for i, mask in enumerate(masks):
            for bit in range(len(SCRIPTS)):
                if mask >> bit & 1:
                    fits[i] &= self.allowed[bit]
        total[~fits[which]] = -CLIP
        total[~fits.any(axis=1)[which]] = 0
        return total


def learn(df: DataFrame, docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A naive Bayes model of n-grams from at most ``docs`` labelled rows; rows without text or label teach nothing.

    The rows are those of the least hash of their id, of equal ids those of the least hash of text and label, so the draw is
    the same for any partitioning. A model grows with the number of labels, 1 MB each; there can't be more than ``docs``.
    """
    labelled = df.select(F.struct(F.xxhash64(id_col).alias("id"), F.xxhash64(text_col, lang_col).alias("row")).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    drawn = labelled.select("h").orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    sample = labelled.where(F.col("h") <= F.struct(F.lit(drawn["id"]).cast("long"), F.lit(drawn["row"]).cast("long"))).limit(docs).select("lang", "text") if drawn is not None else labelled.limit(0).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("langid")
        seen: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            texts, langs = raw_texts(batch), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                into = seen.setdefault(lang, [np.zeros(1 << BITS, np.int64) for _ in ORDERS] + [np.zeros(len(SCRIPTS) + 1, np.int64)])
                for a, b in runs_by_size([len(t) for t in own], AT_ONCE):
                    words = cut(own[a:b], np.zeros(1, np.int64))
                    for k, slot in enumerate(words.slots):
                        into[k] += np.bincount(slot, minlength=1 << BITS)
                    into[-1] += [*[int((words.scripts >> bit & 1).sum()) for bit in range(len(SCRIPTS))], len(words.at)]
        for lang, arrays in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [np.concatenate(arrays).astype(np.int64).tobytes()]})

    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(4).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    langs = sorted(total)
    size = 1 << BITS
    tables = [np.stack([np.log((total[x][k * size : (k + 1) * size] + 0.2) / (total[x][k * size : (k + 1) * size].sum() + 0.2 * size)) for x in langs], axis=1).astype(np.float32) for k in range(len(ORDERS))] if langs else []
    scripts = np.array([total[x][len(ORDERS) * size :] for x in langs]).reshape(len(langs), len(SCRIPTS) + 1)
    return Model(langs, tables, (scripts[:, :-1] >= np.maximum(1, SCRIPT_SHARE * scripts[:, -1:])).T)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels (texts x words) of the best paths through scores (texts x words x languages); words beyond a text have zeros."""
    texts, n, langs = scores.shape
    back = np.empty((n, texts, langs), np.int16)
    own = np.arange(langs, dtype=np.int16)
    state = scores[:, 0].astype(np.float64)
    rows = np.arange(texts)
    for t in range(1, n):
        top = state.argmax(axis=1)
        change = state[rows, top][:, None] - switch
        stays = state >= change
        back[t] = np.where(stays, own, top[:, None])
        state = np.where(stays, state, change) + scores[:, t]
    labels = np.empty((texts, n), np.int16)
    labels[:, -1] = state.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        labels[:, t - 1] = back[t][rows, labels[:, t]]
    return labels


def label(scores: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The language of each word on its text's best path; ``text`` numbers each word's text and rises.

    Let one language be best in sum. If no other one gains SWITCH / 2 over it on any stretch of
    words, then no path with m changes gains m * SWITCH, so the whole text has that language.
    The other texts go through Viterbi, together with texts of like length.
    """
    first = np.flatnonzero(np.diff(text, prepend=-1))
    lengths = np.diff(np.append(first, len(text)))
    best = np.add.reduceat(scores.astype(np.float64), first, axis=0).argmax(axis=1)
    own = np.repeat(best, lengths)
    labels = own.astype(np.int16)
    mixed = np.zeros(len(first), bool)
    far = 4.0 * CLIP * (len(text) + 1)  # each text begins below whatever the one before it reached
    fall = np.repeat(np.arange(len(first)) * far, lengths)
    base = scores[np.arange(len(text)), own]
    for k in range(scores.shape[1]):
        gain = (scores[:, k] - base).astype(np.float64)
        after = np.cumsum(gain) - fall
        lowest = np.minimum.accumulate(after - gain)
        mixed |= np.maximum.reduceat(after - lowest, first) >= SWITCH / 2
    order = np.flatnonzero(mixed)[np.argsort(lengths[mixed], kind="stable")]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * lengths[order[j]] <= 200_000 and lengths[order[j]] <= 2 * lengths[order[i]] + 16:
            j += 1
        part = order[i:j]
        block = np.zeros((len(part), lengths[part].max(), scores.shape[1]), np.float32)
        for r, d in enumerate(part):
            block[r, : lengths[d]] = scores[first[d] : first[d] + lengths[d]]
        for r, found in zip(part, viterbi(block), strict=True):
            labels[first[r] : first[r] + lengths[r]] = found[: lengths[r]]
        i = j
    return labels


def spans_of(model: Model, texts: list[bytes]) -> list[tuple[str, float, list[dict], float]]:
    """Of each text: its main language, its letters' share of all letters, the spans (lang, first, stop: bytes of the text), and the share of letters of all languages."""
    result: list[tuple[str, float, list[dict], float]] = [("und", 0.0, [], 0.0)] * len(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64) if texts else np.zeros(1, np.int64)
    words = cut(texts, starts)
    if not len(words.at) or not model.langs:
        return result
    scores = model.scores(words)
    labels = label(scores, words.text)
    size, known = words.stop - words.first, (scores != 0).any(axis=1)
    texts_at = np.flatnonzero(np.diff(words.text, prepend=-1))
    n = len(model.langs)
    text = words.text[texts_at]
    row = np.repeat(np.arange(len(texts_at)), np.diff(np.append(texts_at, len(labels))))
    share = np.bincount(row * n + labels, weights=size * known, minlength=len(texts_at) * n).reshape(-1, n)
    letters = np.bincount(row, weights=size, minlength=len(texts_at))
    turn = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(words.text, prepend=-1) != 0))
    ends = np.append(turn[1:], len(labels)) - 1
    spans: dict[int, list[dict]] = {}
    for a, b in zip(turn, ends, strict=True):
        t = int(words.text[a])
        spans.setdefault(t, []).append({"lang": model.langs[labels[a]], "first": int(words.first[a] - starts[t]), "stop": int(words.stop[b] - starts[t])})
    for t, s, total in zip(text, share, letters, strict=True):
        result[int(t)] = (model.langs[int(s.argmax())], float(min(1.0, s.max() / total)), spans[int(t)], float(min(1.0, s.sum() / total)))
    return result


def keep_identified(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of df, with all their columns, whose text has letters, ``least`` or more of them in its spans of any learned language: a text of several languages stays. Rows are judged one by one, so null and repeated ids are like any other."""
    found = identify(df.withColumn("_kept_row", F.struct(*df.columns)), carried="_kept_row", with_share=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("share") >= least)).select("_kept_row.*")


def identify(df: DataFrame, model: Model | None = None, with_spans: bool = False, carried: str | None = None, mod: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_share: bool = False) -> DataFrame:
    """One row per row of df: id, held_out, lang_pred, score and n_spans; with_spans adds the spans themselves,
    with_share the share of letters that are in spans of any language and in scripts that language uses.

    ``carried`` names a column of df that goes along; if it is a struct that has the text as ``text_col``, that is the text read. Without a model one is learned from the labelled rows of df that are not held out. Only the
    text counts for a prediction, and all of it. lang_pred is the language with most letters;
    score is the share of the text's letters in its spans that are in scripts the language uses.
    Null texts, texts without letters, and all texts if nothing could be learned, are 'und' with
    score 0. Ties go to the language that sorts first. Extra columns are not read.
    """
    model = model or learn(df.where(in_training(id_col, mod, held)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the labels and BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("langid")
        for batch in batches:
            texts = [t or b"" for t in (batch.column(carried).field(inside).cast(pa.binary()).to_pylist() if inside is not None else raw_texts(batch))]
            found = [x for a, b in runs_by_size([len(t) for t in texts], AT_ONCE) for x in spans_of(sent.value, texts[a:b])]
            columns = [batch.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([len(x[2]) for x in found], pa.int32())]
            spans = [pa.array([x[2] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("stop", pa.int64())])))] if with_spans else []
            share = [pa.array([x[3] for x in found], pa.float64())] if with_share else []
            along = [batch.column(carried)] if carried else []
            yield pa.RecordBatch.from_arrays(columns + spans + share + along, ["id", "lang_pred", "score", "n_spans", *["spans"] * with_spans, *["share"] * with_share, *[carried] * len(along)])

    # A text that goes along anyway is read there and not moved twice.
    parts = df.schema[carried].dataType.names if carried and isinstance(df.schema[carried].dataType, T.StructType) else []
    inside = parts.index(text_col) if text_col in parts and df.schema[carried].dataType[text_col].dataType == T.StringType() else None
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, n_spans int" + ", spans array<struct<lang: string, first: bigint, stop: bigint>>" * with_spans + ", share double" * with_share
    along = [carried] if carried else []
    schema = T.StructType([*T.StructType.fromDDL(schema).fields, *[T.StructField(c, df.schema[c].dataType) for c in along]])
    text = [F.col(text_col).cast("string").alias("text")] if inside is None else []
    rows = df.select(F.col(id_col).alias("id"), *text, *along).mapInArrow(run, schema)
    return rows.select(F.col("id").alias(id_col), (~in_training("id", mod, held)).alias("held_out"), "lang_pred", "score", "n_spans", *["spans"] * with_spans, *["share"] * with_share, *along)
