"""Quality of documents by weak supervision: rules vote or abstain, and EM weighs them. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, written

#: Words in a window whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: name: (value of a document, votes bad if above, votes good if below; else the rule abstains).
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "repeats": ("n_repeat_words / n_words", 0.25, None),
    "symbols": ("n_symbols / n_words", 0.2, None),
    "copied_lines": ("n_dup_lines / greatest(n_lines, 10)", 0.3, None),
    "monotony": ("n_words / n_distinct_words - sqrt(n_words) / 10", 2.0, None),
    "shouting": ("n_upper / greatest(n_letters, 1)", 0.4, None),
    "exclaiming": ("n_exclaims / n_words", 0.15, None),
    "wordless": ("1 - n_letters / word_chars", 0.3, 0.15),
    "odd_words": ("abs(word_chars / n_words - 6.5)", 5.5, 4.0),
    "few_words": ("20 / n_words", None, 0.4),
}
#: First guesses of the share of good documents and of how often a vote is right.
SHARE, ACCURACY, ROUNDS = 0.85, 0.9, 60
#: Weight of the first guess of the share, in documents for each document: rules that only blame tell how many
#: documents are bad, but not that the others are good, so the guess must count at any size.
SHARE_WEIGHT = 1.0
#: Accuracies are kept between these, those of good votes not under the share of good documents and those of bad
#: votes not under that of bad ones: a rule is never taken to vote against its own meaning.
LEAST, MOST = 0.6, 0.995
#: Documents' worth of weight that the first guess of an accuracy has.
GUESS = 20.0


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """One row per row of df with the counts that rules are made of; a null text has no words and no lines.

    Repeats: the hashes of all 8-word windows are compared within the row. If any occurs twice,
    (hash, place) pairs are sorted; neighbours of equal hash mark their places, and each marked
    place covers the words from it to the next marked place, 8 at most.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    along = [F.col(carried).alias("carried_row")] if carried else []
    d = df.select(F.col(id_col).alias("id"), raw.alias("text"), *along).withColumn("bare", F.btrim("text", F.lit(SPACES)))
    d = d.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", "[ \\t-\\r]+")))
    d = d.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_exclaims"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("words"),
        *["carried_row"] * len(along),
    )
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("windows", windows).withColumn("repeated", F.size("windows") > F.size(F.array_distinct("windows")))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.col("repeated"), placed))
    same = lambda j, x: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
    marked = F.array_sort(F.transform(F.filter("placed", lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"]))
    d = d.withColumn("marked", F.when(F.col("repeated"), marked))
    covered = F.aggregate(F.transform("marked", lambda p, j: F.least(F.coalesce(F.get("marked", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    lines = F.size("lines").cast("long")
    return d.select(
        "id", "n_words", "word_chars", "n_symbols", (lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_exclaims", "n_letters", "n_upper", lines.alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"), *["carried_row"] * len(along),
    )


def vote(name: str) -> Column:
    """1: good, 0: bad, -1: abstains, as it does where there is nothing to measure."""
    value, bad, good = RULES[name]
    x = F.expr(f"case when n_words > 0 then {value} end")
    return F.when(x > F.lit(bad), 0).when(x < F.lit(good), 1).otherwise(-1)


def logit(p: float) -> float:
    return math.log(p / (1 - p))


Right = list[tuple[float, float]]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, Right]:
    """EM over counted vote patterns: the share of good documents, and of each rule how often its good and its bad votes are right.

    An abstention says nothing. Without patterns the first guesses come back.
    """
    share, right = SHARE, [(ACCURACY, ACCURACY)] * len(RULES)
    documents = sum(n for _, n in patterns)
    for _ in range(ROUNDS if documents else 0):
        good_of = [(votes, n, posterior(votes, share, right)) for votes, n in patterns]
        share = (SHARE_WEIGHT * documents * SHARE + sum(n * g for _, n, g in good_of)) / (SHARE_WEIGHT * documents + documents)
        new = []
        for r in range(len(RULES)):
            on_good = (GUESS * ACCURACY + sum(n * g for v, n, g in good_of if v[r] == 1)) / (GUESS + sum(n for v, n, _ in good_of if v[r] == 1))
            on_bad = (GUESS * ACCURACY + sum(n * (1 - g) for v, n, g in good_of if v[r] == 0)) / (GUESS + sum(n for v, n, _ in good_of if v[r] == 0))
            new.append((min(MOST, max(share, on_good)), min(MOST, max(LEAST, 1 - share, on_bad))))
        right = new
    return share, right


def weights(share: float, right: Right) -> Right:
    """Of each rule, the log-odds of good that its good and its bad vote add to those of the share."""
    return [(logit(g) - logit(share), -logit(b) - logit(share)) for g, b in right]


def posterior(votes: tuple[int, ...], share: float, right: Right) -> float:
    odds = logit(share) + sum(w[0] if v else w[1] for v, w in zip(votes, weights(share, right), strict=True) if v >= 0)
    return 1 / (1 + math.exp(-odds))


def judge_quality(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """One row per row of df: id, the counts, base_failed, quality (posterior probability of a good document) and kept.

    The corpus enters through the counts of vote patterns, of which there are at most 3 to the
    number of rules however many documents there are; those counts are over all rows of df.
    base_failed (under 20 words, or over 30 % of words in repeated 8-word windows) settles kept;
    otherwise quality >= threshold does. Null and empty texts fail the base. Equal texts get equal
    verdicts; null ids stay null; an empty table gives an empty result; other columns are not read.
    ``carried`` names a column of df that goes along.
    """
    counted = written(features(df, id_col, text_col, carried), "quality-features")
    names = list(RULES)
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in counted.groupBy(*[vote(n).alias(n) for n in names]).count().collect()]
    share, right = fit(sorted(patterns))
    odds = F.lit(logit(share))
    for name, (good, bad) in zip(names, weights(share, right), strict=True):
        v = vote(name)
        odds = odds + F.when(v == 1, F.lit(good)).when(v == 0, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return counted.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), F.round(quality, 9).alias("quality"),
        *([F.col("carried_row").alias(carried)] if carried else []),
    )


def keep_good(df: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that judge_quality keeps. Rows are judged one by one, so null and repeated ids are like any other; nothing is shuffled."""
    judged = judge_quality(df.withColumn("_kept_row", F.struct(*df.columns)), threshold, id_col, text_col, "_kept_row")
    return judged.where("kept").select("_kept_row.*")
