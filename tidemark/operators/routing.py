"""Choosing by keyword: routes, inverted index, budgets, tool schemas and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.stages import kept

#: Commands that destroy.
DESTRUCTIVE = [r"rm\s+-[a-z]*r[a-z]*f", r"drop\s+(table|database)", r"git\s+push\s+.*--force", r"mkfs", r"dd\s+if="]
MOST_PARAMETERS = 6
#: Items that may be pinned to every prompt.
MOST_PINNED = 100
#: Items for each of the k wanted that the first, shortest lists should give.
HEADS = 32


def route(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first of the rules (route, keywords) of which the text holds a keyword, as a substring and without regard to case; else, and for null, the default."""
    low, out = F.lower(text), None
    for name, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct words of each key, in lower case."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))
    return df.select(key, F.explode(words).alias("term")).distinct()


def postings(catalog: DataFrame, item_key: str, text: str = "text", weighted: bool = True) -> DataFrame:
    """(term, item, weight, items): each item's terms with the term's weight, 1,000 times the logarithm of how rare it is (or 1), and how many items have it."""
    found = terms(catalog, item_key, text)
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    total = catalog.select(F.count_distinct(item_key).alias("total"))  # one row
    weight = F.round(1000 * F.ln(1 + F.col("total") / F.col("items"))).cast("bigint") if weighted else F.lit(1).cast("bigint")
    weights = counts.join(F.broadcast(total)).select("term", "items", weight.alias("weight"))
    return found.join(weights, "term")


def essential(wanted: DataFrame, prompt_key: str, needed: str) -> DataFrame:
    """Of each prompt's terms (term, weight, items) those of whose lists at least one must hold an item whose score reaches ``needed``.

    Terms are set aside, from those of the longest lists on, as long as their weights come to less than ``needed``: an item that has these alone can't reach it.
    """
    w = W.partitionBy(prompt_key).orderBy(F.desc("items"), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    return wanted.withColumn("_aside", F.sum("weight").over(w)).where(F.col("_aside") >= F.col(needed)).drop("_aside")


def ranked_matches(prompts: DataFrame, catalog: DataFrame, k: int, prompt_key: str, item_key: str, text: str = "text", weighted: bool = True) -> DataFrame:
    """For each prompt the k items whose shared terms weigh most; ties by item key. The same as from all pairs that share a term, without making them.

    First the heads of each prompt's shortest lists give some items, whose k-th best score so far is a bound that the answer
    reaches. Terms of the longest lists that together weigh less can't bring an item into the answer: these, the stop words, are set aside and
    not joined. The other lists are added up, which raises the bound; items that reach it with all that was set aside are looked up in
    the long lists as well. Where there are fewer than k items nothing is set aside. Both sides' terms are written once, as several steps read them.
    """
    listed = kept(postings(catalog, item_key, text, weighted))
    heads = listed.withColumn("_h", F.row_number().over(W.partitionBy("term").orderBy(item_key))).where(F.col("_h") <= HEADS * k)
    wanted = kept(terms(prompts, prompt_key, text).join(listed.select("term", "weight", "items").distinct(), "term"))
    short = W.partitionBy(prompt_key).orderBy("items", "term").rowsBetween(W.unboundedPreceding, -1)
    first = wanted.withColumn("_had", F.coalesce(F.sum("items").over(short), F.lit(0))).where(F.col("_had") < HEADS * k)
    best = W.partitionBy(prompt_key).orderBy(F.desc("part"), item_key)
    parts = lambda some, lists: some.join(lists.select("term", item_key), "term").groupBy(prompt_key, item_key).agg(F.sum("weight").alias("part"))
    bound = parts(first, heads).withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select(prompt_key, F.col("part").alias("_needed"))
    bounded = wanted.join(bound, prompt_key, "left").withColumn("_needed", F.coalesce("_needed", F.lit(0)))
    used = essential(bounded, prompt_key, "_needed")
    aside = bounded.join(used.select(prompt_key, "term"), [prompt_key, "term"], "left_anti").select(prompt_key, "term", F.col("weight").alias("more"))
    rest = aside.groupBy(prompt_key).agg(F.sum("more").alias("_rest"))
    summed = parts(used, listed).withColumn("_n", F.row_number().over(best))
    raised = F.coalesce(F.max(F.when(F.col("_n") == k, F.col("part"))).over(W.partitionBy(prompt_key)), F.lit(0))
    near = summed.withColumn("_bound", raised).join(rest, prompt_key, "left").where(F.col("part") + F.coalesce("_rest", F.lit(0)) >= F.col("_bound")).select(prompt_key, item_key, "part")
    looked = near.join(aside, prompt_key).join(listed.select(item_key, "term"), [item_key, "term"], "left_semi").groupBy(prompt_key, item_key).agg(F.sum("more").alias("more"))
    scored = near.join(looked, [prompt_key, item_key], "left").select(prompt_key, item_key, (F.col("part") + F.coalesce("more", F.lit(0))).alias("score"))
    place = F.row_number().over(W.partitionBy(prompt_key).orderBy(F.desc("score"), item_key))
    return scored.withColumn("place", place.cast("bigint")).where(F.col("place") <= k)


def top_matches(prompts: DataFrame, catalog: DataFrame, k: int, prompt_key: str, item_key: str, text: str = "text") -> DataFrame:
    """For each prompt the k items with most terms in common; ties by item key."""
    return ranked_matches(prompts, catalog, k, prompt_key, item_key, text, weighted=False)


def with_pinned(ranked: DataFrame, pinned: DataFrame, prompt_key: str, item_key: str) -> DataFrame:
    """Ranked items and, for every prompt that has any, the pinned ones (item_key); each once. More than MOST_PINNED are an error, as every prompt gets them all."""
    pins = [r[0] for r in pinned.select(item_key).distinct().limit(MOST_PINNED + 1).collect()]
    if len(pins) > MOST_PINNED:
        raise ValueError(f"more than {MOST_PINNED} pinned items")
    kind = ranked.schema[item_key].dataType
    every = F.explode(F.array(*[F.lit(p).cast(kind) for p in pins]).cast(f"array<{kind.simpleString()}>")).alias(item_key)
    always = ranked.select(prompt_key).distinct().select(prompt_key, every)
    return ranked.select(prompt_key, item_key).unionByName(always).distinct()


def within_budget(ranked: DataFrame, key: str, order: list[str | Column], tokens: str, limit: int) -> DataFrame:
    """The longest beginning of each key's ranking whose tokens stay within the limit."""
    spent = F.sum(tokens).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("spent", spent).where(F.col("spent") <= limit)


PROPERTIES = "struct<type: string, properties: map<string, string>, required: array<string>>"


def signature(name: Column, schema_json: Column) -> Column:
    """A one-line signature of a JSON object schema: name(a: type, b?: type); parameters A to Z, '?' if not required. Null if malformed."""
    parsed = F.from_json(schema_json, PROPERTIES)
    known = F.array_sort(F.map_entries(parsed["properties"]))
    required = F.coalesce(parsed["required"], F.array().cast("array<string>"))
    part = lambda e: F.concat(e["key"], F.when(F.array_contains(required, e["key"]), ": ").otherwise("?: "), F.coalesce(F.get_json_object(e["value"], "$.type"), F.lit("any")))
    return F.concat(name, F.lit("("), F.array_join(F.transform(F.coalesce(known, F.array().cast("array<struct<key: string, value: string>>")), part), ", "), F.lit(")"))


def schema_audit(df: DataFrame) -> DataFrame:
    """Of each schema: number of parameters, whether they are too many, and how deep braces nest outside strings."""
    plain = F.regexp_replace("schema_json", r'"(\\.|[^"\\])*"', "")
    signs = F.filter(F.split(plain, ""), lambda c: c.isin("{", "}"))
    state = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: F.struct((a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "{", 1).otherwise(-1)).alias("most")))
    count = F.size(F.map_keys(F.from_json("schema_json", PROPERTIES)["properties"]))
    return df.withColumn("n_params", F.when(count >= 0, count)).withColumn("too_many", F.col("n_params") > MOST_PARAMETERS).withColumn("depth", state["most"])


def missing_parameters(required: Column, given: Column) -> Column:
    """One line that names required parameters which aren't given; null if all are."""
    lacking = F.array_sort(F.array_except(required, given))
    return F.when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))


def removed(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of old that new lacks."""
    return old.select(*on).distinct().join(new.select(*on).distinct(), on, "left_anti")


def violations(calls: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    """Calls for which there is no entry in an allow-list."""
    return calls.join(allowed.select(*on).distinct(), on, "left_anti")


def destructive(command: Column) -> Column:
    hit = F.lit(False)
    for pattern in DESTRUCTIVE:
        hit = hit | F.rlike(F.lower(command), F.lit(pattern))
    return hit


def flagged(commands: DataFrame, rules: DataFrame, command: str = "command") -> DataFrame:
    """Commands with each rule (rule, pattern) that their lower-case text matches: a theta join with a rule table, which is written by hand and so small."""
    return commands.join(F.broadcast(rules.select("rule", "pattern")), F.rlike(F.lower(command), F.col("pattern"))).drop("pattern")


def trace(rules: list[tuple[str, Column]]) -> Column:
    """What each named rule says of a row, in order: an array of (rule, value)."""
    return F.array(*[F.struct(F.lit(name).alias("rule"), value.cast("string").alias("value")) for name, value in rules])


def json_type(value: Column) -> Column:
    """The JSON schema type of a variant: a number without a fraction is an integer."""
    kind = F.schema_of_variant(value)
    names = [("BIGINT", "integer"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("OBJECT", "object"), ("ARRAY", "array"), ("VOID", "null")]
    out = F.when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
    for begins, name in names:
        out = out.when(F.startswith(kind, F.lit(begins)), name)
    return out.otherwise("number")


def wrong_types(schema_json: Column, given_json: Column) -> Column:
    """Names A to Z of given parameters whose JSON value is of another type than the schema says; an integer is a number as well. Null if what is given isn't an object."""
    expected = F.from_json(schema_json, PROPERTIES)["properties"]
    given = F.transform(F.map_entries(F.from_json(given_json, "map<string, variant>")), lambda e: F.struct(e["key"].alias("key"), json_type(e["value"]).alias("kind")))
    said = lambda e: F.get_json_object(F.try_element_at(expected, e["key"]), "$.type")
    fits = lambda e: (said(e) == e["kind"]) | ((said(e) == "number") & (e["kind"] == "integer"))
    return F.array_sort(F.transform(F.filter(given, lambda e: said(e).isNotNull() & ~fits(e)), lambda e: e["key"]))


def advised_model(use: Column, rules: dict[str, str], default: str) -> Column:
    """A cheaper model by kind of use, from a rule table."""
    from tidemark.functions.numbers import lookup

    return lookup(rules, use, default)
