"""Scalar functions over strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted, in order, and what takes its place.
SECRET_RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"(?i)(token|secret|password|api_key)( *[=:] *)(\"[^\"]*\"|[^ \n\"]+)", "$1$2<secret>"),
    (r"\b[0-9a-f]{40}\b", "<hex>"),
]
#: What changes from one turn to the next and so breaks cached prefixes.
VOLATILE_RULES = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?", "<time>"),
    (r"(?i)\b(turn|step) *#? *[0-9]+", "<turn>"),
]


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def strip_space(text: Column) -> Column:
    """Without any white space at both ends; Spark's trim knows only spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def has_text(text: Column, query: str) -> Column:
    """Literal substring without regard to case; an empty query fits all rows, a null text none but that."""
    query = query.strip().lower()
    return F.lit(True) if not query else F.coalesce(F.contains(F.lower(text), F.lit(query)), F.lit(False))


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def redact(text: Column) -> Column:
    return replaced(text, SECRET_RULES)


def neutralize(text: Column) -> Column:
    return replaced(text, VOLATILE_RULES)


def without_folders(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def html_escape(text: Column) -> Column:
    """Null becomes empty; ampersands go first; single quotes stay."""
    text = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def number_with_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def leading_int(text: Column) -> Column:
    """The integer a text begins with, as lenient parsers read it; null if there is none."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("bigint")


def leading_float(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def blob_sha1(text: Column) -> Column:
    """The SHA-1 that git gives a blob of the text's bytes."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def balanced(text: Column) -> Column:
    """Whether (), [] and {} nest; the state is the stack of open ones, or '!' once one is closed wrongly."""
    signs = F.filter(F.split(text, ""), lambda c: F.contains(F.lit("()[]{}"), c) & (c != ""))
    opener = lambda c: F.translate(c, ")]}", "([{")

    def step(stack: Column, c: Column) -> Column:
        opens = F.contains(F.lit("([{"), c)
        closes = F.right(stack, F.lit(1)) == opener(c)
        return F.when(stack == "!", stack).when(opens, F.concat(stack, c)).when(closes, F.substring(stack, F.lit(1), F.length(stack) - 1)).otherwise("!")

    return F.aggregate(signs, F.lit(""), step) == ""


def confined(path: Column, root: str) -> Column:
    """Whether a path lies in root and has no '..' part."""
    root = root.rstrip("/")
    return ((path == root) | F.startswith(path, F.lit(root + "/"))) & ~F.array_contains(F.split(path, "/"), "..")


def first_word(text: Column) -> Column:
    """What stands before the first space."""
    return F.split_part(text, F.lit(" "), F.lit(1))


def with_thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def is_true(text: Column) -> Column:
    return F.coalesce(text == "true", F.lit(False))


def split_line(kind: Column, text: Column, side: str) -> Column:
    """One side of a split view: deleted lines on the "old", added ones on the "new" side only; empty where the other side has the line."""
    other = "add" if side == "old" else "del"
    return F.when(kind == other, F.lit("")).otherwise(text)


def diff_line(kind: Column, text: Column) -> Column:
    """A line with the sign of its given kind; none is computed."""
    return F.concat(F.when(kind == "add", "+ ").when(kind == "del", "- ").when(kind == "omitted", "… ").otherwise("  "), text)
