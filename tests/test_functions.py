import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import numbers, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "\t a b\n", text.strip_space) == "a b"
    assert one(spark, "a&<\">'", text.html_escape) == "a&amp;&lt;&quot;&gt;'"
    assert one(spark, None, text.html_escape) == ""
    assert one(spark, "1,428,950", text.number_with_commas) == 1428950
    assert one(spark, " -12px", text.leading_int) == -12
    assert one(spark, "px", text.leading_int) is None
    assert one(spark, "3.5e2x", text.leading_float) == 350.0
    assert one(spark, "", text.token_estimate) == 0
    assert one(spark, "abcde", text.token_estimate) == 2
    assert one(spark, "\x1b[31mred\x1b[0m", text.without_ansi) == "red"
    assert one(spark, "a/b/c.py", text.without_folders) == "c.py"
    assert one(spark, "100%_x", lambda c: text.has_text(c, "%_")) is True
    assert one(spark, "100x", lambda c: text.has_text(c, "%")) is False
    assert one(spark, None, lambda c: text.has_text(c, "a")) is False
    assert one(spark, None, lambda c: text.has_text(c, " ")) is True
    assert [one(spark, x, text.balanced) for x in ("f(a[1]{})", "(]", ")(", "((", "")] == [True, False, False, False, True]
    assert [one(spark, x, lambda c: text.confined(c, "/r")) for x in ("/r/a", "/r", "/rx/a", "/r/../a")] == [True, True, False, False]


def test_blob_digest_is_that_of_git(spark):
    for t in ("", "é\n", "abc"):
        raw = t.encode()
        assert one(spark, t, text.blob_sha1) == hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()


def test_redaction_can_be_repeated(spark):
    t = 'mail a.b@c.org token = "0123456789abcdef0123456789abcdef01234567" at 2024-01-02T03:04:05Z turn 7 123e4567-e89b-12d3-a456-426614174000'
    for f in (text.redact, text.neutralize):
        once = one(spark, t, f)
        assert once != t and one(spark, once, f) == once
    assert "c.org" not in one(spark, t, text.redact) and "0123456789abcdef" not in one(spark, t, text.redact)


def test_shares_and_budgets(spark):
    row = spark.range(1).select(
        numbers.saved_share(F.lit(627), F.lit(842)), numbers.saved_share(F.lit(1), F.lit(0)), numbers.saved_share_or_zero(F.lit(1), F.lit(0)), numbers.remaining_share(F.lit(25), F.lit(100)),
        numbers.days_left(F.lit(10.0), F.lit(0.0)), numbers.budget_band(F.lit(30)), numbers.budget_band(F.lit(29)), numbers.budget_band(F.lit(1)), numbers.lookup({"a": "x"}, F.lit("b"), "z"), numbers.monthly(F.lit(3.42)),
    ).first()
    assert list(row) == [74.5, None, 0.0, 75.0, None, "safe", "watch", "short", "z", 102.6]


@settings(max_examples=30, deadline=None)
@given(n=st.integers(0, 10**9), c=st.sampled_from([64, 128, 1024, 32768]))
def test_padding_fills_chunks(n, c):
    pad = (-n) % c
    assert pad < c and (n + pad) % c == 0


def test_padding_in_spark(spark):
    row = spark.range(1).select(numbers.padding(F.lit(5000), F.lit(1024)), numbers.cached_part(F.lit(5000), F.lit(1024)), numbers.padding(F.lit(2048), F.lit(1024)), numbers.may_cache(F.lit(1024))).first()
    assert list(row) == [120, 4096, 0, True]
