"""Shortening of logs, test output and JSON arrays without loss of what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import without_ansi

#: Lines of a framework's output that say that something passed, and that something failed.
PASSED = {"pytest": r"PASSED|^[.]+( +\[ *\d+%\])?$", "jest": r"^\s*(✓|√)|^PASS ", "go": r"^(=== RUN|--- PASS|ok )|^PASS$", "cargo": r"^test .* ok$", "junit": r"^\[INFO\].*Tests run.*Failures: 0", "gtest": r"^\[ +(RUN|OK|PASSED) +\]"}
FAILED = {"pytest": r"FAILED|^E  |Error", "jest": r"✕|●|^FAIL ", "go": r"--- FAIL|^FAIL|panic:", "cargo": r"FAILED|panicked", "junit": r"ERROR|FAILURE", "gtest": r"\[ +FAILED +\]|Failure"}


MODES = ("off", "balanced", "max")


def optimised(text: Column, mode: str) -> Column:
    """A text as a mode leaves it: "off" as it is, "balanced" each line once, "max" of these the first and last three."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    lines = F.array_distinct(F.split(text, "\n"))
    return text if mode == "off" else F.array_join(lines if mode == "balanced" else bounded_array(lines), "\n")


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def collapsed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Runs of equal neighbouring lines as one row: first place, length and the line. Each text is cut in its own row, then islands are numbered."""
    marked = lines_of(df, key, text).withColumn("_new", F.when(F.col("line").eqNullSafe(F.lag("line").over(W.partitionBy(key).orderBy("pos"))) & (F.col("pos") > 0), 0).otherwise(1))
    island = marked.withColumn("run", F.sum("_new").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return island.groupBy(key, "run").agg(F.min("pos").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("times"), F.min("line").alias("line"))


def head_tail(df: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """First and last n rows of each key, and how many are left out."""
    w = W.partitionBy(key)
    numbered = df.withColumn("place", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("total", F.count(F.lit(1)).over(w))
    kept = numbered.where((F.col("place") <= n) | (F.col("place") > F.col("total") - n))
    return kept.withColumn("omitted", F.greatest(F.col("total") - 2 * n, F.lit(0).cast("bigint")))


def bounded_array(values: Column, n: int = 3) -> Column:
    """First and last n elements of a longer array; shorter ones stay."""
    return F.when(F.size(values) > 2 * n, F.concat(F.slice(values, 1, n), F.slice(values, -n, n))).otherwise(values)


def bounded_json(payload: Column, n: int = 3) -> Column:
    """The same for a JSON array of any values; other text stays as it is."""
    values = F.from_json(payload, "array<string>")
    return F.coalesce(F.when(F.size(values) > 2 * n, F.to_json(bounded_array(values, n))), payload)


def distilled(lines: DataFrame, context: int = 1) -> DataFrame:
    """Test output (run_id, framework, pos, line) without passes: failures with lines around them. A run of an unknown framework, or without failures, comes back without passed lines only; unknown ones unchanged."""
    of = lambda table: F.rlike(F.col("clean"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("framework")), F.lit(r"\b\B")))
    w = W.partitionBy("run_id").orderBy("pos")
    marked = lines.withColumn("clean", without_ansi(F.col("line"))).withColumn("failed", of(FAILED)).withColumn("passed", of(PASSED))
    near = marked.withColumn("near", F.max("failed").over(w.rowsBetween(-context, context))).withColumn("any_failed", F.max("failed").over(W.partitionBy("run_id")))
    known = F.col("framework").isin(*PASSED)
    keep = ~known | F.col("near") | (~F.col("any_failed") & ~F.col("passed"))
    return near.where(keep).select("run_id", "framework", "pos", F.when(known, F.col("clean")).otherwise(F.col("line")).alias("line"))


#: Lines that begin the report of a failure, and lines that end it.
BEGINS = {"pytest": r"^_{3,} .+ _{3,}$|^Traceback ", "jest": r"^ *● ", "go": r"^ *--- FAIL|^panic:", "cargo": r"^---- .+ ----$|^thread .+ panicked", "junit": r"^\[ERROR\] .+(FAILURE|ERROR)!$|^[\w.]+(Exception|Error)(:|$)", "gtest": r"^.+: Failure$"}
ENDS = {"pytest": r"PASSED|^={3,} ", "jest": r"^ *(✓|√|✕) |^PASS |^Tests:", "go": r"^ *(=== RUN|--- PASS)|^(ok|PASS|FAIL)\b", "cargo": r"^test .+ \.\.\. |^test result:|^failures:$", "junit": r"^\[(INFO|WARNING)\]|^Tests run:", "gtest": r"^\[ +(RUN|OK|FAILED|PASSED) +\]"}


def failure_blocks(lines: DataFrame) -> DataFrame:
    """Whole reports of failures in test output (run_id, framework, pos, line): each line with ``block``, the number of its report in its run, from 1.

    A report goes from a line that begins one to before the next that ends or begins one, so traces, assertions and causes stay whole. Whether
    a line is in one is told by the last such line before it: a window that keeps no lines. Runs of unknown frameworks have none.
    """
    of = lambda table: F.coalesce(F.rlike(F.col("clean"), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("framework"))), F.lit(False))
    marked = lines.withColumn("clean", without_ansi(F.col("line"))).withColumn("mark", F.when(of(BEGINS), 1).when(of(ENDS), 0))
    sofar = W.partitionBy("run_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = marked.withColumn("inside", F.last("mark", ignorenulls=True).over(sofar)).withColumn("block", F.count_if(F.col("mark") == 1).over(sofar))
    return told.where("inside = 1").select("run_id", "framework", "block", "pos", F.col("clean").alias("line"))


def failure_digest(lines: DataFrame) -> DataFrame:
    """What is left of a run: lines in whole reports of failures, and lines that say that something failed; a run without either, or of an unknown framework, comes back as ``distilled`` leaves it."""
    blocks = failure_blocks(lines).select("run_id", "pos", F.lit(True).alias("_in"))
    of = lambda table: F.coalesce(F.rlike(F.col("_clean"), F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("framework"))), F.lit(False))
    joined = lines.join(blocks, ["run_id", "pos"], "left").withColumn("_clean", without_ansi(F.col("line"))).withColumn("_keep", F.coalesce("_in", F.lit(False)) | of(FAILED))
    known = F.col("framework").isin(*PASSED)
    any_kept = joined.withColumn("_any", F.max("_keep").over(W.partitionBy("run_id")))
    kept = any_kept.where(F.when(~known, True).when(F.col("_any"), F.col("_keep")).otherwise(~of(PASSED)))
    return kept.select("run_id", "framework", "pos", F.when(known, F.col("_clean")).otherwise(F.col("line")).alias("line"))


def rejoined(lines: DataFrame, key: str = "run_id") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def surgery(turns: DataFrame, resolved: str, tail_from: Column) -> DataFrame:
    """Resolved traces in the tail become their digest; everything before ``tail_from`` stays byte for byte."""
    digest = F.concat(F.lit("[resolved "), F.substring(F.sha1("text"), 1, 12), F.lit("]"))
    return turns.withColumn("text", F.when((F.col("turn") >= tail_from) & F.col(resolved), digest).otherwise(F.col("text")))
