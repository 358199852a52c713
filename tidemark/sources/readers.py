"""Batch and streaming sources. Columns are declared, never inferred; missing ones are an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas

MAX_BUFFER_BYTES = 300 * 1024


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a declared schema, cast to it; a column that df lacks raises."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def request_log(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A log of requests, .jsonl or (whole_files) .json. Records that can't be parsed are kept in ``corrupt``."""
    return spark.read.schema(f"{schemas.LEDGER}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").option("mode", "PERMISSIVE").option("multiLine", whole_files).json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; what isn't such a record comes with nulls and the line in ``corrupt``."""
    return spark.read.schema(f"{schema}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").option("mode", "PERMISSIVE").json(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported history: commit_id, ts, origin (human or ai)."""
    return records(spark, path, schemas.COMMITS)


def test_runs(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.TEST_RUNS)


def tool_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tools with their JSON schemas."""
    return records(spark, path, schemas.TOOL_SCHEMAS)


def commands(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.CATALOG)


def code_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and the edges between them, of symbols.jsonl and edges.jsonl; edges to or from symbols that aren't there are left out."""
    symbols, edges = records(spark, f"{folder}/symbols.jsonl", schemas.SYMBOLS), records(spark, f"{folder}/edges.jsonl", schemas.EDGES)
    known = symbols.where("corrupt is null").select("sym_id").distinct()
    inside = edges.where("corrupt is null").join(known.withColumnRenamed("sym_id", "src"), "src", "left_semi").join(known.withColumnRenamed("sym_id", "dst"), "dst", "left_semi")
    return symbols, inside.select("src", "dst")


def watch_request_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same log as a stream of new .jsonl files in a folder."""
    return spark.readStream.schema(schemas.LEDGER).json(folder)


def watch_activity(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.ACTIVITY).json(folder)


def ticks(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A timer: rows (timestamp, value) at a rate. A rate of 0 is a timer that is off, so it isn't a source."""
    if rows_per_second <= 0:
        raise ValueError("stop the query instead of reading at a rate of 0")
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def snapshot(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files below a folder that match: path, text and bytes, one row each."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.octet_length("value").cast("bigint").alias("bytes"))


def buffers(df: DataFrame, most_bytes: int = MAX_BUFFER_BYTES) -> DataFrame:
    """Rows whose text isn't larger than a context buffer may be."""
    return df.where(F.octet_length("text") <= most_bytes)


def server_configs(df: DataFrame, column: str = "text") -> DataFrame:
    """Servers named in JSON configurations {name: {command, args}}: parsed, never started."""
    parsed = F.from_json(column, "map<string, struct<command: string, args: array<string>>>")
    return df.select(*df.columns, F.explode(F.map_entries(parsed)).alias("server")).select(*df.columns, F.col("server.key").alias("name"), "server.value.command", "server.value.args")
