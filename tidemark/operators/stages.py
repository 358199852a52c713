"""Intermediate results that several later steps read."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tidemark-stages-')}"


def stage_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where none is set, as in tests on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def kept(df: DataFrame) -> DataFrame:
    """df computed once: written to the shared folder and read from there, so lost executors cost nothing and values that depend on the partitioning stay."""
    path = f"{stage_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
