"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word; ``bytes.split()`` splits at just these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_training(id_col: str, mod: int, held: int) -> Column:
    """Whether a row may be learned from: crc32 of its id as text leaves another remainder than ``held``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod != held, F.lit(True))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def runs_by_size(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes each; a longer row is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_HELD: dict[tuple[str, str], Any] = {}


def let_go(owner: str) -> None:
    """At the start of an operator's task: what other operators keep in this worker goes, and memory that nothing uses goes back to the system.

    Spark's workers outlive tasks and stages, so without this each stage's tables would stay beside those of the next ones.
    """
    for key in [k for k in _HELD if k[0] != owner]:
        del _HELD[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def held(owner: str, key: str, make: Callable[[str], Any]) -> Any:
    """What an operator keeps in a worker from task to task."""
    let_go(owner)
    if (owner, key) not in _HELD:
        _HELD[owner, key] = make(key)
    return _HELD[owner, key]
