"""Snapshots of folders: contents are stored once under their digests, a snapshot is a manifest that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import blob_sha1
from tidemark.operators.stages import kept


def blob_digest(content: Column) -> Column:
    """The SHA-1 that git gives a blob of bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def manifest_of(files: DataFrame) -> DataFrame:
    """(path, digest, bytes) of files (path, text)."""
    return files.select("path", blob_sha1(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path below the folder, digest, bytes, content) of what a folder holds now. Empty files are left out, as Spark's reader doesn't list them."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    below = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    root = F.lit("/" + folder.split("://")[-1].strip("/") + "/")
    return read.select(F.substring(below, F.length(root) + 1, F.length(below)).alias("path"), blob_digest(F.col("content")).alias("digest"), F.col("length").alias("bytes"), "content")


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/contents")
    return spark.read.parquet(f"{store}/contents") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def take(spark: SparkSession, folder: str, store: str, name: str, pattern: str = "*") -> DataFrame:
    """Take a snapshot ``name`` of a folder into a store and return its manifest. Files are read once; contents that the store has are not stored again.

    Contents go before the manifest that names them. A snapshot that exists is never written again: that is an error.
    """
    files = kept(_files(spark, folder, pattern))
    new = files.groupBy("digest").agg(F.first("content").alias("content"))
    stored = _stored(spark, store)
    if stored is not None:
        new = new.join(stored.select("digest"), "digest", "left_anti")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"there is a snapshot {name}")
    new.write.mode("append").parquet(f"{store}/contents")
    files.select("path", "digest", "bytes").write.mode("errorifexists").parquet(f"{store}/manifests/{name}")
    return manifest(spark, store, name)


def manifest(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema("path string, digest string, bytes bigint").parquet(f"{store}/manifests/{name}")


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    """(path, digest, bytes, content) as they were when the snapshot was taken, whatever became of the files."""
    contents = spark.read.parquet(f"{store}/contents").dropDuplicates(["digest"])  # two snapshots at a time may store one twice
    return manifest(spark, store, name).join(contents, "digest").select("path", "digest", "bytes", "content")


def current(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The manifest of a folder as it is now, to hold against a snapshot's."""
    return _files(spark, folder, pattern).drop("content")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that two manifests (path, digest, bytes) don't agree in: added, changed, removed, with bytes before and after, and where an added file's content was before.

    ``moved_from`` is the least path of the same content among those removed.
    """
    a, b = (m.select("path", F.col("digest").alias(f"digest_{n}"), F.col("bytes").alias(f"bytes_{n}")) for m, n in ((before, "before"), (after, "after")))
    change = F.when(F.col("digest_before").isNull(), "added").when(F.col("digest_after").isNull(), "removed").otherwise("changed")
    found = a.join(b, "path", "full").where(~F.col("digest_before").eqNullSafe(F.col("digest_after"))).withColumn("change", change)
    gone = found.where("change = 'removed'").groupBy(F.col("digest_before").alias("digest")).agg(F.min("path").alias("moved_from"))
    moved = found.where("change = 'added'").join(gone, F.col("digest_after") == F.col("digest"), "left").drop("digest")
    rest = found.where("change <> 'added'").withColumn("moved_from", F.lit(None).cast("string"))
    return moved.unionByName(rest).select("path", "change", "bytes_before", "bytes_after", "moved_from")
