"""A stream of lines appended to the files of a folder, exact over restarts: the offset is the end of each file's last whole line."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources import schemas

#: Bytes of a file that one task reads, bytes read at once, and bytes that tell a file from another of its name.
PART, BLOCK, HEAD = 32 << 20, 4 << 20, 256


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or a URI that pyarrow knows (file, hdfs, s3, gs), and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def last_line_end(file: pa.NativeFile, size: int, known: int) -> int:
    """Where the last whole line of a file's first ``size`` bytes ends, sought backwards down to ``known``."""
    stop = size
    while stop > known:
        start = max(known, stop - BLOCK)
        at = file.read_at(stop - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop = start
    return known


class Lines(InputPartition):
    """Lines of a file that begin at ``begin`` or later and before ``stop``; none reaches beyond ``end``."""

    def __init__(self, path: str, begin: int, stop: int, end: int, at_line: bool):
        self.path, self.begin, self.stop, self.end, self.at_line = path, begin, stop, end, at_line


class AppendedReader(DataSourceStreamReader):
    """Offsets are {file: {"head": digest of its first bytes, "known": how many, "end": end of its last whole line}}.

    A file that got shorter was cut: reading on would skip or repeat lines, so that is an error. One whose first bytes
    changed has taken the place of another and is read from its start.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern, self.part = options["path"], options.get("pattern", "*"), int(options.get("partBytes", PART))
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = opened(self.folder)
        files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]
        offset = {}
        for info in sorted(files, key=lambda f: f.path):
            name, stamp = info.path[len(root.rstrip("/")) + 1 :], (info.size, info.mtime_ns)
            if self.seen.get(name, (None,))[0] != stamp:
                with system.open_input_file(info.path) as file:
                    size = info.size
                    head = file.read_at(min(size, HEAD), 0)
                    self.seen[name] = (stamp, {"head": hashlib.sha1(head).hexdigest(), "known": len(head), "end": last_line_end(file, size, 0)})
            if self.seen[name][1]["end"]:
                offset[name] = self.seen[name][1]
        return offset

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        system, root = opened(self.folder)
        parts: list[InputPartition] = []
        for name, now in sorted(end.items()):
            path, was = f"{root.rstrip('/')}/{name}", start.get(name)
            begin = was["end"] if was else 0
            if was and was != now:
                with system.open_input_file(path) as file:
                    if hashlib.sha1(file.read_at(was["known"], 0)).hexdigest() != was["head"]:
                        begin = 0
                if begin > now["end"]:
                    raise ValueError(f"{path} was cut: {begin} bytes of it were read, {now['end']} are left")
            at_line = True
            while begin < now["end"]:
                stop = min(begin + self.part, now["end"])
                parts.append(Lines(path, begin, stop, now["end"], at_line))
                begin, at_line = stop, False
        return parts

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        name = partition.path.rpartition("/")[2]
        system, _ = opened(self.folder)
        with system.open_input_file(partition.path) as file:
            # a line that begins before a part's first byte is the part's before
            at = partition.begin if partition.at_line else partition.begin - 1
            rest, skip = b"", not partition.at_line
            while at < partition.end:
                block = rest + file.read_at(min(BLOCK, partition.end - at), at)
                base, at = at - len(rest), min(at + BLOCK, partition.end)
                cut = block.rfind(b"\n") + 1
                whole, rest = block[:cut], block[cut:]
                lines = whole.split(b"\n")[:-1]
                begins, b = [], base
                for line in lines:
                    begins.append(b)
                    b += len(line) + 1
                if skip and lines:
                    lines, begins, skip = lines[1:], begins[1:], False
                n = sum(b < partition.stop for b in begins)
                yield self._batch(name, begins[:n], lines[:n])
                if n < len(lines):
                    return

    def _batch(self, name: str, begins: list[int], lines: list[bytes]) -> pa.RecordBatch:
        text, broken = [], []
        for line in lines:
            line = line.removesuffix(b"\r")
            try:
                text.append(line.decode())
                broken.append(False)
            except UnicodeDecodeError:
                text.append(line.decode(errors="replace"))
                broken.append(True)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(begins, pa.int64()), pa.array(text, pa.string()), pa.array(broken, pa.bool_())], ["file", "begins", "line", "broken"])


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, begins bigint, line string, broken boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AppendedReader(self.options)


def appended_lines(spark: SparkSession, folder: str, pattern: str = "*", part_bytes: int = PART) -> DataFrame:
    """A stream of (file, begins, line, broken): each whole line of each file once, with the byte at which it begins.

    A last line without its line feed waits until it has one. Bytes that aren't UTF-8 are replaced, and the line is marked broken. Long
    stretches are read by several tasks. On a cluster the folder must be one that all executors see.
    """
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("pattern", pattern).option("partBytes", part_bytes).load(folder)


def watch_appended_log(spark: SparkSession, folder: str, schema: str = schemas.LEDGER, pattern: str = "*.jsonl") -> DataFrame:
    """A growing JSONL log as a stream of records of a declared schema; lines that aren't such records come with nulls and the line in ``corrupt``. Blank lines are left out."""
    lines = appended_lines(spark, folder, pattern).where(F.trim(F.col("line")) != "")
    parsed = F.from_json("line", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    record = lines.select("file", "begins", "line", "broken", parsed.alias("r"))
    fields = [f.split()[0] for f in schema.split(", ")]
    bad = F.col("broken") | F.col("r.corrupt").isNotNull()
    return record.select("file", "begins", *[F.when(~bad, F.col(f"r.{c}")).alias(c) for c in fields], F.when(bad, F.col("line")).alias("corrupt"))
