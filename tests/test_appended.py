import json

import pytest

from tidemark.sources.appended import AppendedReader, appended_lines, watch_appended_log
from tidemark.streaming import live


def drained(spark, df, name, checkpoint, mode="append"):
    live.start(df, "memory", str(checkpoint), mode, queryName=name).awaitTermination(120)
    return spark.table(name)


def put(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def run(spark, folder, out, checkpoint, **how):
    """One run over what there is: lines go to a table on disk, so that runs add up."""
    live.start(appended_lines(spark, str(folder), **how), "parquet", str(checkpoint), path=str(out)).awaitTermination(120)
    return sorted((r.file, r.begins, r.line) for r in spark.read.parquet(str(out)).collect())


def test_lines_come_once_over_growth_and_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    put(folder / "a.log", b"one\ntwo\nhal")
    assert run(spark, folder, out, checkpoint) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert len(run(spark, folder, out, checkpoint)) == 2  # nothing new; the half line waits
    put(folder / "a.log", "f a liné\r\n\n".encode())
    put(folder / "b.log", b"other\nno end")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "half a liné"), ("a.log", 22, ""), ("b.log", 0, "other")]
    assert run(spark, folder, out, checkpoint) == want
    put(folder / "b.log", b"\n")
    put(folder / "a.log", b"last\n")
    assert run(spark, folder, out, checkpoint) == sorted([*want, ("b.log", 6, "no end"), ("a.log", 23, "last")])


def test_parts_split_long_files_at_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [f"{i}:" + "x" * (i * 7 % 90) for i in range(500)]
    put(folder / "a.log", ("\n".join(lines) + "\n").encode())
    for size in (1, 17, 1000):
        reader = AppendedReader({"path": str(folder), "partBytes": str(size)})
        end = reader.latestOffset()
        parts = reader.partitions({}, end)
        assert len(parts) == -(-end["a.log"]["end"] // size)
        got = [x for p in parts for b in reader.read(p) for x in zip(b.column("begins").to_pylist(), b.column("line").to_pylist(), strict=True)]
        assert [x[1] for x in got] == lines
        assert all((folder / "a.log").read_bytes()[b:].startswith(line.encode()) for b, line in got)


def test_cut_and_replaced_files(tmp_path):
    put(tmp_path / "a.log", b"a first line that tells the file\nmore\n")
    reader = AppendedReader({"path": str(tmp_path)})
    was = reader.latestOffset()
    put(tmp_path / "a.log", b"a first line that tells the file\n", "wb")
    with pytest.raises(ValueError, match="was cut"):  # its first bytes are no longer those that were known
        AppendedReader({"path": str(tmp_path)}).partitions({"a.log": {**was["a.log"], "known": 10, "head": __import__("hashlib").sha1(b"a first li").hexdigest()}}, AppendedReader({"path": str(tmp_path)}).latestOffset())
    put(tmp_path / "a.log", b"another file under that name\n", "wb")
    now = reader.latestOffset()
    assert [(p.begin, p.stop) for p in reader.partitions(was, now)] == [(0, 29)]
    assert reader.partitions(now, now) == []
    assert AppendedReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_bad_records_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    good = {"req_id": 1, "ts": "2024-01-01T00:00:00", "task": "t", "model": "m", "input_tokens": 5, "cached_tokens": 1, "output_tokens": 2, "cost": 0.5, "kind": "observed"}
    put(folder / "u.jsonl", json.dumps(good).encode() + b'\n{"req_id": \n\n{"req_id": "x"}\n\xff{"req_id": 3}\n' + json.dumps(good | {"req_id": 4}).encode() + b"\n")
    put(folder / "skipped.txt", b'{"req_id": 9}\n')
    rows = drained(spark, watch_appended_log(spark, str(folder)), "bad_records", tmp_path / "c").orderBy("begins").collect()
    assert [(r.req_id, r.corrupt) for r in rows] == [(1, None), (None, '{"req_id": '), (None, '{"req_id": "x"}'), (None, '�{"req_id": 3}'), (4, None)]
    assert str(rows[0].cost) == "0.500000" and rows[0].kind == "observed"
