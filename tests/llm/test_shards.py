import random
import zlib
from collections import defaultdict

from tidemark.llm.shards import assign_shards, schedule


def check(found, rows, shards):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    home = defaultdict(set)
    texts = {(str(i), zlib.crc32((t or "").encode())): t for i, t in rows}
    for r in found:
        home[texts[str(r.doc_id), r.text_crc32]].add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_groups_stay_and_slots_have_no_gaps(spark, docs, odd_rows):
    check(assign_shards(docs(odd_rows), 4).collect(), odd_rows, 4)
    assert assign_shards(docs([]), 4).count() == 0


def test_sizes_are_near_equal(spark, docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abc ", k=rng.randint(0, 400)))) for i in range(3000)] + [(5000 + i, "hot" * 50) for i in range(300)]
    found = assign_shards(docs(rows), 8).collect()
    check(found, rows, 8)
    loads = defaultdict(int)
    for r in found:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.05 * min(loads.values())


def test_longest_first():
    assert schedule([(7, "a"), (6, "b"), (5, "c"), (4, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
