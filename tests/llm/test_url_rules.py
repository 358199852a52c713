import random

import pytest

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_rules import judge_urls


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def random_urls(rng, n):
    labels, parts = ["a", "b", "ab", "com", "é"], ["a", "b", "ab", "", "a.b"]
    urls = [rng.choice(["http://", "HTTPS://", "", "x://y://"]) + ".".join(rng.choices(labels, k=rng.randint(1, 4))).upper() + rng.choice(["", "/", "?q=/a", "#x"]) + "/".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(n)]
    return urls + [None, "", "://", "no url", "http:///a"] + ["http://hot.a.com/a/b"] * n


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_against_brute_force(spark, partitions):
    rng = random.Random(3)
    urls = random_urls(rng, 250)
    rules = {(".".join(rng.choices(["a", "b", "ab", "com"], k=rng.randint(1, 3))), "/" + "/".join(rng.choices(["a", "b", "ab"], k=rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(80)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = judge_urls(pages, spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.page_id: tuple(r)[1:] for r in found} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_repeated_null_and_empty(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://example.com/en/1"), (1, "http://www.EXAMPLE.com/en/"), (1, "http://www.example.com/en/"), (2, "http://com.net/fr")], "page_id long, url string")
    found = sorted((str(r.page_id), str(r.rule), r.verdict) for r in judge_urls(pages, rules).collect())
    assert found == [("1", "www.example.com/en/", "allow"), ("1", "www.example.com/en/", "allow"), ("2", "None", "allow"), ("None", "example.com/en/", "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.rule for r in judge_urls(pages, rules.limit(0)).collect()} == {None}
