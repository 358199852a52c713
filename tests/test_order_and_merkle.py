import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merkle, order, ranking
from tidemark.plans.queries import QUERIES
from tidemark.plans import ledger_queries, scale_queries  # noqa: F401  register their queries

SF = "/root/testdata/sf0.001"


def numbers(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice([None, 7, 7, 7, r.randrange(100)]), r.choice([None, r.randrange(-50, 50)])) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, k int, v long").repartition(7)


def test_places_sums_and_least_values(spark):
    rows, df = numbers(spark)
    by = sorted(rows, key=lambda x: (x[1] is not None, -(x[1] or 0), x[0]))
    keys = [F.desc_nulls_first("k"), F.asc("id")]
    assert {r.id: r.place for r in order.placed(df, keys).collect()} == {x[0]: i + 1 for i, x in enumerate(by)}
    sums, least, total, low = {}, {}, 0, None
    for i, _, v in by:
        least[i] = low
        total += v or 0
        low = low if v is None else v if low is None else min(low, v)
        sums[i] = total
    assert {r.id: r.running for r in order.summed(df, keys, "v").collect()} == sums
    assert {r.id: r.least_before for r in order.least_before(df, keys, "v").collect()} == least
    assert order.placed(df.where("id < 0"), keys).count() == 0


def test_ranges_are_several_and_no_step_is_single(spark):
    _, df = numbers(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert order.in_ranges(df, [F.asc("id")]).select("_part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name in ("rank_files_by_savings", "pareto_parts", "prefix_order", "order_places", "running_revenue"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_pareto_is_what_no_other_row_beats(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(40), r.randrange(40)) for i in range(300)]
    got = {x.id for x in ranking.pareto(spark.createDataFrame(rows, "id long, x int, y int"), "x", "y").collect()}
    assert got == {i for i, x, y in rows if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in rows)}


def tree_of(spark, rows, depth=2):
    df = spark.createDataFrame(rows, "id long, text string")
    found = merkle.leaves(df, ["id"], depth)
    return found, merkle.tree(found, depth)


def root(nodes):
    return nodes.where("level = 0").first()


def test_tree_depends_on_content_alone(spark):
    rows = [(i, f"t{i}") for i in range(200)] + [(None, None), (3, "t3")]
    leaves, nodes = tree_of(spark, rows)
    assert root(nodes).rows == 202 and root(tree_of(spark, rows[::-1])[1]).digest == root(nodes).digest
    assert root(tree_of(spark, rows[:-1])[1]).digest != root(nodes).digest  # copies count
    assert tree_of(spark, [])[1].count() == 0
    assert merkle.depth_for(10) == 1 and merkle.depth_for(16**4) == 3 and merkle.depth_for(0) == 1


@pytest.mark.parametrize("edit, change", [(lambda r: [*r[:57], (57, "other"), *r[58:]], "changed"), (lambda r: r[:57] + r[58:], "removed"), (lambda r: [*r, (1000, "new")], "added")])
def test_one_row_names_its_block(spark, edit, change):
    rows = [(i, f"t{i}") for i in range(300)]
    (a, before), (b, after) = tree_of(spark, rows), tree_of(spark, edit(rows))
    blocks = merkle.changed_blocks(before, after, 2)
    key = 1000 if change == "added" else 57
    assert [r.node for r in blocks.collect()] == [r.node for r in (b if change == "added" else a).where(f"id = {key}").collect()]
    assert [tuple(r) for r in merkle.changed_rows(a, b, blocks, ["id"]).collect()] == [(key, change)]
    assert merkle.changed_blocks(before, before, 2).count() == 0


def test_proofs(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(5, "t5"), (None, None)]
    leaves, nodes = tree_of(spark, rows)
    top = root(nodes).digest
    found = merkle.proofs(leaves, nodes, 2).withColumn("ok", merkle.proved(F.col("digest"), F.col("proof"), F.lit(top)))
    assert found.count() == 302 and found.where("not ok").count() == 0
    assert found.where("size(proof) <> 3").count() == 0
    forged = merkle.leaves(spark.createDataFrame([(7, "forged"), (999, "t999")], "id long, text string"), ["id"], 2)
    assert [r.ok for r in merkle.proofs(forged, nodes, 2).select(merkle.proved(F.col("digest"), F.col("proof"), F.lit(top)).alias("ok")).collect()] == [False, False]
    stolen = found.where("id = 8").select(F.sha2(F.lit("x"), 256).alias("digest"), "proof")
    assert not stolen.select(merkle.proved(F.col("digest"), F.col("proof"), F.lit(top)).alias("ok")).first().ok


def test_proofs_of_many_rows_stay_short(spark):
    assert [merkle.bits_for(n, 3) for n in (0, 1500, 65_536, 9_000_000)] == [4, 4, 4, 6]
    n = 20_000
    df = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(5, "t5")], "id long, text string"))
    bits = merkle.bits_for(n, 1)
    leaves = merkle.leaves(df, ["id"], 1, bits=bits)
    nodes = merkle.tree(leaves, 1, bits)
    assert bits == 8 and nodes.where("level = 1").agg(F.max("rows")).first()[0] < 150 and root(nodes).rows == n + 1
    top = F.lit(root(nodes).digest)
    forged = merkle.leaves(spark.createDataFrame([(7, "forged")], "id long, text string"), ["id"], 1, bits=bits)
    found = merkle.proofs(leaves.unionByName(forged), nodes, 1, bits).select("text", merkle.proved(F.col("digest"), F.col("proof"), top).alias("ok"), F.aggregate("proof", F.lit(0), lambda a, s: a + F.length(s["before"]) + F.length(s["after"])).alias("chars"))
    assert found.where("ok").count() == n + 1 and [r.text for r in found.where("not ok").collect()] == ["forged"]
    assert found.agg(F.max("chars")).first()[0] < 40_000  # blocks of sixteen would have 1,250 rows, over 80,000 characters
