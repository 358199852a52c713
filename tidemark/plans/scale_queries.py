"""Registered queries of operators that hold no more than a part of the rows anywhere: order, tamper evidence, retrieval, recursion, snapshots and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import distill, graph, merkle, order, prefix, routing, sketches
from tidemark.plans.queries import TERMS, _replaced_sql, query
from tidemark.sources import readers, sinks, snapshots
from tidemark.sources.readers import parquet_table


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders")
def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each order among all, dearest first."""
    orders = parquet_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return order.placed(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "place")


@query("select o_orderkey, sum(round(o_totalprice * 100)::bigint) over (order by o_orderdate, o_orderkey rows unbounded preceding)::bigint as running_cents from orders")
def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue in cents up to each order, over all orders by date."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    orders = parquet_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", cents)
    return order.summed(orders, [F.asc("o_orderdate"), F.asc("o_orderkey")], "cents", "running_cents").select("o_orderkey", "running_cents")


# Two exports of orders: in the second some are gone, some changed and some new. Trees of DEPTH levels.

DEPTH = 3
DEAR = 480_000
RECORD_SQL = "concat_ws('|', o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::bigint, o_orderpriority)"
EDITED_SQL = f"""(select case when o_orderpriority = '3-MEDIUM' and dear then -o_orderkey else o_orderkey end as o_orderkey, o_custkey, case when o_orderpriority = '5-LOW' and dear then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderpriority
    from (select *, o_totalprice >= {DEAR} as dear from orders) where not (o_orderpriority = '1-URGENT' and dear))"""


def _tree_sql(name: str, rows: str) -> str:
    levels = [f"{name}_rows as (select o_orderkey, sha256({RECORD_SQL}) as digest, left(sha256(o_orderkey::varchar), {DEPTH}) as node from {rows})"]
    levels.append(f"{name}_{DEPTH} as (select node, sum(n)::bigint as rows, sha256(string_agg(entry, '' order by entry)) as digest from (select node, count(*) as n, digest || ':' || count(*) || ';' as entry from {name}_rows group by node, digest) group by node)")
    for d in range(DEPTH - 1, -1, -1):
        levels.append(f"{name}_{d} as (select left(node, {d}) as node, sum(rows)::bigint as rows, sha256(string_agg(node[{d + 1}] || '=' || digest || ';', '' order by node)) as digest from {name}_{d + 1} group by 1)")
    return ", ".join(levels)


def _order_leaves(orders: DataFrame, bits: int = merkle.HEX) -> DataFrame:
    record = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), "o_orderpriority")
    return merkle.leaves(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), ["o_orderkey"], DEPTH, record, bits)


def _edited_orders(orders: DataFrame) -> DataFrame:
    dear = F.col("o_totalprice") >= DEAR
    of = lambda priority: (F.col("o_orderpriority") == priority) & dear
    kept = orders.where(~of("1-URGENT"))
    return kept.withColumns({"o_orderkey": F.when(of("3-MEDIUM"), -F.col("o_orderkey")).otherwise(F.col("o_orderkey")), "o_orderstatus": F.when(of("5-LOW"), "X").otherwise(F.col("o_orderstatus"))})


@query(f"with {_tree_sql('a', 'orders')} select 0 as level, node, rows, digest from a_0 union all select 1, node, rows, digest from a_1")
def merkle_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over all orders and the nodes below it."""
    nodes = merkle.tree(_order_leaves(parquet_table(spark, sf_dir, "orders")), DEPTH)
    return nodes.where("level <= 1").select("level", "node", "rows", "digest")


@query(f"""with {_tree_sql('a', 'orders')}, {_tree_sql('b', EDITED_SQL)}
    select coalesce(a.node, b.node) as node, case when a.node is null then 'added' when b.node is null then 'removed' else 'changed' end as change, a.rows as rows_before, b.rows as rows_after
    from a_{DEPTH} a full join b_{DEPTH} b on a.node = b.node where a.digest is distinct from b.digest""")
def merkle_changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in which two exports differ, found from the root down."""
    orders = parquet_table(spark, sf_dir, "orders")
    return merkle.changed_blocks(merkle.tree(_order_leaves(orders), DEPTH), merkle.tree(_order_leaves(_edited_orders(orders)), DEPTH), DEPTH)


@query(f"""with d as (select o_orderkey, o_orderpriority as p from orders where o_totalprice >= {DEAR})
    select o_orderkey, 'removed' as change from d where p in ('1-URGENT', '3-MEDIUM') union all select -o_orderkey, 'added' from d where p = '3-MEDIUM' union all select o_orderkey, 'changed' from d where p = '5-LOW'""")
def merkle_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in which they differ, of these blocks alone."""
    orders = parquet_table(spark, sf_dir, "orders")
    a, b = _order_leaves(orders), _order_leaves(_edited_orders(orders))
    return merkle.changed_rows(a, b, merkle.changed_blocks(merkle.tree(a, DEPTH), merkle.tree(b, DEPTH), DEPTH), ["o_orderkey"])


@query(f"select o_orderkey, o_orderstatus <> 'P' as proved, case when o_orderstatus <> 'P' then {DEPTH + 1} end as steps from orders where o_orderpriority = '2-HIGH'")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders as they are claimed to be are in the export; claims about pending ones name another status."""
    orders = parquet_table(spark, sf_dir, "orders")
    bits = merkle.bits_for(orders.count(), DEPTH)
    nodes = merkle.tree(_order_leaves(orders, bits), DEPTH, bits)
    claims = orders.where("o_orderpriority = '2-HIGH'").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    found = merkle.proofs(_order_leaves(claims, bits), nodes, DEPTH, bits)
    root = nodes.where("level = 0").select(F.col("digest").alias("root"))  # one row
    return found.join(F.broadcast(root)).select("o_orderkey", merkle.proved(F.col("digest"), F.col("proof"), F.col("root")).alias("proved"), F.when(F.col("proof").isNotNull(), F.size("proof")).alias("steps"))


@query("""with recursive edges as (select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem union select 'c' || o_custkey, 'o' || o_orderkey from orders union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'r' || n_regionkey, 'n' || n_nationkey from nation),
    hit(node, depth) as (select 'p' || p_partkey, 0 from part where p_size = 1 union select src, depth + 1 from hit join edges on node = dst where depth < 4)
    select depth, left(node, 1) as kind, count(*) as n from (select node, min(depth) as depth from hit group by node) where left(node, 1) <> 'p' group by 1, 2""")
def affected_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders, customers, nations and regions a change of the smallest parts reaches, over how many steps."""
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    tables = [("lineitem", "o", "l_orderkey", "p", "l_partkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("nation", "r", "n_regionkey", "n", "n_nationkey")]
    parts = [parquet_table(spark, sf_dir, t).select(name(a, src).alias("src"), name(b, dst).alias("dst")) for t, a, src, b, dst in tables]
    edges = parts[0]
    for df in parts[1:]:
        edges = edges.unionByName(df)
    changed = parquet_table(spark, sf_dir, "part").where("p_size = 1").select(name("p", "p_partkey").alias("node"))
    targets = edges.select(F.col("src").alias("node")).distinct()
    found = graph.affected(edges, changed, targets, 4).withColumn("kind", F.substring("node", 1, 1))
    return found.groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n"))


_WEIGHTED = f"""c as {TERMS.format(key='item_id', table='benchmark')}, p as {TERMS.format(key='conv_id', table='conversations')},
    w as (select term, round(1000 * ln(1 + (select count(distinct item_id) from benchmark) / count(*)))::bigint as weight from c where term <> '' group by term)"""


@query(f"""with {_WEIGHTED}, hits as (select conv_id, item_id, sum(weight)::bigint as score from p join w using (term) join c using (term) group by 1, 2)
    select * from (select *, row_number() over (partition by conv_id order by score desc, item_id) as place from hits) where place <= 3""")
def ranked_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best items for each conversation by shared words, rare ones first."""
    prompts = parquet_table(spark, sf_dir, "conversations").select("conv_id", "text")
    return routing.ranked_matches(prompts, parquet_table(spark, sf_dir, "benchmark"), 3, "conv_id", "item_id")


# Two snapshots of texts: in the second one secrets are redacted, one language has moved and another is gone, and benchmark items are new.

BLOB_SQL = "sha1('blob '::blob || (octet_length(encode(text))::varchar)::blob || '\\x00'::blob || encode(text))"


@query(f"""with a as (select lang || '/' || doc_id as path, text from documents),
    b as (select case lang when 'fr' then 'archive/' else '' end || lang || '/' || doc_id as path, {_replaced_sql('text', text.SECRET_RULES)} as text from documents where lang <> 'es' union all select 'benchmark/' || item_id, text from benchmark),
    x as (select path, {BLOB_SQL} as digest, octet_length(encode(text))::bigint as bytes from a), y as (select path, {BLOB_SQL} as digest, octet_length(encode(text))::bigint as bytes from b),
    d as (select coalesce(x.path, y.path) as path, case when x.path is null then 'added' when y.path is null then 'removed' else 'changed' end as change, x.bytes as bytes_before, y.bytes as bytes_after, x.digest as old, y.digest as new from x full join y on x.path = y.path where x.digest is distinct from y.digest),
    gone as (select old, min(path) as moved_from from d where change = 'removed' group by 1)
    select path, change, bytes_before, bytes_after, moved_from from d left join gone on d.change = 'added' and d.new = gone.old""")
def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    before = docs.select(path.alias("path"), "text")
    moved = F.when(F.col("lang") == "fr", F.concat(F.lit("archive/"), path)).otherwise(path)
    after = docs.where("lang <> 'es'").select(moved.alias("path"), text.redact(F.col("text")).alias("text"))
    items = parquet_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), "text")
    return snapshots.differences(snapshots.manifest_of(before), snapshots.manifest_of(after.unionByName(items)))


QUANTILES = [0.1, 0.5, 0.9]


@query(f"select event_type, count(*)::bigint as n, count(distinct ts::date) as days, true as values_close, true as members_close, {len(QUANTILES)}::int as n_quantiles from events group by 1")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and users of each event type from daily sketches, held against exact ranks and counts of all rows: whether they keep the stated bounds."""
    events = parquet_table(spark, sf_dir, "events")
    found = sketches.merged(sketches.daily(events, "ts", ["event_type"], F.col("value"), F.col("user_id")), ["event_type"], QUANTILES)
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    held = sketches.rank_errors(events, found, ["event_type"], F.col("value"), QUANTILES).join(exact, "event_type")
    members = F.abs(F.col("members") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.COUNT_ERROR)
    return held.select("event_type", "n", "days", (F.col("rank_error") <= sketches.RANK_ERROR).alias("values_close"), members.alias("members_close"), F.size("quantiles").alias("n_quantiles"))


# Test output of six frameworks: of each user, one framework's lines for each event.

PARTS = {
    "pytest": {"bad": ["___ test_{} ___", "    assert x == 1", "E   assert {} == 1", "", "t.py:7: AssertionError"], "good": ["t.py::test_{} PASSED"], "end": "=== short summary"},
    "jest": {"bad": ["  ● case {}", "", "    expect(received)", "      at run (a.js:{})"], "good": ["  ✓ case {}"], "end": "Tests: done"},
    "go": {"bad": ["--- FAIL: Test{} (0.00s)", "    a_test.go:9: got {}", "        want 1"], "good": ["=== RUN   Test{}", "--- PASS: Test{} (0.00s)"], "end": "ok  pkg"},
    "cargo": {"bad": ["---- case_{} stdout ----", "thread 'main' panicked at {}", "note: backtrace"], "good": ["test case_{} ... ok"], "end": "test result: done"},
    "junit": {"bad": ["[ERROR] case{}  FAILURE!", "java.lang.AssertionError: {}", "\tat a.B.c(B.java:1)"], "good": ["[INFO] Tests run: {}, Failures: 0"], "end": "[INFO] done"},
    "gtest": {"bad": ["a.cc:{}: Failure", "Expected: 1", "  Actual: {}", "[  FAILED  ] A.b{}"], "good": ["[ RUN      ] A.b{}", "[       OK ] A.b{}"], "end": "[  PASSED  ] all"},
    "other": {"bad": ["bad {}"], "good": ["good {}"], "end": "end"},
}
KINDS = list(PARTS)


def _lines_sql() -> str:
    of = lambda lines: "[" + ", ".join("'" + x.replace("'", "''").replace("{}", "' || event_id || '") + "'" for x in lines) + "]"
    cases = " ".join(f"when user_id % {len(KINDS)} = {k} and event_type = '{t}' then {of(p[part])}" for k, p in enumerate(PARTS.values()) for t, part in (("error", "bad"), ("click", "good")))
    ends = " ".join(f"when user_id % {len(KINDS)} = {k} and event_type = 'view' then {of([p['end']])}" for k, p in enumerate(PARTS.values()))
    names = " ".join(f"when {k} then '{n}'" for k, n in enumerate(KINDS))
    return f"""told as (select user_id as run_id, case user_id % {len(KINDS)} {names} end as framework, event_id, case {cases} {ends} else ['log ' || event_id] end as lines from events),
        flat as (select run_id, framework, event_id, unnest(lines) as line, unnest(range(len(lines))) as i from told),
        o as (select run_id, framework, row_number() over (partition by run_id order by event_id, i) - 1 as pos, line from flat)"""


def _mark_sql(table: dict[str, str]) -> str:
    return "case framework " + " ".join(f"when '{n}' then regexp_matches(line, '{p}')" for n, p in table.items()) + " else false end"


BLOCKS_SQL = f"""{_lines_sql()},
    m as (select *, case when {_mark_sql(distill.BEGINS)} then 1 when {_mark_sql(distill.ENDS)} then 0 end as mark from o),
    t as (select *, last_value(mark ignore nulls) over w as inside, count(*) filter (mark = 1) over w as block from m window w as (partition by run_id order by pos rows unbounded preceding))"""


def framework_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(lines: list[str]):
        return F.array(*[F.concat(*[x for k, part in enumerate(line.split("{}")) for x in ([F.col("event_id").cast("string")] if k else []) + [F.lit(part)]]) for line in lines])

    kind, lines = F.col("user_id") % len(KINDS), F.array(F.concat(F.lit("log "), F.col("event_id").cast("string")))
    name = F.lit(None).cast("string")
    for k, (n, p) in enumerate(PARTS.items()):
        name = F.when(kind == k, n).otherwise(name)
        for event, said in (("error", p["bad"]), ("click", p["good"]), ("view", [p["end"]])):
            lines = F.when((kind == k) & (F.col("event_type") == event), of(said)).otherwise(lines)
    flat = parquet_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), name.alias("framework"), "event_id", F.posexplode(lines).alias("i", "line"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("event_id", "i")) - 1
    return flat.select("run_id", "framework", place.cast("bigint").alias("pos"), "line")


@query(f"with {BLOCKS_SQL} select run_id, framework, block, pos, line from t where inside = 1")
def failure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports of failures in the output of six frameworks."""
    return distill.failure_blocks(framework_output(spark, sf_dir))


@query(f"""with {BLOCKS_SQL}, k as (select *, coalesce(inside = 1, false) or {_mark_sql(distill.FAILED)} as keep, {_mark_sql(distill.PASSED)} as passed from t), a as (select *, bool_or(keep) over (partition by run_id) as any_keep from k)
    select framework, run_id, count(*) as n, sha256(string_agg(line, chr(10) order by pos)) as digest from a where case when framework = 'other' then true when any_keep then keep else not passed end group by 1, 2""")
def failure_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distill.failure_digest(framework_output(spark, sf_dir))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return found.groupBy("framework", "run_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(ordered, 256).alias("digest"))


@query("""select c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 6) as quarter, round(quantile_cont(c_acctbal, 0.5), 6) as half, round(quantile_cont(c_acctbal, 0.99), 6) as most from customer group by 1""")
def balance_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of balances by segment, without a task that holds a segment's values."""
    customer, out = parquet_table(spark, sf_dir, "customer"), None
    for name, q in (("quarter", 0.25), ("half", 0.5), ("most", 0.99)):
        found = order.quantiles(customer, ["c_mktsegment"], F.col("c_acctbal"), q, name).withColumn(name, F.round(name, 6))
        out = found if out is None else out.join(found, "c_mktsegment")
    return out


@query("""with r as (select '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}' as record from orders) select record, sha256(record) as sha256 from r""")
def stamped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit export: each order as JSON with its digest."""
    return sinks.stamped(parquet_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("""with n as (select n_nationkey, n_name, count(s_suppkey) as c from nation left join supplier on n_nationkey = s_nationkey group by 1, 2)
    select n_nationkey, 'tool-' || n_name as name, case when c = 0 then null else 'run' end as command, case when c = 0 then null else ['--n', c::varchar] end as args from n
    union all select n_nationkey, 'log', 'tail', ['-f'] from n where c > 0""")
def server_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servers named in JSON configurations, one of each nation; some name none or leave out how they start."""
    nation, supplier = parquet_table(spark, sf_dir, "nation"), parquet_table(spark, sf_dir, "supplier")
    counted = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("c"))
    some = F.concat(F.lit('{"tool-'), "n_name", F.lit('":{"command":"run","args":["--n","'), F.col("c").cast("string"), F.lit('"]},"log":{"command":"tail","args":["-f"]}}'))
    none = F.concat(F.lit('{"tool-'), "n_name", F.lit('":{}}'))
    return readers.server_configs(counted.select("n_nationkey", F.when(F.col("c") > 0, some).otherwise(none).alias("text"))).select("n_nationkey", "name", "command", "args")


@query("""with p as (select conv_id, case when turn % 3 = 0 then 'selection' else 'workspace' end as kind, 'turn' || turn as name, text, role <> 'assistant' as saved from conversations),
    s as (select *, sum(ceil(length(text) / 4.0)::bigint) over (partition by conv_id order by kind, name, text rows unbounded preceding) as spent from p where saved),
    g as (select conv_id, sha256(string_agg(text, chr(10) order by kind, name, text)) as digest, max(spent)::bigint as tokens from s where spent <= 200 group by 1)
    select c.conv_id, coalesce(digest, sha256('')) as digest, coalesce(tokens, 0) as tokens from (select distinct conv_id from conversations) c left join g using (conv_id)""")
def request_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes along with each conversation's request: saved selections and workspace text within 200 tokens."""
    turns = parquet_table(spark, sf_dir, "conversations")
    parts = turns.select("conv_id", F.when(F.col("turn") % 3 == 0, "selection").otherwise("workspace").alias("kind"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("name"), "text", (F.col("role") != "assistant").alias("saved"))
    requests = turns.select("conv_id").distinct().withColumn("text", F.lit(""))
    found = prefix.contextual(requests, parts, "automatic", most_tokens=200, key="conv_id")
    return found.select("conv_id", F.sha2("context", 256).alias("digest"), F.col("context_tokens").alias("tokens"))
