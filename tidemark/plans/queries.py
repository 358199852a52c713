"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import activity, distill, graph, order, prefix, ranking, routing, usage
from tidemark.sources.readers import parquet_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


FILE_STATS = """
    stats as (
        select source as path, cast(sum(raw) as bigint) as raw, cast(sum(kept) as bigint) as kept from (
            select source, ceil(length(text) / 4.0)::bigint as raw,
                ceil(length((select string_agg(line, chr(10) order by i) from (select line, min(i) as i from (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i) group by line))) / 4.0)::bigint as kept
            from documents) group by source)"""


@query(f"""with {FILE_STATS}
    select path, raw, kept, raw - kept as savings, round(100.0 * (raw - kept) / raw, 1)::double as pct, row_number() over (order by raw - kept desc, path) as place from stats""")
def rank_files_by_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_files(ranking.file_stats(parquet_table(spark, sf_dir, "documents")), "savings")


@query("select p_partkey, p_name, p_brand, p_type from part where contains(lower(p_name), 'ed') or contains(lower(p_brand), 'ed') or contains(lower(p_type), 'ed')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return ranking.search(part, ["p_name", "p_brand", "p_type"], " ED ")


#: Keywords of each route, in the order in which the first hit wins.
ROUTES = [("fasteners", ["bolt", "plate"]), ("warm", ["hot", "red "]), ("cheap", ["promo", "economy"]), ("turning", ["gear", "rod"])]


def _route_sql(column: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + f" then '{name}'" for name, words in ROUTES)
    return f"case {cases} else 'other' end"


@query(f"select {_route_sql("p_name || ' ' || p_type")} as route, p_brand, count(*) as n from part group by 1, 2")
def route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts of a brand go which way, by the first keyword in their name or type."""
    part = parquet_table(spark, sf_dir, "part")
    return part.groupBy(routing.route(F.concat("p_name", F.lit(" "), "p_type"), ROUTES, "other").alias("route"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {FILE_STATS}
    select path, raw, kept, cast(cast(raw as decimal(18,0)) * cast(3 as decimal(18,6)) / 1000000 as double) as cost_full, round((raw - kept) * 3 / 1000000.0, 6)::double as cost_avoided from stats""")
def avoided_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ranking.file_stats(parquet_table(spark, sf_dir, "documents"))
    price = F.lit("3.0").cast("decimal(18,6)")
    return stats.select("path", "raw", "kept", numbers.cost(F.col("raw"), price).cast("double").alias("cost_full"), numbers.cost(F.col("savings"), price).cast("double").alias("cost_avoided"))


@query("""with speed as (
        select user_id, round(sum(value) / greatest(date_diff('day', min(ts)::date, max(ts)::date) + 1, 1), 6) as per_day from events group by user_id),
    days as (select user_id, per_day, round(per_day * 30, 1) as month, round(2800.0 / nullif(per_day, 0))::bigint as days_left from speed)
    select *, case when days_left >= 30 then 'safe' when days_left >= 20 then 'watch' when days_left is not null then 'short' end as band from days""")
def budget_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.budget(parquet_table(spark, sf_dir, "events"), "user_id", "value", "ts", 2800.0)


@query("select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(parquet_table(spark, sf_dir, "events"), "ts", F.col("value"), "event_type").withColumn("total", F.round("total", 4))


@query("""with r as (select lang, source, cast(sum(n_chars) as bigint) as total, cast(grouping(lang, source) as bigint) as level from documents group by rollup (lang, source))
    select *, round(100.0 * total / case when level = 0 then sum(case when level = 0 then total end) over (partition by lang, level) else max(case when level = 3 then total end) over () end, 2)::double as share_pct from r""")
def usage_by_lang_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.shares(parquet_table(spark, sf_dir, "documents"), "lang", "source", F.col("n_chars"))


@query("""select user_id, event_id, round(running, 4) as running, running > 2000 as over from (
    select user_id, event_id, sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as running from events)""")
def running_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage.running(parquet_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 2000.0)
    return found.select("user_id", "event_id", F.round("running", 4).alias("running"), "over")


@query("""select event_id, user_id, event_type from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events
    where ts >= (select max(ts) from events) - interval 14 day) where n <= 10""")
def retention_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    newest = events.agg((F.max("ts") - F.expr("interval 14 days")).alias("since"))
    recent = events.join(F.broadcast(newest), F.col("ts") >= F.col("since"))
    return ranking.keep_last(recent, "user_id", [F.desc("ts"), F.desc("event_id")], 10).select("event_id", "user_id", "event_type")


@query("""with a as (select user_id, sum(value) as v from events where ts < timestamp '2024-01-16' group by 1), b as (select user_id, sum(value) as v from events where ts >= timestamp '2024-01-16' group by 1),
    j as (select coalesce(a.user_id, b.user_id) as user_id, round(coalesce(a.v, 0), 4) as before, round(coalesce(b.v, 0), 4) as after from a full join b on a.user_id = b.user_id),
    c as (select *, round(100.0 * (after - before) / nullif(before, 0), 1) as change_pct from j)
    select *, case when change_pct >= 10 then 'more' when change_pct <= -10 then 'less' when change_pct is not null then 'steady' else 'new' end as kind from c""")
def drift_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cut = parquet_table(spark, sf_dir, "events"), F.lit("2024-01-16").cast("timestamp_ntz")
    return usage.drift(events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut), "user_id", "value")


@query("""select p_partkey, p_size, p_retailprice from part p where not exists (
    select 1 from part q where q.p_size <= p.p_size and q.p_retailprice <= p.p_retailprice and (q.p_size < p.p_size or q.p_retailprice < p.p_retailprice))""")
def pareto_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pareto(parquet_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


GAPS = "g as (select *, floor(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)))::bigint as gap from events)"


@query(f"with {GAPS} select user_id, event_type, cast(coalesce(sum(case when gap <= 21600 then gap end), 0) as bigint) as active_seconds, count(*) as n_events from g group by 1, 2")
def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.active_time(parquet_table(spark, sf_dir, "events"), 21600, "user_id", "event_type")


@query(f"""with {GAPS}, s as (select *, cast(sum(case when gap is null or gap > 21600 then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as session from g),
    r as (select user_id, session, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_events from s group by 1, 2)
    select *, floor(epoch(last_ts) - epoch(first_ts))::bigint as seconds from r where floor(epoch(last_ts) - epoch(first_ts)) >= 1200""")
def focus_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.sessions(parquet_table(spark, sf_dir, "events"), 21600, 1200)


@query("""with f as (select e.user_id, e.ts, (select min(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts > e.ts or (p.ts = e.ts and p.event_id > e.event_id))) as next_ts from events e where event_type = 'error')
    select user_id, count(*) as failures, count(next_ts) as recovered, round(avg(floor(epoch(next_ts) - epoch(ts))), 6) as mean_seconds from f group by user_id""")
def recovery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.recovery(parquet_table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""select e.event_id, case when floor(epoch((select min(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'error' and (p.ts > e.ts or (p.ts = e.ts and p.event_id > e.event_id)))) - epoch(e.ts)) <= 86400 then 'detour' else 'accelerated' end as label
    from events e where event_type = 'click'""")
def friction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.friction(parquet_table(spark, sf_dir, "events"), F.col("event_type") == "click", F.col("event_type") == "error", 86400).select("event_id", "label")


@query("""select case when user_id % 2 = 0 then 'even' else 'odd' end as cohort, count(*) as n, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6)::double as failure_rate,
    round(count(*) filter (event_type <> 'error')::double / count(*), 6) as pass_rate from events group by 1""")
def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.rates(parquet_table(spark, sf_dir, "events"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), F.col("event_type") == "error")


@query("""with d as (select o_orderpriority in ('1-URGENT', '2-HIGH') as urgent, date_diff('day', o_orderdate::date, l_shipdate::date) as days from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= o_orderdate)
    select *, median_in - median_out as delta from (select median(days) filter (urgent)::double as median_in, median(days) filter (not urgent)::double as median_out from d)""")
def lead_time_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    items = parquet_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    joined = orders.join(items, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
    return activity.median_delta(joined, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.datediff("l_shipdate", "o_orderdate"))


@query("select sha256(text) as digest, count(*) as n, ((count(*) - 1) * max(length(text)))::bigint as repeated_chars from documents group by 1 having count(*) > 1")
def repeat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.repeats(parquet_table(spark, sf_dir, "documents"), "text")


@query("select conv_id, count(*) as n, round(regr_slope(length(text)::double, turn::double), 6) as slope from conversations group by 1")
def growth_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trend(parquet_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"))


def _replaced_sql(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        pattern, by = pattern.removeprefix("(?i)").replace("'", "''"), by.replace("$", "\\")
        column = f"regexp_replace({column}, '{pattern}', '{by}', '{flags}')"
    return column


@query(f"select doc_id, sha256({_replaced_sql('text', text.SECRET_RULES)}) as digest, {_replaced_sql('text', text.SECRET_RULES)} <> text as changed from documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.redact(F.col("text"))
    return parquet_table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("digest"), (clean != F.col("text")).alias("changed"))


EVENT_TEXT_SQL = "case when event_type in ('click', 'error') then concat('turn ', event_id, ' at ', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', event_type, ' ', props) else concat(event_type, ' ', props) end"


@query(f"select event_id, {_replaced_sql(EVENT_TEXT_SQL, text.VOLATILE_RULES)} as stable, {_replaced_sql(EVENT_TEXT_SQL, text.VOLATILE_RULES)} <> {EVENT_TEXT_SQL} as changed from events")
def neutralize_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("turn "), F.col("event_id").cast("string"), F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" "), "props")
    line = F.when(F.col("event_type").isin("click", "error"), line).otherwise(F.concat("event_type", F.lit(" "), "props"))
    return prefix.neutralized(parquet_table(spark, sf_dir, "events"), line).select("event_id", "stable", "changed")


@query("""with t as (select conv_id, cast(sum(ceil(length(text) / 4.0)) as bigint) as tokens from conversations group by 1), c as (select * from (values ('huge', 32768), ('large', 1024), ('medium', 128), ('small', 64)) v(provider, chunk))
    select conv_id, tokens, provider, chunk::bigint as chunk, ((chunk - tokens % chunk) % chunk)::bigint as pad, (tokens + (chunk - tokens % chunk) % chunk)::bigint as aligned, (tokens - tokens % chunk)::bigint as cached, tokens >= 1024 as may_cache from t, c""")
def quantize_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = parquet_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(text.token_estimate(F.col("text"))).alias("n"))
    found = prefix.quantized(tokens, F.col("n"), numbers.CHUNKS).withColumn("may_cache", numbers.may_cache(F.col("tokens")))
    return found.drop("n")


@query("select doc_id, sha1('blob '::blob || (octet_length(encode(text))::varchar)::blob || '\\x00'::blob || encode(text)) as digest from documents")
def blob_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet_table(spark, sf_dir, "documents").select("doc_id", text.blob_sha1(F.col("text")).alias("digest"))


@query(f"""with r as (select *, row_number() over (partition by conv_id order by turn desc, role, text) as n from conversations)
    select conv_id, count(*) as n_turns, left(string_agg('- **' || role || '**: ' || {_replaced_sql('text', text.SECRET_RULES)}, chr(10) order by n desc), 4000) as markdown from r where n <= 6 group by 1""")
def handoff_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.handoff(parquet_table(spark, sf_dir, "conversations"))


@query("""with n as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role, text) as place, count(*) over (partition by conv_id) as total from conversations)
    select *, greatest(total - 6, 0) as omitted from n where place <= 3 or place > total - 3""")
def head_tail_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.head_tail(parquet_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"]).drop("text")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
    m as (select *, case when line = lag(line) over (partition by doc_id order by pos) then 0 else 1 end as fresh from l),
    r as (select *, cast(sum(fresh) over (partition by doc_id order by pos rows unbounded preceding) as bigint) as run from m)
    select doc_id, run, min(pos)::bigint as pos, count(*) as times, min(line) as line from r group by 1, 2""")
def collapse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.collapsed(parquet_table(spark, sf_dir, "documents"), "doc_id")


@query("select distinct p_brand, p_type, p_size from part except select p_brand, p_type, p_size from part join lineitem on p_partkey = l_partkey where l_returnflag = 'R' and l_quantity >= 45")
def contract_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts of which none came back in a large lot."""
    part = parquet_table(spark, sf_dir, "part")
    back = parquet_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return routing.removed(part, part.join(back, "p_partkey", "left_semi"), ["p_brand", "p_type", "p_size"])


@query("""select n_name, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, cast(grouping(n_name, o_orderpriority) as bigint) as level, count(distinct o_custkey) as customers
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by cube (n_name, o_orderpriority)""")
def nation_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (parquet_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.cube("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("bigint").alias("level"), F.count_distinct("o_custkey").alias("customers"))


@query("""with a as (select distinct o_custkey from orders where year(o_orderdate) = (select min(year(o_orderdate)) from orders)), b as (select distinct o_custkey from orders where year(o_orderdate) = (select min(year(o_orderdate)) + 1 from orders))
    select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'first only', count(*) from (select * from a except select * from b)
    union all select 'second only', count(*) from (select * from b except select * from a) union all select 'any', count(*) from (select * from a union select * from b)""")
def setops_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet_table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    first = orders.agg(F.min("y").alias("y0"))
    numbered = orders.join(F.broadcast(first)).select("o_custkey", (F.col("y") - F.col("y0")).alias("k"))
    a, b = numbered.where("k = 0").select("o_custkey").distinct(), numbered.where("k = 1").select("o_custkey").distinct()
    parts = {"both": a.intersect(b), "first only": a.exceptAll(b), "second only": b.exceptAll(a), "any": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


TERMS = "(select distinct {key}, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as term from {table})"


@query(f"""with hits as (select conv_id, item_id, count(*) as score from {TERMS.format(key='conv_id', table='conversations')} p join {TERMS.format(key='item_id', table='benchmark')} c using (term) where term <> '' group by 1, 2)
    select * from (select *, row_number() over (partition by conv_id order by score desc, item_id) as place from hits) where place <= 3""")
def tool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = parquet_table(spark, sf_dir, "conversations").select("conv_id", "text")
    return routing.top_matches(prompts, parquet_table(spark, sf_dir, "benchmark"), 3, "conv_id", "item_id")


@query("""with recursive edges as (select distinct 'c' || o_custkey as src, 'o' || o_orderkey as dst from orders union select distinct 'o' || l_orderkey, 'p' || l_partkey from lineitem),
    reach(node, depth) as (select 'c' || c_custkey, 0 from customer where c_mktsegment = 'BUILDING' union all select dst, depth + 1 from reach join edges on node = src where depth < 3)
    select depth, count(*) as n from (select node, min(depth) as depth from reach group by node) group by depth""")
def closure_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders and parts lie at which distance from the customers of a segment."""
    orders, items = parquet_table(spark, sf_dir, "orders"), parquet_table(spark, sf_dir, "lineitem")
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    edges = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).unionByName(items.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))
    roots = parquet_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(name("c", "c_custkey").alias("node"))
    return graph.closure(edges, roots, 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("""select user_id, window_start, count(*) as n from (select user_id, time_bucket(interval '2 minutes', ts) as window_start from events) group by 1, 2""")
def heartbeat_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet_table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.window("ts", "2 minutes")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("window.start").alias("window_start"), "n")


@query("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(stddev_samp(value), 6) as spread, count(distinct user_id) as users,
    count(*) filter (value > 50) as large, round(max(value) filter (user_id % 2 = 0), 6) as even_max from events group by 1""")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet_table(spark, sf_dir, "events")
    medians = order.quantiles(events, ["event_type"], F.col("value"), 0.5, "median").withColumn("median", F.round("median", 6))
    sums = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("spread"),
        F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.max(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 6).alias("even_max"),
    )
    return sums.join(medians, "event_type", "left")


@query("""select o_custkey, o_orderkey, dense_rank() over w as dr, rank() over w as r, ntile(4) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as quarter, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd,
    nth_value(o_orderkey, 2) over (partition by o_custkey order by o_totalprice desc, o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey order by o_orderpriority)""")
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderpriority")
    by_price = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return parquet_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.dense_rank().over(w).cast("bigint").alias("dr"), F.rank().over(w).cast("bigint").alias("r"), F.ntile(4).over(by_price).cast("bigint").alias("quarter"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.nth_value("o_orderkey", 2).over(by_price.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second"),
    )


@query("""select c_mktsegment, cast(coalesce(sum(case when o_orderstatus = 'F' then 1 end), 0) as bigint) as f, cast(coalesce(sum(case when o_orderstatus = 'O' then 1 end), 0) as bigint) as o, cast(coalesce(sum(case when o_orderstatus = 'P' then 1 end), 0) as bigint) as p
    from customer left join orders on c_custkey = o_custkey group by 1""")
def segment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = parquet_table(spark, sf_dir, "customer"), parquet_table(spark, sf_dir, "orders")
    wide = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("c_mktsegment", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("F", "O", "P")])


@query("""select doc_id, lang, ceil(length(text) / 4.0)::bigint as tokens, octet_length(encode(text))::bigint as bytes, octet_length(encode(text)) <= 2048 as fits from documents""")
def context_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bytes_ = F.octet_length("text").cast("bigint")
    return parquet_table(spark, sf_dir, "documents").select("doc_id", "lang", text.token_estimate(F.col("text")).alias("tokens"), bytes_.alias("bytes"), (bytes_ <= 2048).alias("fits"))


@query("""select doc_id, row_number() over (partition by text order by doc_id) > 1 as reused, sha256(text) as digest from documents""")
def response_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that came before, by digest: each copy but the first could have been reused."""
    return prefix.reused(parquet_table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "reused", "digest")


@query("""with s as (select *, sum(coalesce(length(text), 0)) over (partition by conv_id order by turn, role, text rows unbounded preceding) as spent from conversations) select conv_id, turn, role, cast(spent as bigint) as spent from s where spent <= 1500""")
def budgeted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = parquet_table(spark, sf_dir, "conversations").withColumn("chars", F.coalesce(F.length("text"), F.lit(0)))
    return routing.within_budget(sized, "conv_id", ["turn", "role", "text"], "chars", 1500).select("conv_id", "turn", "role", "spent")
