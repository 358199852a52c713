"""More registered queries: ledgers, runs, policies, tool schemas, scalars, joins and windows. Each with SQL that gives the same rows.

Tables that the driver lacks are derived from its own: a ledger of requests, steps of runs and test output from events, tool schemas from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.operators import activity, distill, graph, prefix, ranking, routing, states, usage
from tidemark.plans.queries import FILE_STATS, TERMS, query
from tidemark.sources.readers import parquet_table

LEDGER_SQL = "(select event_id as req_id, ts, user_id, event_type as model, floor(value * 100)::bigint as input_tokens, floor(value * 40)::bigint as cached_tokens, user_id as output_tokens, case when event_type in ('error', 'view') then 'estimated' else 'observed' end as kind from events)"
PRICES = [("click", 30, 3), ("purchase", 150, 15), ("view", 10, 1), ("unused", 99, 9)]
PRICES_SQL = "(select * from (values " + ", ".join(f"('{m}', {a}, {b})" for m, a, b in PRICES) + ") v(model, full_per_m, cached_per_m))"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda factor: F.floor(F.col("value") * factor).cast("bigint")
    kind = F.when(F.col("event_type").isin("error", "view"), "estimated").otherwise("observed")
    return parquet_table(spark, sf_dir, "events").select(F.col("event_id").alias("req_id"), "ts", "user_id", F.col("event_type").alias("model"), whole(100).alias("input_tokens"), whole(40).alias("cached_tokens"), F.col("user_id").alias("output_tokens"), kind.alias("kind"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, full_per_m int, cached_per_m int")


COSTS_SQL = "select req_id, round(input_tokens * full_per_m / 1e6, 6) as cost_full, round((input_tokens - cached_tokens) * full_per_m / 1e6 + cached_tokens * cached_per_m / 1e6, 6) as cost_cached, round(cached_tokens * (full_per_m - cached_per_m) / 1e6, 6) as cost_avoided"


def _costs(df: DataFrame) -> DataFrame:
    return df.select("req_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("cost_full", "cost_cached", "cost_avoided")])


@query(f"{COSTS_SQL} from {LEDGER_SQL} l join {PRICES_SQL} p on l.model = p.model")
def ledger_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(usage.priced(ledger(spark, sf_dir), prices(spark), "inner"))


@query(f"{COSTS_SQL} from {LEDGER_SQL} l left join {PRICES_SQL} p on l.model = p.model")
def ledger_costs_of_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(usage.priced(ledger(spark, sf_dir), prices(spark)))


@query(f"select model, cast(coalesce(sum(case when kind = 'observed' then input_tokens + output_tokens end), 0) as bigint) as observed_tokens, cast(coalesce(sum(case when kind = 'estimated' then input_tokens + output_tokens end), 0) as bigint) as estimated_tokens from {LEDGER_SQL} group by 1")
def observed_and_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.observed_and_estimated(ledger(spark, sf_dir))


@query(f"select spent, saved, round(100.0 * saved / (spent + saved), 1)::double as saved_pct from (select sum(input_tokens - cached_tokens)::bigint as spent, sum(cached_tokens)::bigint as saved from {LEDGER_SQL})")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(ledger(spark, sf_dir), F.col("input_tokens") - F.col("cached_tokens"), F.col("cached_tokens"))


@query(f"select model, round(sum(cached_tokens) / sum(input_tokens), 6) as hit_rate from {LEDGER_SQL} group by 1")
def hit_rate_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.hit_rate(ledger(spark, sf_dir), "model").withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"select count(*) as requests, count(distinct user_id) as users, sum(input_tokens + output_tokens)::bigint as tokens, round(sum(cached_tokens) / sum(input_tokens), 6) as hit_rate, count(*) filter (kind = 'estimated') as estimated from {LEDGER_SQL}")
def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.tiles(ledger(spark, sf_dir))


@query("""with s as (select user_id, floor(sum(value))::bigint as total from events group by 1) select *, round(total * 400.0 / 1000000, 6)::double as grams, case when total >= 4000 then 'gold' when total >= 3500 then 'silver' when total >= 3000 then 'bronze' when total >= 0 then 'start' end as milestone from s""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = parquet_table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(numbers.exact_sum(F.col("value"))).cast("bigint").alias("total"))
    steps = [(0, "start"), (3000, "bronze"), (3500, "silver"), (4000, "gold")]
    return sums.select("user_id", "total", usage.carbon(F.col("total"), 400.0).alias("grams"), usage.milestone(F.col("total"), steps).alias("milestone"))


@query(f"""with l as {LEDGER_SQL}, tasks as (select event_id as task_id, user_id, ts as start, ts + interval 12 hour as stop from events where event_type = 'signup')
    select task_id, coalesce(sum(input_tokens), 0)::bigint as tokens, floor(epoch(max(l.ts)) - epoch(min(l.ts)))::bigint as seconds from tasks t left join l on t.user_id = l.user_id and l.ts >= t.start and l.ts < t.stop group by 1""")
def task_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = parquet_table(spark, sf_dir, "events").where("event_type = 'signup'")
    tasks = starts.select(F.col("event_id").alias("task_id"), "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 12 hours")).alias("stop"))
    return usage.per_task(ledger(spark, sf_dir).withColumnRenamed("input_tokens", "tokens"), tasks)


@query("select conv_id, turn, role, (length(text) - lag(length(text)) over (partition by conv_id order by turn, role, text))::int as delta from conversations")
def stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = parquet_table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return usage.stage_delta(sized, "conv_id", ["turn", "role", "text"], "chars").select("conv_id", "turn", "role", "delta")


@query(f"with {FILE_STATS}, p as (select path, round(100.0 * (raw - kept) / raw, 1)::double as pct from stats) select path, pct, case when pct > 0.7 then 'high' else 'normal' end as class from p")
def savings_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ranking.file_stats(parquet_table(spark, sf_dir, "documents"))
    return stats.select("path", "pct", numbers.over_threshold(F.col("pct"), 0.7).alias("class"))


@query("select event_id, user_id from events order by ts desc, event_id desc limit 100 offset 200")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third hundred of the newest events: a page of an append log read newest first."""
    return ranking.page(parquet_table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100, 2).select("event_id", "user_id")


@query("""with l as (select doc_id, list_distinct(string_split(text, chr(10))) as x, text from documents), o as (
        select doc_id, text, (select list(line order by i) from (select line, min(i) as i from (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i) group by line)) as x from l),
    m as (select doc_id, 'off' as mode, text as t from o union all select doc_id, 'balanced', array_to_string(x, chr(10)) from o union all select doc_id, 'max', array_to_string(case when len(x) > 6 then list_concat(x[1:3], x[-3:]) else x end, chr(10)) from o)
    select doc_id, mode, ceil(length(t) / 4.0)::bigint as tokens from m""")
def optimisation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), text.token_estimate(distill.optimised(F.col("text"), m)).alias("tokens")) for m in distill.MODES])
    return docs.select("doc_id", F.explode(modes).alias("m")).select("doc_id", "m.mode", "m.tokens")


# Runs: of each user, events in order as steps.

STATE_OF = {"signup": "plan", "view": "guard", "click": "act", "purchase": "observe", "error": "rollback"}
STEPS_SQL = "steps as (select user_id as run_id, event_id as seq, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATE_OF.items()) + " end as state, event_type || (event_id % 2)::varchar as result_hash from events), w as (select *, lag(state) over v as before, lag(result_hash) over v as one, lag(result_hash, 2) over v as two from steps window v as (partition by run_id order by seq))"
LEGAL_SQL = "(before, state) in (" + ", ".join(f"('{a}', '{b}')" for a, b in states.STEPS) + ")"


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = numbers.lookup(STATE_OF, F.col("event_type"), "plan")
    return parquet_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("result_hash"))


@query(f"with {STEPS_SQL} select run_id, seq, before, state from w where before is not null and not ({LEGAL_SQL})")
def illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.illegal(run_steps(spark, sf_dir)).select("run_id", "seq", "before", "state")


@query(f"with {STEPS_SQL} select run_id, seq, coalesce(two = result_hash and one <> result_hash, false) as oscillates from w")
def oscillating_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.oscillating(run_steps(spark, sf_dir)).select("run_id", "seq", "oscillates")


# Runs of orders: each item goes through plan, guard, act and observe; heavily taxed ones skip the guard, dear ones repeat what they saw; the order's status tells the end.

ORDER_STEPS_SQL = """parts as (select * from (values (0, 'plan'), (1, 'guard'), (2, 'act'), (3, 'observe')) v(part, state)),
    li as (select l_orderkey, l_linenumber, min(l_quantity) as l_quantity, min(l_tax) as l_tax from lineitem group by 1, 2),
    os as (
        select l_orderkey as run_id, l_linenumber * 10 + part as seq, state, case when l_quantity >= 49 and part in (1, 3) then 'same' else l_linenumber || state end as result_hash from li, parts where not (part = 1 and l_tax >= 0.08)
        union all select o_orderkey, 1000, case o_orderstatus when 'F' then 'converged' else 'rollback' end, 'end' from orders where o_orderstatus <> 'O'),
    ow as (select *, lag(state) over v as before, lag(result_hash) over v as one, lag(result_hash, 2) over v as two, count(*) filter (state = 'plan') over (partition by run_id order by seq rows unbounded preceding) as turns from os window v as (partition by run_id order by seq))"""


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = parquet_table(spark, sf_dir, "lineitem"), parquet_table(spark, sf_dir, "orders")
    parts = F.posexplode(F.array(*[F.lit(s) for s in ("plan", "guard", "act", "observe")])).alias("part", "state")
    items = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_tax").alias("l_tax"))
    steps = items.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", parts).where(~((F.col("part") == 1) & (F.col("l_tax") >= 0.08)))
    result = F.when((F.col("l_quantity") >= 49) & F.col("part").isin(1, 3), "same").otherwise(F.concat(F.col("l_linenumber").cast("string"), "state"))
    steps = steps.select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 10 + F.col("part")).alias("seq"), "state", result.alias("result_hash"))
    final = F.when(F.col("o_orderstatus") == "F", "converged").otherwise("rollback")
    return steps.unionByName(orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("run_id"), F.lit(1000).alias("seq"), final.alias("state"), F.lit("end").alias("result_hash")))


@query(f"""with {ORDER_STEPS_SQL}, e as (select *, case when before is not null and not ({LEGAL_SQL}) then 'illegal' when coalesce(two = result_hash and one <> result_hash, false) then 'oscillating' when turns > 5 then 'too long' when state in ('converged', 'rollback') then state end as event from ow)
    select run_id, coalesce(arg_min(turns, seq) filter (event is not null), max(turns))::bigint as turns, coalesce(arg_min(state, seq) filter (event is not null), arg_max(state, seq)) as last_state, coalesce(arg_min(event, seq) filter (event is not null), 'running') as verdict from e group by 1""")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.run_states(order_steps(spark, sf_dir))


# Test output: of each user, events in order as lines.

OUTPUT_SQL = """o as (select user_id as run_id, case when user_id % 5 = 0 then 'unknown' else 'go' end as framework, row_number() over (partition by user_id order by event_id) - 1 as pos,
    chr(27) || '[31m' || case event_type when 'error' then '--- FAIL: ' when 'purchase' then '--- PASS: ' when 'click' then '=== RUN ' else 'log ' end || props || chr(27) || '[0m' as line from events),
    c as (select *, regexp_replace(line, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g') as clean from o),
    m as (select *, framework = 'go' and regexp_matches(clean, '--- FAIL|^FAIL|panic:') as failed, framework = 'go' and regexp_matches(clean, '^(=== RUN|--- PASS|ok )|^PASS$') as passed from c),
    n as (select *, bool_or(failed) over (partition by run_id order by pos rows between 1 preceding and 1 following) as near, bool_or(failed) over (partition by run_id) as any_failed from m),
    kept as (select run_id, framework, pos, case when framework = 'go' then clean else line end as line from n where framework <> 'go' or near or (not any_failed and not passed))"""


def test_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet_table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type") == "error", "--- FAIL: ").when(F.col("event_type") == "purchase", "--- PASS: ").when(F.col("event_type") == "click", "=== RUN ").otherwise("log ")
    line = F.concat(F.lit("\u001b[31m"), sign, F.col("props"), F.lit("\u001b[0m"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return events.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 5 == 0, "unknown").otherwise("go").alias("framework"), pos.cast("bigint").alias("pos"), line.alias("line"))


@query(f"with {OUTPUT_SQL} select * from kept")
def distilled_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.distilled(test_output(spark, sf_dir))


@query(f"with {OUTPUT_SQL} select run_id, sha256(string_agg(line, chr(10) order by pos)) as digest from kept group by 1")
def rejoined_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.rejoined(distill.distilled(test_output(spark, sf_dir))).select("run_id", F.sha2("text", 256).alias("digest"))


@query("""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)::varchar) as v from documents)
    select doc_id, case when len(v) > 6 then '["' || array_to_string(list_concat(v[1:3], v[-3:]), '","') || '"]' else '[' || array_to_string(v, ',') || ']' end as payload from l""")
def bounded_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.to_json(F.transform(F.split("text", "\n"), lambda x: F.length(x)))
    return parquet_table(spark, sf_dir, "documents").select("doc_id", distill.bounded_json(lengths).alias("payload"))


@query("select conv_id, turn, role, case when turn >= 2 and role = 'assistant' then '[resolved ' || substring(sha1(text), 1, 12) || ']' else text end as text from conversations")
def log_surgery(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = parquet_table(spark, sf_dir, "conversations").withColumn("resolved", F.col("role") == "assistant")
    return distill.surgery(turns, "resolved", F.lit(2)).select("conv_id", "turn", "role", "text")


# Tool schemas: each part has p_size % 9 + 1 parameters, the first two of them required; for some sizes the last one is an object.

PARAMS = "sequence(1, p_size % 9 + 1)"
NESTED = "i = p_size % 9 + 1 and i > 2 and p_size % 4 = 0"
TYPE_SQL = f"case when {NESTED} then 'object' when i % 2 = 0 then 'integer' else 'string' end"


def tool_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr(f"array_join(transform({PARAMS}, i -> concat('\"p', i, '\":{{\"type\":\"', if({NESTED}, 'object\",\"properties\":{{\"a\":{{\"type\":\"string', if(i % 2 = 0, 'integer', 'string')), '\"}}', if({NESTED}, '}}}}', ''))), ',')")
    schema = F.concat(F.lit('{"type":"object","properties":{'), one, F.lit('},"required":["p1","p2"]}'))
    return parquet_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), "p_size", schema.alias("schema_json"))


@query(f"""select p_partkey, any_value(p_brand) || '(' || string_agg('p' || i || case when i <= 2 then ': ' else '?: ' end || {TYPE_SQL}, ', ' order by i) || ')' as signature
    from (select p_partkey, p_brand, p_size, unnest(range(1, p_size % 9 + 2)) as i from part) group by 1""")
def tool_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_schemas(spark, sf_dir).select("p_partkey", routing.signature(F.col("name"), F.col("schema_json")).alias("signature"))


@query("select p_partkey, (p_size % 9 + 1)::int as n_params, p_size % 9 + 1 > 6 as too_many, case when p_size % 4 = 0 and p_size % 9 >= 2 then 5 else 3 end::int as depth from part")
def schema_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.schema_audit(tool_schemas(spark, sf_dir)).select("p_partkey", "n_params", "too_many", "depth")


@query("""select p_partkey, case when p_size % 9 = 0 then 'missing: p2' when p_size % 9 = 1 then 'missing: p1' when p_size % 9 = 2 then 'missing: p1, p2' end as missing,
    case when p_size % 9 >= 3 and p_size % 4 = 1 then 'p2' when p_size % 9 >= 3 and p_size % 2 = 0 then 'p1, p2' when p_size % 9 in (0, 3, 4, 5, 6, 7, 8) then 'p1' else '' end as wrong from part""")
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that lack parameters, give p1 as a number and, for even sizes, p2 as a string, or give both as quoted numbers."""
    given = F.expr("""case p_size % 9 when 0 then '{"p1":1}' when 1 then '{"p2":7}' when 2 then '{}' else case when p_size % 4 = 1 then '{"p1":"7","p2":"7"}' when p_size % 2 = 0 then '{"p1":1,"p2":"x"}' else '{"p1":1,"p2":2.0}' end end""")
    keys = F.map_keys(F.from_json("given", "map<string, string>"))
    wrong = F.array_join(routing.wrong_types(F.col("schema_json"), F.col("given")), ", ")
    called = tool_schemas(spark, sf_dir).withColumn("given", given)
    return called.select("p_partkey", routing.missing_parameters(F.array(F.lit("p1"), F.lit("p2")), keys).alias("missing"), wrong.alias("wrong"))


@query(f"""with hits as (select conv_id, item_id, count(*) as score from {TERMS.format(key='conv_id', table='conversations')} p join {TERMS.format(key='item_id', table='benchmark')} c using (term) where term <> '' group by 1, 2),
    top as (select conv_id, item_id from (select *, row_number() over (partition by conv_id order by score desc, item_id) as place from hits) where place <= 3)
    select * from top union select conv_id, unnest([0, 1]) from top""")
def pinned_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = routing.top_matches(parquet_table(spark, sf_dir, "conversations").select("conv_id", "text"), parquet_table(spark, sf_dir, "benchmark"), 3, "conv_id", "item_id")
    return routing.with_pinned(ranked, spark.createDataFrame([(0,), (1,)], "item_id long"), "conv_id", "item_id")


# Policies.

COMMAND_SQL = "case event_type when 'error' then 'RM  -rf /tmp/' || event_id when 'click' then 'git push origin main --force' when 'view' then 'drop table t' || user_id else 'ls' end"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    command = F.when(kind == "error", F.concat(F.lit("RM  -rf /tmp/"), F.col("event_id").cast("string"))).when(kind == "click", "git push origin main --force").when(kind == "view", F.concat(F.lit("drop table t"), F.col("user_id").cast("string"))).otherwise("ls")
    return parquet_table(spark, sf_dir, "events").select("event_id", command.alias("command"))


RULES_SQL = "(values " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(routing.DESTRUCTIVE)) + ") r(rule, pattern)"


@query(f"select event_id, command, rule::bigint as rule from (select event_id, {COMMAND_SQL} as command from events), {RULES_SQL} where regexp_matches(lower(command), pattern)")
def destructive_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([*enumerate(routing.DESTRUCTIVE)], "rule long, pattern string")
    return routing.flagged(commands(spark, sf_dir), rules).select("event_id", "command", "rule")


@query("""with p as (select doc_id, case when lang = 'de' then '/work/../' || source when lang = 'fr' then '/workshop/' || source when lang = 'es' then '/work' else '/work/' || source end as path from documents)
    select doc_id, path, (path = '/work' or starts_with(path, '/work/')) and not list_contains(string_split(path, '/'), '..') as confined, regexp_replace(path, '^.*/', '') as file from p""")
def confined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    path = F.when(lang == "de", F.concat(F.lit("/work/../"), "source")).when(lang == "fr", F.concat(F.lit("/workshop/"), "source")).when(lang == "es", "/work").otherwise(F.concat(F.lit("/work/"), "source"))
    docs = parquet_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return docs.select("doc_id", "path", text.confined(F.col("path"), "/work").alias("confined"), text.without_folders(F.col("path")).alias("file"))


ALLOWED = [("user", 0), ("assistant", 1), ("user", 2), ("system", 0), ("assistant", 3)]


@query("select conv_id, turn, role from conversations where (role, turn) not in (" + ", ".join(f"('{r}', {t})" for r, t in ALLOWED) + ")")
def mask_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame(ALLOWED, "role string, turn long")
    return routing.violations(parquet_table(spark, sf_dir, "conversations"), allowed, ["role", "turn"]).select("conv_id", "turn", "role")


@query("select event_id, case when value > 250 then 'big' else 'small' end || ';' || case event_type when 'error' then 'deny' when 'view' then 'ask' else 'allow' end as trace, case event_type when 'error' then 'small-model' when 'click' then 'medium-model' else 'large-model' end as advice from events")
def decision_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("size", F.when(F.col("value") > 250, "big").otherwise("small")), ("gate", numbers.lookup({"error": "deny", "view": "ask"}, F.col("event_type"), "allow"))]
    traced = parquet_table(spark, sf_dir, "events").withColumn("trace", routing.trace(rules))
    return traced.select("event_id", F.array_join(F.col("trace.value"), ";").alias("trace"), routing.advised_model(F.col("event_type"), {"error": "small-model", "click": "medium-model"}, "large-model").alias("advice"))


# Prefixes and graphs.

BLOB_SQL = "sha1('blob '::blob || (octet_length(encode({0}))::varchar)::blob || '\\x00'::blob || encode({0}))"
ORDER_SQL = f"files as (select 'r' || r_regionkey as id, r_name as text, 0 as level from region union all select 'n' || n_nationkey, n_name, 1 from nation), f as (select id, level, {BLOB_SQL.format('text')} as digest from files), p as (select *, row_number() over (order by level, digest, id) as place from f)"


def ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = parquet_table(spark, sf_dir, "region"), parquet_table(spark, sf_dir, "nation")
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    files = region.select(name("r", "r_regionkey").alias("id"), F.col("r_name").alias("text")).unionByName(nation.select(name("n", "n_nationkey").alias("id"), F.col("n_name").alias("text")))
    return prefix.topological(files, nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")), 4)


@query(f"with {ORDER_SQL} select id, level::int as level, digest, place from p")
def prefix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_files(spark, sf_dir).select("id", "level", "digest", "place")


@query(f"with {ORDER_SQL} select sha256(string_agg(digest, chr(10) order by place)) as digest from p")
def prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.prefix_digest(ordered_files(spark, sf_dir))


@query("select conv_id, sha256(string_agg(text, chr(10) order by tier, role, text)) as digest from (select *, case role when 'system' then 1 when 'user' then 2 else 3 end as tier from conversations) group by 1")
def layered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    parts = parquet_table(spark, sf_dir, "conversations").select("conv_id", tier.alias("tier"), F.col("role").alias("name"), "text")
    return prefix.layered(parts, "conv_id").select("conv_id", F.sha2("prompt", 256).alias("digest"))


@query("select conv_id, turn, role, (case when 8 - turn <= 3 then 3 else 1 end)::int as tier from conversations")
def demoted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix.demoted(parquet_table(spark, sf_dir, "conversations"), "turn", F.lit(8), 3).select("conv_id", "turn", "role", "tier")


@query("""with r as (select event_id, ts, sha256(event_type || ' ' || user_id || ' ' || props) as digest, ts < timestamp '2024-01-16' as early from events)
    select event_id from r where not early and digest in (select digest from r where early)""")
def cached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the second half of the month whose like was made in the first half."""
    digest = F.sha2(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), "props"), 256)
    requests = parquet_table(spark, sf_dir, "events").select("event_id", "ts", digest.alias("digest"))
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    return requests.where(F.col("ts") >= half).join(requests.where(F.col("ts") < half).select("digest"), "digest", "left_semi").select("event_id")


@query("""with hit as (select distinct o_custkey from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where p_size = 1) select 'c' || o_custkey as node, 2::int as depth from hit""")
def affected_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that a change of the smallest parts reaches: the closure over reversed edges."""
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    orders, items, part = (parquet_table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    edges = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).unionByName(items.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))
    targets = parquet_table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node"))
    return graph.affected(edges, part.where("p_size = 1").select(name("p", "p_partkey").alias("node")), targets, 2)


@query("with s as (select distinct source from documents), b as (select distinct lang, source from documents) select 'inc/' || s.source || '.h' as header, lang || '/' || b.source || '.cc' as source from s join b on s.source = b.source")
def header_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet_table(spark, sf_dir, "documents")
    headers = docs.select(F.concat(F.lit("inc/"), "source", F.lit(".h")).alias("path")).distinct()
    return graph.header_sources(headers, docs.select(F.concat("lang", F.lit("/"), "source", F.lit(".cc")).alias("path")).distinct())


# Activity.


@query("""select e.event_id, (select max(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'click' and (p.ts < e.ts or (p.ts = e.ts and p.event_id < e.event_id))) as last_ts from events e where event_type = 'error'""")
def prompts_before_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.last_event(parquet_table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("event_type") == "click").select("event_id", "last_ts")


@query("""with g as (select *, floor(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)))::bigint as gap from events), s as (select *, sum(case when gap is null or gap > 21600 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from g),
    r as (select user_id, session, floor(epoch(max(ts)) - epoch(min(ts)))::bigint as seconds from s group by 1, 2)
    select user_id, round(coalesce(sum(case when seconds >= 1200 then seconds else 0 end) / nullif(sum(seconds), 0), 0), 6) as flow from r group by 1""")
def flow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.flow(parquet_table(spark, sf_dir, "events"), 21600, 1200).withColumn("flow", F.round("flow", 6))


@query("select source, cast(coalesce(sum(case when lang = 'en' then n end), 0) as bigint) as human, cast(coalesce(sum(case when lang <> 'en' then n end), 0) as bigint) as ai from (select source, lang, len(string_split(text, chr(10))) as n from documents) group by 1")
def lines_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parquet_table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "en", "human").otherwise("ai").alias("origin"), F.size(F.split("text", "\n")).cast("bigint").alias("n"))
    return activity.by_origin(lines, "source", "origin", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as first_ts, count(*) as n from s group by user_id, k""")
def paused_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parquet_table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("first_ts"), "n")


@query("select event_type, w as window_start, count(*) as n from (select event_type, unnest([time_bucket(interval '3 hours', ts), time_bucket(interval '3 hours', ts) - interval 3 hour]) as w from events) group by 1, 2")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parquet_table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours", "3 hours")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("event_type", F.col("window.start").alias("window_start"), "n")


# Scalars.


@query("""select p_partkey, replace(replace('<' || p_type || ' & "' || p_name || '">', '&', '&amp;'), '<', '&lt;') as half_escaped, replace(replace(replace(replace('<' || p_type || ' & "' || p_name || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped,
    format('{:,}', p_partkey * 1000) as shown, p_partkey * 1000 as parsed, p_size::bigint as whole, p_retailprice as real_number, split_part(p_name, ' ', 1) as first_word, p_name like 'cold %' as cold, (p_size % 2 = 0) as balanced from part""")
def string_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<"), F.col("p_type"), F.lit(' & "'), F.col("p_name"), F.lit('">'))
    shown = text.with_thousands(F.col("p_partkey") * 1000)
    bracketed = F.concat(F.lit("(["), "p_name", F.when(F.col("p_size") % 2 == 0, "])").otherwise(")]"))
    return parquet_table(spark, sf_dir, "part").select(
        "p_partkey", F.replace(F.replace(raw, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("half_escaped"), text.html_escape(raw).alias("escaped"), shown.alias("shown"), text.number_with_commas(shown).alias("parsed"),
        text.leading_int(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("px"))).alias("whole"), text.leading_float(F.concat(F.col("p_retailprice").cast("string"), F.lit("x"))).alias("real_number"),
        text.first_word(F.col("p_name")).alias("first_word"), text.is_true((text.first_word(F.col("p_name")) == "cold").cast("string")).alias("cold"), text.balanced(bracketed).alias("balanced"),
    )


@query("""select event_id, case when user_id > 0 then round(100.0 * event_id / user_id) else 0 end::double as share_or_zero, round((1 - value / 500.0) * 100, 6)::double as remaining, floor(value)::bigint as whole, round(value)::bigint as nearest, (event_id & 6 | 1)::bigint as bits,
    xor(event_id, 5)::bigint as flipped, round(ln(value + 1), 6) as logarithm, round(sqrt(value), 6) as root, round(sin(value), 6) as sine, case event_type when 'click' then 'c' when 'view' then 'v' else '?' end as short, ts + interval 90 minute as later from events""")
def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return parquet_table(spark, sf_dir, "events").select(
        "event_id", numbers.saved_share_or_zero(F.col("event_id"), F.col("user_id")).alias("share_or_zero"), numbers.remaining_share(value, F.lit(500.0), 6).alias("remaining"), F.floor(value).cast("bigint").alias("whole"), F.round(value).cast("bigint").alias("nearest"),
        F.col("event_id").bitwiseAND(6).bitwiseOR(1).alias("bits"), F.col("event_id").bitwiseXOR(5).alias("flipped"), F.round(F.ln(value + 1), 6).alias("logarithm"), F.round(F.sqrt(value), 6).alias("root"), F.round(F.sin(value), 6).alias("sine"),
        numbers.lookup({"click": "c", "view": "v"}, F.col("event_type"), "?").alias("short"), (F.col("ts") + F.expr("interval 90 minutes")).alias("later"),
    )


DIFF_SQL = "select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'add' when 'R' then 'del' else 'neutral' end as kind, l_linestatus || l_linenumber as line from lineitem"


@query(f"select l_orderkey, l_linenumber, case kind when 'add' then '+ ' when 'del' then '- ' else '  ' end || line as unified, case when kind = 'add' then '' else line end as old_side, case when kind = 'del' then '' else line end as new_side, concat_ws(chr(10), 'head', case when kind <> 'neutral' then line end, 'foot') as parts from ({DIFF_SQL})")
def diff_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "R", "del").otherwise("neutral")
    lines = parquet_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("line"))
    return lines.select(
        "l_orderkey", "l_linenumber", text.diff_line(F.col("kind"), F.col("line")).alias("unified"), text.split_line(F.col("kind"), F.col("line"), "old").alias("old_side"), text.split_line(F.col("kind"), F.col("line"), "new").alias("new_side"),
        F.concat_ws("\n", F.lit("head"), F.when(F.col("kind") != "neutral", F.col("line")), F.lit("foot")).alias("parts"),
    )


# Joins, grouping and windows that Spark has built in.


@query("""select 'right' as kind, count(*) as n, count(c_custkey) as matched from (select c_custkey from customer where c_acctbal > 9000) c right join orders on c_custkey = o_custkey
    union all select 'cross', count(*), count(*) from region, nation union all select 'natural', count(*), count(*) from (select n_nationkey as k, n_name from nation) natural join (select s_nationkey as k, s_suppkey from supplier)
    union all select 'lateral', count(*), count(n) from region, lateral (select max(n_nationkey) as n from nation where n_regionkey = r_regionkey)""")
def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, region, nation, supplier = (parquet_table(spark, sf_dir, t) for t in ("customer", "orders", "region", "nation", "supplier"))
    figures = lambda df, kind, matched: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count(matched).alias("matched"))
    right = customer.where("c_acctbal > 9000").join(orders, F.col("c_custkey") == F.col("o_custkey"), "right")
    lateral = spark.sql("select r_regionkey, n from {region}, lateral (select max(n_nationkey) as n from {nation} where n_regionkey = r_regionkey)", region=region, nation=nation)
    cross = region.join(F.broadcast(nation.select("n_nationkey")))  # both are fixed lists of the schema
    natural = nation.select(F.col("n_nationkey").alias("k"), "n_name").join(supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k")
    return figures(right, "right", "c_custkey").unionByName(figures(cross, "cross", F.lit(1))).unionByName(figures(natural, "natural", F.lit(1))).unionByName(figures(lateral, "lateral", "n"))


@query("select hint, n, total from (select count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey), (values ('broadcast'), ('merge'), ('shuffle_hash')) h(hint)")
def hinted_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join by each physical strategy that a hint can ask for."""
    orders, customer = parquet_table(spark, sf_dir, "orders"), parquet_table(spark, sf_dir, "customer")
    one = lambda hint: orders.join(customer.hint(hint), F.col("o_custkey") == F.col("c_custkey")).agg(F.lit(hint).alias("hint"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return one("broadcast").unionByName(one("merge")).unionByName(one("shuffle_hash"))


@query("""select c_mktsegment, c_nationkey, count(*) as n, cast(grouping(c_mktsegment, c_nationkey) as bigint) as level, true as close, list_sort(list(distinct (c_custkey % 3)::bigint)) as thirds from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets, collected sets, and whether the approximate distinct count is within a tenth of the exact one."""
    sets = parquet_table(spark, sf_dir, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey")
    near = F.abs(F.approx_count_distinct("c_custkey", 0.02) - F.count_distinct("c_custkey")) <= 1 + 0.1 * F.count_distinct("c_custkey")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"), near.alias("close"), F.array_sort(F.collect_set(F.col("c_custkey") % 3)).alias("thirds"))


@query("select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 86400 preceding and current row) as day_count, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as smoothed from events")
def range_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.date_trunc("SECOND", F.col("ts") + F.expr("interval 500 milliseconds")).cast("timestamp"))
    day = W.partitionBy("user_id").orderBy(seconds).rangeBetween(-86400, W.currentRow)
    near = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return parquet_table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(day).alias("day_count"), F.round(F.avg("value").over(near), 6).alias("smoothed"))
