"""Queries over the driver's tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extract_texts

    return extract_texts(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


#: The rules that the contract of op6 fixes: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_rules import judge_urls

    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"select * from values {values} as rules(host, path, verdict)"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.shards import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 16)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document id, null for all rows without one, whose texts hold benchmark items: how many distinct ids of items, of which null is none, and these."""
    from pyspark.sql import functions as F

    from tidemark.llm.decontam import contaminated

    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), F.countDistinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.prefix_trie import ordered_steps, prefix_nodes, with_lent_heads

    return prefix_nodes(with_lent_heads(ordered_steps(table(spark, sf_dir, "conversations")))).select(*TRIE)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conv_repair import damaged, repair_reports

    turns = table(spark, sf_dir, "conversations")
    return repair_reports(damaged(turns), turns.select("conv_id"))


def op13_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.shingle_join import shingle_classes

    return shingle_classes(table(spark, sf_dir, "documents"))


OPERATORS = (op1_language_id, op2_lm_scoring, op3_quality_rules, op4_html_extraction, op5_token_counts, op6_url_filters, op7_sentencepiece, op8_sharding, op9_minhash_near_dedup, op10_decontamination, op11_prefix_trie, op12_conversation_repair, op13_shingle_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text: each byte goes into the low bits, then eight steps of the polynomial."""
    steps = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)), lambda c, b: {steps}), 4294967295::bigint)"


TRIE_SQL = f"""
    with steps as (
        select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, dig) as pos, dig, chars
        from (select conv_id, turn, role, left(sha256(length(role) || ':' || role || text), 32) as dig, length(text) as chars
            from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null))),
    convs as (select conv_id, {crc32_sql("conv_id::varchar")} % 6 as h, conv_id - conv_id % 100 as lender from (select distinct conv_id from steps)),
    rebuilt as (
        select conv_id, row_number() over (partition by conv_id order by part, pos) as d, dig, chars from (
            select c.conv_id, 0 as part, pos, dig, chars from convs c join steps s on s.conv_id = c.lender and pos <= h
            union all select c.conv_id, 1, pos, dig, chars from convs c join steps s on s.conv_id = c.conv_id and pos > h)),
    paths as (
        select conv_id, 0 as d, '' as key, 0 as chars from convs
        union all select conv_id, d, sha256(string_agg(dig, '') over (partition by conv_id order by d rows unbounded preceding)), chars from rebuilt),
    linked as (select *, lag(key) over w as parent_key, lead(key) over w is null as ends from paths window w as (partition by conv_id order by d)),
    nodes as (select key, min(conv_id) as conv_id, min(d) as depth, min(chars) as chars, min(parent_key) as parent_key, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from linked group by key),
    kids as (select parent_key as key, count(*) as n from nodes group by 1),
    valued as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (key)),
    sums as (select p.key, sum((v.n_children = 0)::int) as n_leaves, sum((v.n_convs - 1) * v.chars) as saved from valued v join paths p on p.conv_id = v.conv_id and p.d <= v.depth group by 1)
    select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, v.ends_sha256
    from valued v join sums using (key) left join nodes p on p.key = v.parent_key"""


def _repair_ways() -> str:
    """Rows of SQL: state before and after, macro edit, its cost, letter of a role that it is for (null: any), whether the turn stays, lines before the turn's, its new role (null: its own)."""
    after_user, after_answer = {"u": 2}, {"a": 3}
    next_of = {0: {"s": 1} | after_user, 1: after_user, 2: after_answer, 3: after_user}  # 0 nothing, 1 system, 2 user, 3 answer
    name = {"u": "user", "a": "assistant"}
    ways = []
    for state in next_of:
        now, lines = state, ""
        for run in range(3):
            ways.append((state, now, "I" * run + "D", 2 * run + 3, None, False, lines, None))
            ways += [(state, to, "I" * run + "K", 2 * run, letter, True, lines, None) for letter, to in next_of[now].items()]
            ways += [(state, to, "I" * run + "R", 2 * run + 2, None, True, lines, name[letter]) for letter, to in next_of[now].items() if letter != "s"]
            letter = "a" if now == 2 else "u"
            now, lines = next_of[now][letter], lines + f"chr(10) || '{name[letter]}:' || "
    null = lambda x: "null" if x is None else f"'{x}'"
    return ", ".join(f"({a}, {b}, '{code}', {cost}, {null(letter)}, {stays}, {lines}'', {null(role)})" for a, b, code, cost, letter, stays, lines, role in ways)


REPAIR_SQL = f"""
    with recursive raw as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
    hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
            unnest(range(case when kind = 3 then 2 else 1 end)) as copy from raw where kind <> 0),
    numbered as (select *, row_number() over w as n, lag(role) over w as before, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again
        from hurt window w as (partition by conv_id order by turn nulls first, role, text, copy)),
    faulty as (select *, left(role, 1) as letter, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut from numbered),
    ways(st, nxt, code, price, who, stays, lines, new_role) as (values {_repair_ways()}),
    best as (
        select conv_id, 0 as n, 0 as st, {{'cost': 0, 'audit': '', 'said': ''}} as b from (select distinct conv_id from conversations)
        union all
        select b.conv_id, b.n + 1, w.nxt, min({{'cost': b.b.cost + w.price + (w.stays and f.cut)::int, 'audit': b.b.audit || w.code, 'said': b.b.said || w.lines || case when w.stays then chr(10) || coalesce(w.new_role, f.role) || ':' || f.text else '' end}})
        from best b join faulty f on f.conv_id is not distinct from b.conv_id and f.n = b.n + 1 join ways w on w.st = b.st and (w.who is null or w.who = f.letter) and not (w.stays and (f.blank or f.again))
        group by 1, 2, 3),
    counts as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
            count(*) filter (cut and not again and not blank) as truncated, count(*) filter (before is not null and left(before, 1) || letter not in ('su', 'ua', 'au')) as illegal, count(*) as rows from faulty group by 1),
    ends(st, run, price, lines) as (values (0, '', 0, ''), (3, '', 0, ''), (2, 'I', 2, chr(10) || 'assistant:'), (1, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
    done as (select b.conv_id, min({{'cost': b.b.cost + e.price, 'audit': b.b.audit || e.run, 'said': b.b.said || e.lines}}) as b from best b join ends e using (st) left join counts c on c.conv_id is not distinct from b.conv_id where b.n = coalesce(c.rows, 0) group by 1)
    select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
        d.b.cost::bigint as cost, d.b.audit as audit, sha256(substr(d.b.said, 2)) as repaired_sha256
    from done d left join counts c on c.conv_id is not distinct from d.conv_id"""


JOIN_SQL = """
    with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
    items as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
    links as (select a.doc_id as a, b.doc_id as b from items a join items b on a.shingle = b.shingle and a.doc_id <> b.doc_id and 100 * b.n >= 80 * a.n and 100 * a.n >= 80 * b.n
        group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on r.other = l.a)
    select doc_id, any_value(len(s))::bigint as n_shingles, min(other) as component_id from sets join reach using (doc_id) group by 1"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op6_url_filters": f"""
            with rules(rule_host, rule_path, rule_verdict) as (values {values}),
            parts as (
                select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
                from pages
            )
            select page_id, host, path, rule_host || rule_path as rule, coalesce(rule_verdict, 'allow') as verdict
            from parts left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            qualify row_number() over (partition by page_id order by length(rule_host || rule_path) desc) = 1""",
        "op11_prefix_trie": TRIE_SQL,
        "op12_conversation_repair": REPAIR_SQL,
        "op13_shingle_join": JOIN_SQL,
    }
