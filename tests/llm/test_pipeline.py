"""Each stage, and all of them, against plain Python over the same rows."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tidemark.llm.langid import identify
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.quality import judge_quality

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    ids = lambda df: {r.doc_id for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["language_id"](spark, docs, SF)) == ids(identify(docs).where("lang_pred <> 'und' and score >= 0.5"))
    assert ids(stages["quality_rules"](spark, docs, SF)) == ids(judge_quality(docs).where("kept"))
    classes = {r.class_id for r in near_duplicates(docs).collect()}
    assert ids(stages["minhash_near_dedup"](spark, docs, SF)) == classes
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = ids(stages["benchmark_decontamination"](spark, docs, SF))
    assert clean == {i for i, t in texts.items() if not any(x in t for x in items)}
    docs.unpersist()


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    found = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == want and 100 < len(want) < 200


def test_odd_rows(spark, docs, odd_rows):
    df = docs([(i, t, "en") for i, t in odd_rows])
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, df, SF)
        assert found.count() <= len(odd_rows) and stage(spark, df.limit(0), SF).count() == 0, name
    kept = {str(r.doc_id) for r in corpus_pipeline.decontaminate(spark, df, SF).collect()}
    assert kept == {str(i) for i, _ in odd_rows}


def test_repeated_and_null_ids_are_judged_by_row(spark, docs):
    good = " ".join("".join(chr(97 + (7 * i + 3 * k) % 26) for k in range(3 + i % 7)) for i in range(80))
    df = docs([(1, good, "en"), (1, "bad", "en"), (None, good + " more", "en"), (None, "worse", "en"), (1, good, "en")])
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality(spark, df, SF), SF)
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(1, good)]


def test_text_of_three_languages_stays(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [tuple(r) for r in table if r.lang in ("en", "fr", "de")]
    parts = [max((t for _, t, x in train if x == lang), key=len)[:3000] for lang in ("en", "fr", "de")]
    df = docs([*train, (10**9, " ".join(parts), None), (10**9 + 1, "Привет мир это текст", None)])
    judged = {r.doc_id: r for r in identify(df).where(f"doc_id >= {10**9}").collect()}
    assert judged[10**9].score < 0.5 and judged[10**9].n_spans >= 3
    assert [r.doc_id for r in corpus_pipeline.language(spark, df, SF).where(f"doc_id >= {10**9}").collect()] == [10**9]


def test_a_stage_does_not_keep_what_another_stage_loaded():
    from tidemark.llm import common

    made = []
    make = lambda key: made.append(key) or [key]
    assert common.held("one", "a", make) is common.held("one", "a", make) and common.held("one", "b", make) == ["b"]
    common.let_go("one")
    assert common.held("one", "a", make) == ["a"] and made == ["a", "b"]
    common.let_go("two")
    assert not [k for k in common._HELD if k[0] == "one"] and common.held("one", "a", make) == ["a"] and made == ["a", "b", "a"]


def test_language_reads_the_text_that_goes_along_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    sent = next(line for line in plan.splitlines() if "Project" in line and "_kept_row" in line and " AS id" in line)
    assert " AS text" not in sent and kept.columns == docs.columns
