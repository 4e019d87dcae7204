import re
from collections import defaultdict

import corpus_pipeline as cp
from foliospark.llm.secrets import BASE_RULES, MORE_RULES
from tests.llm.test_ngram_join import brute


def brute_stages(docs):
    """Ids and texts after each of the first four stages."""
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    yield docs
    by_text = defaultdict(list)
    for d, t in docs.items():
        by_text[t].append(d)
    docs = {max(own): t for t, own in by_text.items()}
    yield docs
    groups = brute(sorted(docs.items()), 5, 80)
    docs = {d: t for d, t in docs.items() if groups[d][1] == d}
    yield docs
    out = {}
    for d, t in docs.items():
        spans = sorted((m.start(), m.end()) for r in BASE_RULES + MORE_RULES for m in re.finditer(r.regex, t) if len(m.group(r.group)) >= r.least)
        text, at = "", 0
        for start, end in spans:
            if start >= at:
                text += t[at:start] + cp.MASK
            at = max(at, end)
        out[d] = text + t[at:]
    yield out


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = [(10**6, None), (10**6 + 1, " 12 "), (10**6 + 2, texts[0]), (10**6 + 3, texts[1] + " token=abcdefgh")]
    docs = docs.unionByName(spark.createDataFrame([(d, t, None, None, None) for d, t in extra], docs.schema))
    texts |= dict(extra)
    columns = docs.columns
    for (name, stage), want in zip(cp.STAGES, brute_stages(texts)):
        docs = cp.written(stage(spark, docs, data))
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    packed = cp.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_stages_with_nulls_repeats_and_no_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    rows = [(1, "one two three four five six", "en", "s", 3, 1)] * 3 + [(None, "one two three four five six", None, None, None, 2), (None, "q", "en", None, None, 3), (2, "q", None, None, None, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[:4]:
        docs = cp.written(stage(spark, docs, data))
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2]
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0


def test_run(spark, data):
    assert cp.run(spark, data).count() > 0 and cp.ORACLE_SQL is None


def test_language_stage_keeps_documents_without_labels(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["one two", None, "12 !!", "", "漢字", "three"]
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang, None, None) for i, t in enumerate(texts)], schema)
        assert sorted(r.doc_id for r in cp.language_stage(spark, docs, data).collect()) == [0, 4, 5]
    docs = spark.createDataFrame([(0, "one two", None, None, None), (1, None, "en", None, None), (None, "x", None, None, None)], schema)
    assert sorted(r.text for r in cp.language_stage(spark, docs, data).collect()) == ["one two", "x"]
    rows = [(i, f"text number {i} " + "abcdefghij"[i] * 30, None, None, None) for i in range(10)]
    spark_docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES:
        spark_docs = cp.written(stage(spark, spark_docs, data))
    assert {r.doc_id for r in spark_docs.collect()} == set(range(10))


def test_stages_with_clashing_columns_and_maps(spark, data):
    extra = "score double, lang_pred string, masked_text string, _spans int, row int, found int, kinds string, key long, copy int, kept_key long, component long, node long, size int, m map<string,int>, start long, sequence_id long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    tail = (0.5, "zz", "masked", 7, 1, 2, "k", 3, 4, 5, 6, 7, 8, {"a": 1}, 9, 10)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([long, long, long + " x", "other text", "token=abcdefgh rest", "12"])]
    docs = spark.createDataFrame([(*r, *tail) for r in [*rows, rows[3]]], schema)
    for name, stage in cp.STAGES[:4]:
        docs = cp.written(stage(spark, docs, data))
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString(), name
        assert all(tuple(r)[5:] == tail for r in docs.collect()), name
    assert {r.doc_id: r.text for r in docs.collect()} == {1: long, 3: "other text", 4: f"{cp.MASK} rest"}
    assert docs.count() == 3 and docs.where("doc_id = 4").first().n_chars == len(f"{cp.MASK} rest")
    assert {r.doc_id for r in cp.STAGES[-1][1](spark, docs, data).collect()} == {1, 3, 4}
