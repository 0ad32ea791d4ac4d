"""Registered queries against their SQL twins, and the pipeline's stages against brute force."""


import pytest

import corpus_pipeline
from flowlens.llm.queries import QUERIES, SQL
from flowlens.llm.shared import table
from tests import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_twin(spark, small_dir, name):
    assert compare.run_spark(QUERIES[name](spark, small_dir)) == compare.run_twin(compare.connect(small_dir), SQL[name])


@pytest.mark.parametrize("name", ["op10_chat"])
def test_native(spark, small_dir, name):
    plan = QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, small_dir))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS and set(map(tuple, after)) <= set(map(tuple, before))
        if name == "exact_dedup":
            keep = {}
            for r in before:
                keep[r.text or ""] = max(r.doc_id, keep.get(r.text or "", r.doc_id))
            assert sorted(r.doc_id for r in after) == sorted(keep.values())
        if name == "ngram_join":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert len(gone) < len(before) / 2
        if name == "packing":
            assert len(after) == len(before) and len({(r.bucket, r.batch, r.slot) for r in after}) == len(after)
        before = after


def test_stages_with_odd_rows(spark, small_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _key string"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", None, 11), (3, "a b c d e f", None, "s", 11), (None, "q r s t", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, small_dir))
        assert docs.columns == corpus_pipeline.COLUMNS
    kept = corpus_pipeline.exact(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], schema), small_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, ""), (3, "a b c d e f"), (None, "q r s t")], key=repr)
    assert corpus_pipeline.pack(spark, docs, small_dir).count() == docs.count()


def test_stages_with_no_rows(spark, small_dir):
    docs = table(spark, small_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, small_dir))
        assert docs.count() == 0
