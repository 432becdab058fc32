import os

import pytest

import corpus_pipeline
from larder.llm import lines, quality, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == docs.columns, name
        assert {"doc_id", "ids"} <= set(corpus_pipeline.STAGES[-1][1](spark, now, "").columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = quality.filter_documents(docs)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.query(docs).where("kept").collect()}
    thin = lines.drop_repeated_lines(good)
    kept = {r.doc_id: [x for i, x in enumerate(r.text.split("\n")) if i in set(r._lines)] for r in lines.mark_lines(good).collect()}
    assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in thin.collect()} == {d: x for d, x in kept.items() if x}
    one = simhash.keep_one(thin)
    groups = simhash.query(thin).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in groups})
    assert all(r.round_trip for r in corpus_pipeline.run(spark, DATA).collect())
