from __future__ import annotations

import corpus_pipeline


def test_stages_keep_the_columns_and_only_drop_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r["doc_id"]: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        assert all(r == whole[r["doc_id"]] for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == pieces.count()


def test_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
