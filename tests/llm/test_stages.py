"""Decisions of the stages held against plain versions, and rows that are null, repeated or oddly named."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import langid, quality, shared

ODD_NAMES = ("_langid", "_quality", "_kept_id", "_kept_row", "row", "p", "q", "id", "words", "kept", "at", "key", "rejected")


@pytest.fixture(scope="module")
def more(spark, sf_dir):
    """A thousand documents of four languages."""
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")


def plain_language(model, text):
    """(language or None, cosine) by one text's own vector, without batches."""
    counts, letters = langid.ngram_counts(text)
    if not letters:
        return None, 0.0
    vector = counts * model.idf
    near = [float(vector @ c / np.linalg.norm(vector)) for c in model.centroids.astype(float)]
    best = int(np.argmax(near))
    return (model.languages[best], near[best]) if near[best] >= model.floors[best, min(int(np.log2(letters)), langid.LENGTHS - 1)] else (None, near[best])


def test_language_stage_against_single_vectors(spark, more, sf_dir):
    model = langid.train(more)
    want = {r["doc_id"] for r in more.collect() if plain_language(model, r["text"])[0]}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, more, sf_dir).collect()} == want
    assert len(want) >= 0.98 * more.count()


def test_an_unlearned_language_is_rejected_and_learned_ones_stay(more):
    rows = more.where("lang is not null and length(text) > 200")
    for unlearned, least in (("es", 0.6), ("fr", 0.4)):
        model = langid.train(rows.where(F.col("lang") != unlearned))
        found = rows.select("lang", langid.predicted(model, F.col("text")).alias("p")).select("lang", "p.rejected").collect()
        share = lambda other: np.mean([r["rejected"] for r in found if (r["lang"] == unlearned) == other])
        assert share(True) >= least and share(False) <= 0.02


def test_signs_beyond_the_basic_plane_are_no_letters(spark):
    texts = {"😀😀": 0, "🇩🇪": 0, "2024 😀 — !": 0, "𝒜": 1, "𐐀b": 2, "日本": 2}
    assert {t: langid.ngram_counts(t)[1] for t in texts} == texts


def test_samples_stay_bounded_without_ids(spark, more, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 6)
    monkeypatch.setattr(quality, "SAMPLE", 6)
    docs = more.withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    model = langid.train(docs)
    assert set(model.languages) == {r["lang"] for r in more.select("lang").distinct().collect()} and len(model.languages) <= 4 * langid.CLUSTERS
    assert quality.train(docs).weights.any()


def test_columns_of_any_name_stay(odd_docs):
    docs = odd_docs.withColumns({c: F.lit(f"own {c}") for c in ODD_NAMES})
    for keep in (langid.keep_known, quality.keep_good):
        kept = keep(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in ODD_NAMES)


def test_quality_stage_against_the_scorer_and_the_labels(spark, more, sf_dir):
    model = quality.train(more)
    score = lambda t: float(1 / (1 + np.exp(-(quality.hashed(t).astype(float) @ model.weights + model.bias))))
    want = {r["doc_id"] for r in more.collect() if (r["text"] or "").split() and score(r["text"]) >= quality.THRESHOLD}
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, more, sf_dir).collect()}
    assert kept == want
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()
    good, bad = ([r["doc_id"] in kept for r in labels if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.3


def test_one_sided_votes_keep_their_side(spark):
    clean = spark.createDataFrame([(i, f"a plain sentence of words, number {i}, that says nothing odd at all") for i in range(30)], "doc_id long, text string")
    assert {r["keep"] for r in quality.classify(clean).collect()} == {True}
    empty = clean.withColumn("text", F.lit(" "))
    assert {(r["quality_score"], r["keep"]) for r in quality.classify(empty).collect()} == {(0.0, False)}


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *a: None)
    context = lambda master: SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared.shared_folder(SimpleNamespace(conf=conf, sparkContext=context("spark://host:7077")))
    with pytest.raises(ValueError):
        shared.shared_folder(SimpleNamespace(conf=conf, sparkContext=context("local-cluster[2,1,1024]")))


def test_stages_of_null_repeated_and_clashing_rows(spark, sf_dir, odd_docs):
    docs = odd_docs.select(*(c for c in odd_docs.columns if c != "bit"), F.lit("x").alias("row"), F.lit(1).alias("score"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
    kept = [r["doc_id"] for r in docs.collect()]
    assert 4 in kept and 5 not in kept and len([i for i in kept if i is not None]) == len({i for i in kept if i is not None})
    assert corpus_pipeline.packed(spark, docs, sf_dir).count() >= len(kept)
