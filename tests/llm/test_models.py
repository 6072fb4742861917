from __future__ import annotations

import random

import pytest

from ledgerlake.llm import decontaminate, langid, quality


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(found) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) >= 0.9


def test_language_of_odd_rows(odd_docs, no_docs):
    found = {r["doc_id"]: r for r in langid.identify(odd_docs).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify(no_docs).count() == 0
    kept = langid.keep_known(odd_docs)
    assert kept.columns == odd_docs.columns and {4, 5, 6, 9} <= {r["doc_id"] for r in kept.collect()}


def test_language_of_unlabelled_rows(odd_docs):
    blank = odd_docs.withColumn("lang", odd_docs["lang"].substr(99, 1)).where("lang is null")
    assert {r["lang_pred"] for r in langid.identify(blank).collect()} == {"und"}


def test_quality_against_labels(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = quality.classify(docs).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    kept = [r["keep"] for r in found if r["quality"] == 1]
    lost = [r["keep"] for r in found if r["quality"] == 0]
    assert sum(kept) / len(kept) > 0.9
    assert sum(lost) / len(lost) < 0.5


def test_quality_of_odd_rows(odd_docs, no_docs):
    found = {r["doc_id"]: r for r in quality.classify(odd_docs).collect()}
    assert not any(found[i]["keep"] for i in (1, 2, 3))
    assert quality.classify(no_docs).count() == 0
    assert quality.keep_good(odd_docs).columns == odd_docs.columns


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(100):
        a, b = ([rnd.randint(-1, 6) for _ in range(rnd.randint(1, 80))] for _ in range(2))
        assert decontaminate.lcs_length(np.array(a), np.array(b)) == lcs(a, b)


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    rnd = random.Random(4)
    filler = lambda n: " ".join(rnd.choice("lorem dolor amet vitae nulla massa felis augue ipsum".split()) for _ in range(n))
    rows, want = [], set()
    for i, text in enumerate(items):
        rows.append((i, f"{filler(50)} {text.upper()} {filler(300)}"))
        words = text.split()
        del words[len(words) // 3 : len(words) // 3 + len(words) // 10]
        rows.append((1000 + i, f"{filler(3)}\n{' '.join(words)}"))
        want |= {i, 1000 + i}
    rows += [(2000 + i, filler(400)) for i in range(20)] + [(3000, None), (3001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_planted_passages_are_found_and_clean_documents_stay(spark, sf_dir, planted):
    docs, want = planted
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.keep_uncontaminated(docs, bench).collect()} == {*range(2000, 2020), 3000, 3001}


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "many people walk along the river bank and talk about the weather"), (3, "many people walk along the river bank and talk about the weather")], "item_id long, text string")
    found = {r["doc_id"] for r in decontaminate.contaminated(odd_docs, bench).collect()}
    assert found == {4, 5, 6, 9, None}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.where("item_id < 3")).count() == 0
