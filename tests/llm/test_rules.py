from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def plain_posterior(model, votes):
    odds = [1 - model.prior, model.prior]
    for rule, vote in enumerate(map(int, votes)):
        odds = [o * model.rates[rule, vote, c] for c, o in enumerate(odds)]
    return odds[1] / sum(odds)


def test_counts_of_made_texts():
    rnd = random.Random(6)
    signs = ["a", "b", "é", "😀", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "#", "|", "ab", "\r\n"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs[: rnd.randint(2, len(signs))]) for _ in range(rnd.randint(0, 60)))
        assert rules.measured(text)[0] == plain_counts(text), repr(text)
    long = "one two three four " * 30_000
    assert rules.measured(long)[0] == plain_counts(long)


def test_accuracies_are_recovered():
    rnd = np.random.default_rng(5)
    good = rnd.random(40_000) < 0.8
    right, says = np.array([0.95, 0.9, 0.85, 0.8, 0.75]), np.array([0.9, 0.5, 0.8, 0.6, 0.9])
    votes = np.where(rnd.random((len(good), 5)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rnd.random(votes.shape) >= says] = rules.ABSTAINS
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - right).max() < 0.02 and abs(model.prior - 0.8) < 0.02
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95


def test_a_rule_isnt_believed_worse_than_chance_and_no_votes_leave_even_odds():
    votes = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 1]])
    model = rules.fit(votes, np.array([500.0, 300, 40, 30]))
    assert (model.rates[:, 0, 0] >= model.rates[:, 0, 1] - 1e-12).all()
    empty = rules.fit(np.zeros((0, 3), dtype=int), np.zeros(0))
    assert empty.prior == 0.5 and (empty.posterior(votes) == 0.5).all()


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_verdicts_against_plain_versions_and_labels(spark, sf_dir, scale):
    folder = sf_dir.replace("sf0.001", scale)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found.keys() == texts.keys()
    patterns = Counter(rules.measured(t)[1] for t in texts.values() if (t or "").split())
    model = rules.fit(np.array([list(map(int, p)) for p in sorted(patterns)]), np.array([patterns[p] for p in sorted(patterns)], dtype=float))
    for doc, r in found.items():
        counts = plain_counts(texts[doc])
        assert tuple(r)[1:6] == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and plain_posterior(model, r["votes"]) >= 0.5)
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, bad = ([found[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    assert all(r["kept"] or r["base_failed"] for r in good) and np.mean([r["kept"] for r in bad]) <= 0.05


def test_odd_and_no_rows(odd_docs, no_docs):
    rows = rules.judged(odd_docs).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r["doc_id"] or 0 for r in odd_docs.collect())
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:6]) for r in rows) == sorted((i or 0, *plain_counts(t)) for i, t in texts)
    assert all(not r["kept"] and r["quality_probability"] == 0 for r in rows if r["n_words"] == 0)
    assert rules.judged(no_docs).collect() == [] and rules.keep_passing(no_docs).columns == no_docs.columns


def test_kept_rows_are_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"row": F.lit(1), "votes": F.lit("x"), "kept": F.lit(2)})
    kept = {r["doc_id"] for r in rules.judged(docs).where("kept").collect()}
    got = rules.keep_passing(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.where("`row` = 1 AND votes = 'x' AND kept = 2").collect()} == kept
