from __future__ import annotations

import math
import random

import pytest
from test_models import lcs

from ledgerlake.llm import decontaminate


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def accepted(item, answer, words, width):
    """Whether any passage of ``width`` words passes the check, by plain common subsequences."""
    for at in range(max(1, len(words) - width + 1)):
        part = words[at : at + width]
        share = lcs(item, part) / len(item)
        if share >= decontaminate.SIMILARITY or share >= decontaminate.PARAPHRASE and lcs(answer, part) / len(answer) >= decontaminate.ANSWER:
            return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_every_passage_that_exhaustive_comparison_accepts_is_found(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [vocabulary[int(400 * rnd.random() ** 2.5)] for _ in range(n)]  # noqa: E731  few words are frequent
    items, docs = [], []
    for i in range(12):
        words = draw(rnd.choice((1, 2, 5, 9, 17, 30)))
        items.append((i, " ".join(words[: len(words) // 2]) + ". " * (len(words) > 1) + " ".join(words[len(words) // 2 :])))
    for d in range(60):
        copy = items[rnd.randrange(len(items))][1].replace(".", "").split()
        for at in rnd.sample(range(len(copy)), int(len(copy) * rnd.choice((0, 0.1, 0.2, 0.3, 0.4, 0.45)))):
            copy[at] = rnd.choice(vocabulary)
        for _ in range(rnd.randrange(1 + len(copy) // 3)):
            copy.insert(rnd.randrange(len(copy)), rnd.choice(vocabulary))
        around = draw(rnd.randrange(60))
        docs.append((d, " ".join(around + copy + draw(rnd.randrange(40)))))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*tables(spark, docs, items)).collect()}
    must, may = set(), set()
    for i, text in items:
        item, answer = text.replace(".", "").split(), text.split(". ")[-1].split()
        for d, doc in docs:
            words = doc.split()
            if accepted(item, answer, words, math.floor(decontaminate.SPREAD * len(item))):
                must.add((d, i))
            if accepted(item, answer, words, math.ceil(decontaminate.SPREAD * len(item)) + 2 * decontaminate.STRIDE):
                may.add((d, i))
    assert len(must) > 20 and must <= found <= may


def test_paraphrases_among_benchmark_words_against_common_subsequences(spark):
    rnd = random.Random(11)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(1500)]
    items = [" ".join(rnd.choice(rare if rnd.random() < 0.25 else common) for _ in range(rnd.randint(6, 13))) for _ in range(400)]
    docs, want = [], set()
    for i in range(200):
        copy = items[i].split()
        for at in rnd.sample(range(len(copy)), len(copy) // 5):
            copy[at] = rnd.choice(rare)
        around = [rnd.choice(rare if rnd.random() < 0.5 else common) for _ in range(200)]
        docs.append((i, " ".join(around[:100] + copy + around[100:])))
        if lcs(items[i].split(), copy) >= 0.8 * len(items[i].split()):
            want.add((i, i))
    found = decontaminate.contaminated(*tables(spark, docs, list(enumerate(items))))
    assert len(want) > 150 and want - {(r["doc_id"], r["item_id"]) for r in found.collect()} == set()


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = "many people walk along the river bank and talk about the weather of the day"
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, "nothing of it"), (1, item), (1, "clean row of the same id"), (2, None)], "doc_id long, text string").selectExpr("*", "1L as key", "'w' as words")
    bench = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    kept = decontaminate.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == [("1", "clean row of the same id"), ("None", "nothing of it")]
    assert kept.count() == 3
    assert decontaminate.contaminated(docs, bench).count() == 4


def test_the_latent_search_nominates_and_anchors_lose_nothing(spark, sf_dir):
    import numpy as np

    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 50, 64).astype(np.int32)
    items = decontaminate.Items(np.arange(50, dtype=np.uint64), [7], [words[10:30]], [words[25:30]])
    anchors = decontaminate.choose_anchors(items, np.bincount(words, minlength=50))
    blocks, found = decontaminate.anchored(words, np.arange(64), anchors)
    assert (1 in blocks.tolist()) and set(found.tolist()) == {0}
