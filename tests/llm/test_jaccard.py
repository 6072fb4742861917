from __future__ import annotations

import random

from test_near_duplicates import roots

from ledgerlake.llm import jaccard, simhash


def brute_sets(texts, shingle=5):
    out = {}
    for doc, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out[doc] = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return out


def kept_by_all_pairs(texts):
    sets = brute_sets(texts)
    near = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    return {d for d, r in roots(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]).items() if d == r}


def test_whole_table_against_all_pairs_of_shingle_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept_by_all_pairs(texts)


def test_copies_near_the_bound_against_all_pairs(spark):
    rnd = random.Random(5)
    texts = {}
    for base in range(30):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice((3, 8, 40, 150)))]
        for copy in range(8):
            changed = words.copy()
            for _ in range(rnd.randrange(1 + len(words) // 25)):
                changed[rnd.randrange(len(changed))] = f"v{rnd.randrange(300)}"
            texts[base * 8 + copy] = " ".join(["all rights are reserved by the owners of this text"] * (base % 2) + changed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept_by_all_pairs(texts)


def test_fingerprints_alone_link_what_they_reach(spark, monkeypatch):
    rnd = random.Random(7)
    texts = {}
    for base in range(20):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice((60, 200, 500)))]
        for copy in range(6):
            changed = words.copy()
            for _ in range(rnd.randrange(1 + len(words) // 60)):
                changed[rnd.randrange(len(changed))] = f"v{rnd.randrange(900)}"
            texts[base * 6 + copy] = " ".join(changed)
    prints = {}
    for doc, found in zip(texts, jaccard.shingle_sets([t.encode() for t in texts.values()], 5)):
        prints[doc] = sum((sum(x >> b & 1 for x in found.tolist()) * 2 > len(found)) << b for b in range(64))
    sets = brute_sets(texts)
    similar = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    reached = [(a, b) for a, b in similar if (prints[a] ^ prints[b]).bit_count() <= 5]
    first = {d for d, r in roots(sets, reached).items() if d == r}
    assert len(first) < len(texts) - 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    with monkeypatch.context() as off:  # no pair by keys of shingles
        whole = jaccard.meeting_pairs
        off.setattr(jaccard, "ROUNDS", ())
        off.setattr(jaccard, "meeting_pairs", lambda *args: whole(*args).where("false"))
        kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept_by_all_pairs(texts) <= kept <= first
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept_by_all_pairs(texts)
