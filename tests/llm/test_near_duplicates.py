from __future__ import annotations

import random

import xxhash

from ledgerlake.llm import simhash
from ledgerlake.llm.graph import components


def brute_print(text, shingle=4):
    words, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in "\x20\t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = {d: (f"{prints[d]:016x}", r) for d, r in roots(prints, links).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_every_pair_within_four_bits_is_linked(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(6)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = simhash.linked_classes(spark.createDataFrame(signed, "doc_id long, fp long"))
    got = {r["fp"]: r["component_id"] for r in found.collect()}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = roots(range(len(prints)), links)
    assert {i: got[p] for i, p in signed} == want


def test_odd_rows(odd_docs, no_docs):
    found = sorted(simhash.near_duplicates(odd_docs).collect(), key=str)
    assert len(found) == 12
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[5][1] == 4
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 5 not in ids and None in ids and len(ids) == len(set(ids))


def test_components_of_a_long_path(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b").unionAll(spark.sql("select 500L, 501L")).unionAll(spark.sql("select 7L, 7L"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
