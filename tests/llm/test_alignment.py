from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_characters():
    """The usual table of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def tokens_of(libraries, text):
    """[(id, from byte, to byte)] of either side; none where the tokens don't spell the text."""
    if not text:
        return [], []
    a, b = libraries
    table, said = byte_characters(), b" " + text.encode()
    sides = [[(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], []]
    for i in b.encode(text):
        p = b.id_to_piece(i)
        sides[1].append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != said for side in sides):
        return [], []
    out = []
    for side in sides:
        ends = np.cumsum([len(x) for _, x in side]).tolist()
        out.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
    return out


def plain_alignment(libraries, text):
    a, b = tokens_of(libraries, text)
    shared = sorted({x[2] for x in a} & {x[2] for x in b})
    groups = []
    for i, j in zip([0, *shared], shared):
        groups.append([[x[0] for x in side if i <= x[1] and x[2] <= j] for side in (a, b)])
    links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
    line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return len(a), len(b), len(groups), links, hashlib.sha256(line.encode()).hexdigest() if a else ""


def plain_statistics(libraries, texts):
    rows = [plain_alignment(libraries, t) for t in texts]
    counts = Counter(p for r in rows for p in set(r[3]))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [(n_a, n_b, g, len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), sha) for n_a, n_b, g, links, sha in rows]


def odd_texts():
    rnd = random.Random(8)
    signs = [*"ab1é'.,!&- \n", "  ", "’", "😀", "日本", "word", "tion", "<|endoftext|>", "<s>", "<0x41>", "\t", "▁", " ", "ﬁ"]
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    return [*made, None, "", " ", "\n", " lead", "trail ", "a" * 300, "the quick brown fox " * 40, "naïve café", "</s>"]


def test_bits():
    rnd = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 500):
        places = np.flatnonzero(rnd.random(size) < 0.3)
        bits, other = alignment.Bits.of(places, size), alignment.Bits.of(np.arange(0, size, 3), size)
        assert (bits & other).select().tolist() == [p for p in places.tolist() if p % 3 == 0]
        assert bits.rank(np.arange(size)).tolist() == [int((places < i).sum()) for i in range(size)]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_statistics_against_every_pair_of_tokens(spark, sf_dir, libraries, monkeypatch, which):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 300)
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string") if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(zip(texts, plain_statistics(libraries, texts.values())))
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.link_statistics(docs.repartition(3), *PATHS).collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > len(want) / 3


def test_spans_of_the_alignment(spark, libraries):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in alignment.align(docs, *PATHS).collect():
        a, b = tokens_of(libraries, texts[r["doc_id"]])
        assert (r["a"], r["b"]) == ([x[0] for x in a], [x[0] for x in b])
        links = [(i, j) for i, (f, l) in enumerate(zip(r["first_b"], r["last_b"])) for j in range(f, l + 1)]
        assert links == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        assert [a[n - 1][2] for n in r["a_cuts"]] == [b[n - 1][2] for n in r["b_cuts"]] == sorted({x[2] for x in a} & {x[2] for x in b})


def test_odd_and_no_rows(odd_docs, no_docs, libraries):
    rows = odd_docs.collect()
    want = sorted(zip([r["doc_id"] or 0 for r in rows], plain_statistics(libraries, [r["text"] if r["doc_id"] != 9 else None for r in rows])))
    docs = odd_docs.withColumn("text", F.when(F.col("doc_id").isNull() | (F.col("doc_id") != 9), F.col("text")))  # the plain version is quadratic in a text
    got = sorted((r["doc_id"] or 0, tuple(r)[1:]) for r in alignment.link_statistics(docs, *PATHS).collect())
    assert got == want
    long = alignment.link_statistics(odd_docs.where("doc_id = 9"), *PATHS).first()
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] > 5000
    assert alignment.link_statistics(no_docs, *PATHS).collect() == [] and alignment.align(no_docs, *PATHS).collect() == []
