from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import fim


def plain_cut(doc_id, text):
    """A document's row by slices of a decoded text."""
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_offsets_of_every_unit():
    rnd = random.Random(3)
    signs = ["a", "é", "€", "😀", "\n", "́", "日"]
    for text in ["", "plain", "é" * 9, *("".join(rnd.choice(signs[: rnd.randint(1, 7)]) for _ in range(rnd.randint(1, 40))) for _ in range(300))]:
        runs = fim.encoded(text.encode())
        assert runs.total == len(text) and (runs.widths[1:] != runs.widths[:-1]).all()
        assert [runs.offset(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


@pytest.mark.parametrize("which", ["table", "odd", "signs"])
def test_documents_are_cut_as_slices_are(spark, sf_dir, odd_docs, which):
    rnd = random.Random(4)
    signs = [*"ab é€😀\n<>PSM", "<P>", "<S", "P>"]
    made = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30)))) for i in range(-5, 1500)]
    docs = {"table": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet"), "odd": lambda: odd_docs, "signs": lambda: spark.createDataFrame(made, "doc_id long, text string")}[which]()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted(((r["doc_id"], *plain_cut(r["doc_id"], r["text"])) for r in docs.collect()), key=key)
    cut = fim.fill_in_middle(docs)
    assert sorted((tuple(r) for r in cut.collect()), key=key) == want
    back = cut.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())


def test_marks_that_overlap_are_refused_and_no_rows_give_none(no_docs):
    for marks in (("<a>", "<a>b", "c"), ("ab", "bc", "x"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(no_docs, sentinels=marks)
    assert fim.digests(fim.fill_in_middle(no_docs)).collect() == []


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"text {i} <P> é") for i in range(200)], "doc_id long, text string")
    cut = fim.fill_in_middle(docs, seed="7", sentinels=("[pre]", "[suf]", "[mid]"), cut_share=100, suffix_first_share=50)
    rows = cut.select("form", "output", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("text")).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"}
    assert {r["text"] for r in rows} == {f"text {i} <P> é" for i in range(200)}
