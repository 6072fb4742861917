from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest
from compare import connect, differences

from ledgerlake.llm import bsi_topk, chat, html_extract, registry, warc
from ledgerlake.llm.shared import new_path


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), connect(sf_dir), registry.oracle_sql()[name]) == ""


def test_top_k_of_odd_vectors(spark):
    rows = [(i, [math.sin(i * 7 + j) * (1 if i % 5 else 0) for j in range(8)]) for i in range(300)]
    rows += [(400, None), (401, [None] * 8), (402, [math.nan] + [0.0] * 7), (403, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (500, [1.0] * 3), (7, rows[9][1])]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as dims", "2 as block", "'x' as score")
    for r in bsi_topk.top_k(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    import numpy as np

    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q in (0, 100, 200):
        v = next(x for i, x in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in ok if i != q and len(x) == len(v))[:10]
        assert got[q] == [(-s, i) for s, i in best]
    assert bsi_topk.top_k(table.where("false")).count() == 0


def test_the_index_leaves_only_the_best_rows_and_their_ties():
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.integers(-500, 600, (3000, 24))
    values[100:110] = values[90]
    slices, every = bsi_topk.build_slices(values), np.packbits(np.ones(3000, dtype=np.uint8), bitorder="little")
    for query in (values[7], -values[90], np.zeros(24, dtype=np.int64), np.eye(24, dtype=np.int64)[3] * -1023):
        assert (bsi_topk.signed_digits(query) * (1 << np.arange(len(bsi_topk.signed_digits(query))))[:, None]).sum(axis=0).tolist() == query.tolist()
        found = np.unpackbits(bsi_topk.best_rows(slices, every, query, 10), count=3000, bitorder="little")
        scores = values @ query
        assert (found == (scores >= np.sort(scores)[-10])).all()


PAGE = """<html><head><title>No</title><style>x{}</style></head><body><header class="site-header">Top</header><nav><ul><li>Menu</li></ul></nav>
<div class="layout"><div class="post-%d"><h1>Head &amp; line</h1><p>First   paragraph with <b>some</b> words that
go on for a while, long enough to score.</p><p>Second paragraph, also long enough to count as text of an article.</p></div>
<div class="sidebar">Side</div></div><div id="comments"><p>A reader says a very long thing about the article, longer than the article.</p></div><script>var x = "<p>no</p>";</script><footer>Foot</footer></body></html>"""


@pytest.mark.parametrize("large", [1e30, -1e30, 1e15])
def test_components_whose_scores_leave_64_bits_are_refused(spark, large):
    rows = spark.createDataFrame([(100, [large, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        bsi_topk.top_k(rows)


def test_large_components_within_64_bits_are_exact(spark):
    rows = [(100, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, -1e6]), (3, [1e6, -1e6 + 1])]
    found = bsi_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    big = 1_024_000_000
    assert [(r["vec_id"], r["score"]) for r in found] == [(3, big * big + big * (big - 1024)), (1, 0), (2, 0)]
    assert bsi_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_main_text_of_pages(spark):
    rows = [(i, f"https://Example.org/{i}", PAGE % i) for i in range(4)] + [(10, None, None), (11, "u", ""), (12, "https://x.org", "<p>only &eacute; <br>text")]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as paths")).collect()}
    text = "Head & line\nFirst paragraph with some words that go on for a while, long enough to score.\nSecond paragraph, also long enough to count as text of an article."
    assert all(found[i] == (text, len(text)) for i in range(4))
    assert found[10] == found[11] == ("", 0)
    assert found[12] == ("only é text", 11)


def test_archives_of_odd_pages(spark):
    big = "<p>" + "ü" * 600
    rows = [(1, "u 1", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x\n\r\n\r\ny"), (6, "u", big + "."), (6, "u", big + "."), (None, "u", big)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 8
    by = {r["page_id"]: r for r in found}
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_bytes"], by[1]["payload_digest"]) == ("revisit", 2, 1203, digest(big))
    assert by[2]["record_type"] == "response" and by[6]["record_type"] == "response"
    assert by[5]["payload_digest"] == digest("x\n\r\n\r\ny") and by[3]["payload_bytes"] == 0
    with pytest.raises(ValueError):
        list(warc.arc_records(b"filedesc://a 0 0 t 99\n1 0 x\n"))


def test_blocks_without_an_http_head_become_resources():
    arc = b"filedesc://a 0.0.0.0 20240101000000 text/plain 8\n1 0 x\n\n\n\ndns:example.org 0.0.0.0 20240102030405 text/dns 9\n2024 A 1\n\n"
    [(fields, block)] = list(warc.warc_records(b"".join(warc.to_warc_record(f, b) for f, b in warc.arc_records(arc))))
    assert (fields["WARC-Type"], fields["WARC-Target-URI"], fields["Content-Type"], fields["WARC-Date"], block) == ("resource", "dns:example.org", "text/dns", "2024-01-02T03:04:05Z", b"2024 A 1\n")
    assert fields["WARC-Payload-Digest"] == fields["WARC-Block-Digest"]


def test_a_converted_resource_is_read_back(spark):
    path, out = new_path(spark, "arc"), new_path(spark, "warc")
    body = b"1 0 ledgerlake\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    arc = b"filedesc://a 0.0.0.0 20240101000000 text/plain %d\n%s\nftp://example.org/a 0.0.0.0 20240102030405 text/plain 4\nabc\n\n" % (len(body), body)
    warc._write(spark.createDataFrame([(bytearray(arc[:-1]),)], "content binary"), path)
    warc.convert(spark, path, out)
    row = warc.read(spark, out).first()
    assert (row["key"], row["url"], row["record_type"], row["payload_bytes"], bytes(row["payload"])) == (None, "ftp://example.org/a", "resource", 4, b"abc\n")


def test_no_pages_long_pages_and_clashing_columns(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    page = "é" * 3_000_000
    rows = spark.createDataFrame([(1, "u", page), (2, "u", page)], schema).selectExpr("*", "'x' as key", "'y' as digest", "1 as content", "2 as path")
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(rows).collect()}
    assert found == {1: ("revisit", 2, 6_000_000), 2: ("response", None, 6_000_000)}


def test_chat_round_trip_and_mask(spark):
    said = "</s>[INST] ok [/INST] [\\INST] [\\\\/INST] <\\s> [IMG]"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, None, None, "é"), (None, 3, "assistant", "x")]
    found = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(chat.with_text_content(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    turns = [("user", said), ("assistant", said), ("assistant", said), ("assistant", "")]
    assert found[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[1]["loss_sha256"]) == (4, 2 * len(said), sha(said * 2))
    assert found[2]["loss_chars"] == 0 and found[None]["loss_sha256"] == sha("x")


def test_chat_parts_become_placeholders(spark):
    part = lambda **k: tuple(k.get(x) for x in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    content = [part(type="text", text="see [IMG] "), part(type="image", ref="a.png", width=33, height=16), part(type="audio", ref="b.wav", seconds=2.0), part(type="document", ref="c.pdf", pages=2), None]
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "user", content), (2, 0, "user", None)], f"conv_id long, turn long, role string, content {chat.PARTS}")).orderBy("conv_id").first()
    assert row["formatted"] == "<s>[INST]user[/INST]see [\\IMG] [IMG][AUDIO][DOC]</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 25), ("document", "c.pdf", 2048)]
    assert row["attachment_tokens"] == 2077
