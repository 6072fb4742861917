from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from ledgerlake.llm import html_extract

PAGES = "page_id long, url string, html string"
STORY = "The story of this page goes on for a while, with one sentence after another about what happened. "
OTHER = "Another box tells what else there is to be read here, and what it would be like to read all of it. "


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}


class Plain(HTMLParser):
    """The blocks of a page's <article>, without its skipped parts: another parser's answer for pages of that kind."""

    BLOCKS = set("article p h1 h2 h3 ul ol li div table tr td blockquote figure figcaption section pre".split())
    SKIPPED = set("script style nav aside form footer".split())

    def __init__(self):
        super().__init__()
        self.depth, self.off, self.parts, self.blocks = 0, 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if self.depth and tag in self.SKIPPED:
            self.off += 1
        if self.depth and tag in self.BLOCKS:
            self.flush()
        if self.depth and tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.depth and tag in self.BLOCKS:
            self.flush()
        if self.off and tag in self.SKIPPED:
            self.off -= 1
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.off:
            self.parts.append(data)


def test_every_page_against_another_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        plain.close()
        plain.flush()
        want[r["page_id"]] = "\n".join(plain.blocks)
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want


def host(n_pages):
    links = f"<div class='more'>{f'<p><a href=x>{OTHER}</a></p>' * 3}</div>"
    usual = lambda i: f"<body><div class='story-{i}'><h1>Head {i}</h1><p>{STORY * 5}</p></div>{links}<div class='box'><p>{OTHER}</p></div></body>"
    odd = f"<body><div class='story-99'><p>{STORY.strip()}</p></div>{links}<div class='box'><p>{OTHER * 6}</p></div></body>"
    return [*((i, f"https://a.org/{i}", usual(i)) for i in range(n_pages)), (90, "https://A.org/odd", odd), (91, "https://b.org/odd", odd)]


@pytest.mark.parametrize("limit", [html_extract.BROADCAST_BYTES, -1])
def test_a_page_follows_its_host_against_its_own_best(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit)
    found = extracted(spark, host(6))
    assert found[90] == STORY.strip()
    assert found[91] == (OTHER * 6).strip()
    assert all(found[i] == f"Head {i}\n{(STORY * 5).strip()}" for i in range(6))


def test_repeated_rows_very_long_pages_and_none(spark):
    long = f"<article>{f'<p>{STORY}</p>' * 20_000}</article>"
    rows = [(1, "u", long), (2, "u", "<article><p>x</p></article>"), (2, "u", "<article><p>x</p></article>"), (None, None, "<p>y</p>")]
    df = html_extract.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "'h' as host", "1 as salt", "'p' as paths"))
    found = df.collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in found) == [("1", 20_000 * len(STORY) - 1), ("2", 1), ("2", 1), ("None", 1)]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


HOSTILE = {
    "quotes": lambda n: '<a "' * n,
    "values": lambda n: '<a b="><a "' * n,
    "depth": lambda n: "<div class='x'>" * n + "</p>" * n,
    "inline": lambda n: "<blockquote><i>" * n + "<div>x</div>" * n,
    "name": lambda n: f"<a {'a' * n}=>",
    "signs": lambda n: "<" * n,
    "raw": lambda n: "<textarea></textarea" * n,
}


@pytest.mark.parametrize("kind", sorted(HOSTILE))
def test_time_is_linear_in_a_hostile_page(kind):
    def took(n):
        began = time.process_time()
        page = html_extract.Page(HOSTILE[kind](n))
        page.text([])
        return time.process_time() - began

    took(1_000)
    assert took(32_000) < 0.2 + 16 * max(took(4_000), 0.01)  # eight times as long; squared it would be 64 times
