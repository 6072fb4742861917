from __future__ import annotations

import pytest

from ledgerlake.llm import html_extract

LEAD = "The lead tells in one long sentence what the article is about, and it is a part of the article."
BODY = "The body of the article goes on for much longer than the lead does, with one sentence after another. " * 4
ASIDE = "<div class='sidebar'>Side</div>"


def texts(spark, *pages):
    rows = [(i, f"https://host{i}.org/x", page) for i, page in enumerate(pages)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_an_article_split_over_siblings_stays_whole(spark):
    links = "<div class='more'>" + "<p><a href='x'>Another page that one could read as well, with a long name of its own to show</a></p>" * 3 + "</div>"
    post = f"<div class='post'><h1>Head</h1><div class='lead'><p>{LEAD}</p></div><div class='body'><p>{BODY}</p></div></div>"
    want = f"Head\n{LEAD}\n{BODY.strip()}"
    assert texts(spark, f"<body>{post}{ASIDE}</body>", f"<body><div class='page'>{post}{links}</div></body>") == [want] * 2


def test_layout_wrappers_with_boilerplate_words_keep_their_article(spark):
    wrappers = ["class='layout has-sidebar'", "class='no-sidebar'", "class='comments-open'", "id='search-content'", "class='widget'"]
    pages = [f"<body><div>Site</div><div {w}><article><p>{BODY}</p></article>{ASIDE}</div></body>" for w in wrappers[:4]]
    pages += [f"<body><div {w}><div class='post'><p>{BODY}</p></div></div></body>" for w in wrappers]
    assert texts(spark, *pages) == [BODY.strip()] * 9


@pytest.mark.parametrize("part", ["id='comments'", "class='post-comments'"])
def test_comments_longer_than_the_article_stay_out(spark, part):
    comments = f"<div {part}>" + f"<article class='reply'><p>{LEAD}</p></article>" * 40 + "</div>"
    assert texts(spark, f"<body><div class='post'><p>{BODY}</p></div>{comments}</body>")[0] == BODY.strip()
