"""Main text of web pages by consensus host paths.

First pass: each page's containers are scored by their own running text less its links, and the best few
vote for their generalised tag-class path (digits and ids left out). Spark sums the votes by host and path,
which gives each host's ranking. Second pass: each page takes the container with its host's best path that
it has, so one odd page follows its host's template; without one it takes its own best. From there it climbs
to ancestors while what they add is running text, so an article split over siblings stays whole.

Parsing is a scan that only moves forward, with a stack of open elements and counts of them by tag: its time
grows with the page's length and nothing else, whatever the page holds.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.shared import written

VOTES = 3
#: Winning paths up to this size go to every executor; beyond, pages meet them by host and salt.
BROADCAST_BYTES, SALTS = 32 << 20, 64
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: A path holds so many of the nearest elements.
STEPS = 12
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_STOP = re.compile(r"""=\s*+["']|>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements without content, and elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SKIPPED = frozenset("nav footer aside form script style noscript template svg math button select option textarea iframe object canvas head menu dialog audio video noembed noframes xmp title".split())
CONTAINERS = frozenset("article main section div td body".split())
#: Words in class or id that mark an element as no part of the article.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar widget pagination pager skip".split())
#: Words that make a class or id a layout's state ("has-sidebar", "comments-open"), not the part's name.
STATES = frozenset("has no with without is open opened closed enabled disabled".split())
#: A marked element that holds so many times the text outside of all marks is the page's content.
MOST = 5
#: A block of so many characters is running text.
RUNNING = 80
#: A part that is named for comments may be longer than the article.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and "=" in raw else {}


def _hidden(attributes: dict[str, str]) -> bool:
    return bool(attributes) and (attributes.get("role", "").lower() in _ROLES or attributes.get("aria-hidden", "").lower() == "true" or "hidden" in attributes)


def _marked(attributes: dict[str, str]) -> int:
    """Whether class or id mark an element as boilerplate: 2 if one is such a word or is about comments, 1 if one has such a word in it, or 0."""
    found = 0
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split() if attributes else ():
        words = _WORD.findall(token)
        if not BOILERPLATE.isdisjoint(words) and STATES.isdisjoint(words):
            found = max(found, 2 if token in BOILERPLATE or not COMMENTS.isdisjoint(words) else 1)
    return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    """An element in a generalised path: its tag and the letters of its first class."""
    first = attributes.get("class", "").lower().split()
    name = re.sub(r"[^a-z]+", "-", first[0]).strip("-") if first else ""
    return f"{tag}.{name}" if name else tag


class Tokens:
    """The texts and tags of a page in order, as (start, text, name, attributes, ends): name is None for text, ends says whether it's an end tag."""

    def __init__(self, page: str):
        self.page = page
        self.ignore_quotes = False  # after a tag that only the page's end would end

    def _tag_end(self, at: int) -> int:
        """Where the tag that ``at`` lies in ends (its ``>``), or -1. Only values in quotes may hold a ``>``."""
        page = self.page
        if not self.ignore_quotes:
            i = at
            while found := _STOP.search(page, i):
                if found[0] == ">":
                    return found.start()
                close = page.find(found[0][-1], found.end())
                i = close + 1 if close >= 0 else found.end()
            self.ignore_quotes = True
        return page.find(">", at)

    def __iter__(self):
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                yield at, page[at:end], None, "", False
                at = end
                continue
            after = page[at + 1 : at + 2]
            if after in ("!", "?"):
                mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
                end = page.find(mark, at + 2)
                at = n if end < 0 else end + len(mark)
                continue
            ends = after == "/"
            name = _NAME.match(page, at + 1 + ends)
            end = self._tag_end(name.end()) if name else -1
            if end < 0:
                yield at, "<", None, "", False
                at += 1
                continue
            tag = name[0].lower()
            yield at, "", tag, page[name.end() : end], ends
            at = end + 1
            if tag in RAW and not ends:
                close = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = close.start() if close else n


class Page:
    """The containers of a page: for each its score, its path, where its blocks start and end, its characters and those in links.

    Elements whose class or id mark them are skipped. Where one of them turns out to hold the page's content,
    the page is parsed again with it, and with all of them where nothing else is left.
    """

    def __init__(self, page: str):
        marks = self._parse(page, frozenset())
        kept = frozenset(at for at, mark, inside, mains, articles in marks if mains or (mark == 1 and (inside > MOST * self.plain or (articles and not self.articles and inside > self.plain))))
        if kept:
            marks = self._parse(page, kept)
        if marks and not self.blocks:
            self._parse(page, None)

    def _parse(self, page: str, kept: frozenset[int] | None) -> list[tuple[int, int, int, int, int]]:
        """Reads the page; marked elements that start at ``kept`` aren't skipped, with None no marked ones are.

        Returns for each skipped one (start, mark, characters, main elements, article elements).
        """
        self.blocks: list[str] = []
        self.headings: set[int] = set()
        self.containers: list[tuple[float, str, int, int, int, int]] = []
        self.parents: dict[int, int] = {}
        self.plain = self.linked = self.articles = 0
        marks: list[tuple[int, int, int, int, int]] = []
        stack: list[tuple] = []  # tag, steps, first block, skipped, links, scores, counts so far, number as a container
        open_tags: Counter[str] = Counter()
        around: list[int] = []  # numbers of the open containers
        above: dict[int, int] = {}  # the container that each stands in
        kept_as: dict[int, int] = {}  # places in ``containers``
        skipped = links = hard = hidden_text = mains = articles = 0
        pending: list[str] = []
        blocks = self.blocks

        def flush() -> None:
            if pending:
                text = " ".join("".join(pending).split())
                pending.clear()
                if text:
                    blocks.append(text)

        def close() -> None:
            nonlocal skipped, links, hard
            tag, steps, first, off, link, scores, (at, mark, plain, linked, hidden, n_mains, n_articles), number = stack.pop()
            open_tags[tag] -= 1
            if number >= 0:
                around.pop()
            if tag in BLOCKS and not skipped:
                flush()
                if tag in HEADINGS and len(blocks) > first:
                    self.headings.add(len(blocks) - 1)
            skipped -= off
            if off and mark:
                marks.append((at, mark, hidden_text - hidden, mains - n_mains, articles - n_articles))
            elif off:
                hard -= 1
            links -= link
            own = scores[0] - 2 * scores[1]
            if number >= 0 and not off and not skipped and len(blocks) > first:
                kept_as[number] = len(self.containers)
                self.containers.append((own, ">".join(steps), first, len(blocks), self.plain - plain, self.linked - linked))
            if stack:  # a paragraph's text counts in full for its parent, by half further up
                parent, share = stack[-1][5], 1.0 if tag not in CONTAINERS else 0.5
                parent[0] += scores[0] * share
                parent[1] += scores[1] * share

        for at, text, tag, raw, ends in Tokens(page):
            if tag is None:
                if not skipped:
                    plain = html_lib.unescape(text) if "&" in text else text
                    pending.append(plain)
                    n = len(plain.strip())
                    self.plain += n
                    self.linked += n if links else 0
                    if stack:
                        stack[-1][5][0] += n
                        if links:
                            stack[-1][5][1] += n
                elif not hard:
                    hidden_text += len(text.strip())
                continue
            if ends:
                if tag == "p" and not open_tags["p"]:
                    flush()
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        close()
                    close()
                continue
            if tag == "body":  # ends a head that was never closed
                while stack and stack[-1][0] != "html":
                    close()
            if tag in BLOCKS:
                while stack and stack[-1][0] not in BLOCKS:  # inline elements that were never closed
                    close()
                if stack and stack[-1][0] == "p":
                    close()
                while stack and stack[-1][0] in CLOSES.get(tag, ()):
                    close()
                if not skipped:
                    flush()
            if tag in VOID:
                if tag == "br" and not skipped:
                    pending.append(" ")
                continue
            attributes = _attributes(raw)
            inside = open_tags["article"] or open_tags["main"]
            whole = tag in ("html", "body", "article", "main")
            hides = tag in SKIPPED or (tag == "header" and not inside) or (not whole and _hidden(attributes))
            mark = 0 if hides or whole or kept is None or at in kept else _marked(attributes)
            off = hides or mark > 0
            if raw.endswith("/") and tag not in BLOCKS:
                continue
            steps = stack[-1][1] if stack else ()
            if tag in BLOCKS:
                steps = (*steps[1 - STEPS :], _step(tag, attributes))
            if off and not skipped and tag in BLOCKS:
                flush()
            number = -1
            if tag in CONTAINERS:
                number = len(above)
                above[number] = around[-1] if around else -1
                around.append(number)
            stack.append((tag, steps, len(blocks), off, tag == "a", [0.0, 0.0], (at, mark, self.plain, self.linked, hidden_text, mains, articles), number))
            open_tags[tag] += 1
            skipped += off
            hard += hides
            if not hard:
                mains += tag == "main"
                articles += tag == "article"
                self.articles += tag == "article" and not skipped
            links += tag == "a"
        while stack:
            close()
        flush()
        nearest = {-1: -1}  # the next container kept, itself included; outer ones have smaller numbers
        for number, outer in above.items():
            if number in kept_as:
                self.parents[kept_as[number]] = nearest[outer]
            nearest[number] = kept_as.get(number, nearest[outer])
        return marks

    def best(self, n: int) -> list[tuple[float, str]]:
        """(score, path) of the ``n`` best containers; of one path the sum of its containers."""
        by_path: dict[str, float] = {}
        for score, path, *_ in self.containers:
            by_path[path] = by_path.get(path, 0.0) + max(score, 0.0)
        preferred = lambda path: path.rpartition(">")[2].split(".")[0] in ("article", "main")
        weighed = {p: s * (2 if preferred(p) else 1) for p, s in by_path.items()}
        return sorted(((s, p) for p, s in weighed.items()), key=lambda x: (-x[0], x[1]))[:n]

    def text(self, paths: list[str]) -> str:
        """The blocks of the containers with the first of ``paths`` that the page has, in page order; else of its own best, else all."""
        have = {path for _, path, *_ in self.containers}
        chosen = next((p for p in paths if p in have), None)
        if chosen is None:
            own = self.best(1)
            chosen = own[0][1] if own else None
        if chosen is None:
            return "\n".join(self.blocks)
        climbs = chosen.rpartition(">")[2].split(".")[0] not in ("article", "main")  # those are whole
        running = [0, *accumulate(len(x) >= RUNNING for x in self.blocks)]
        headings = [0, *accumulate(i in self.headings for i in range(len(self.blocks)))]
        spans, at = [], 0
        for i in sorted((i for i, x in enumerate(self.containers) if x[1] == chosen), key=lambda i: (self.containers[i][2], -self.containers[i][3])):
            if self.containers[i][3] > at:
                spans.append(self._climbed(i, running, headings) if climbs else self.containers[i][2:4])
                at = spans[-1][1]
        out, at = [], 0
        for first, end in sorted(spans, key=lambda x: (x[0], -x[1])):
            if end > at:
                out += self.blocks[max(first, at) : end]
                at = end
        return "\n".join(out)

    def _climbed(self, i: int, running: list[int], headings: list[int]) -> tuple[int, int]:
        """The blocks (start, end) of a container, or of an ancestor as long as what each adds is running text or headings with few links."""
        _, _, first, end, plain, linked = self.containers[i]
        while (i := self.parents.get(i, -1)) >= 0:
            _, path, start, stop, text, links = self.containers[i]
            if (start, stop) != (first, end):
                added = lambda n: n[first] - n[start] + n[stop] - n[end]
                body = path.rpartition(">")[2].split(".")[0] == "body"  # a heading beside the article may be the site's name
                if not (added(running) or (added(headings) and not body)) or 5 * (links - linked) > text - plain:
                    break
            first, end, plain, linked = start, stop, text, links
        return first, end


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port or user; empty for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/:?#\s]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, paths): each host's generalised paths by falling votes, the VOTES best.

    A page's best containers vote with their share of the page's score, so long pages don't outvote others.
    """

    def vote(batches):
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                best = Page(page.as_py() or "").best(VOTES)
                total = sum(s for s, _ in best) or 1.0
                for score, path in best:
                    hosts.append(host)
                    paths.append(path)
                    votes.append(round(1e6 * score / total))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.int64())], ["host", "path", "votes"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    summed = rows.mapInArrow(vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    best = summed.withColumn("place", place).where(F.col("place") <= VOTES)  # each task keeps VOTES paths of a host
    ranked = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("best"))
    return ranked.select("host", F.col("best.path").alias("paths"))


def with_paths(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """``rows`` with the ``paths`` of their host. The winners are broadcast up to BROADCAST_BYTES; beyond, a host's pages are dealt to SALTS tasks."""
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(winners), "host", "left")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return dealt.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages``.

    text holds the article's blocks joined by line feeds, character references decoded, white space inside a
    block made one space; nothing is cut. A null or empty page has the empty text. A null URL counts as a
    host of its own name, the empty one. Repeated rows stay; other columns are ignored.
    """
    winners = written(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = with_paths(rows, winners).select("page_id", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            texts = [Page(page.as_py() or "").text(paths or []) for page, paths in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
