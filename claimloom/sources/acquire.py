"""Articles from saved pages: links, article fields, dates, collection.

Fetching is outside; pages are a table. Tests on addresses are column
expressions. Markup is read in one pass, a page at a time, in an Arrow function.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from claimloom.functions.batches import small_batches
from claimloom.functions.markup import ALONE, attributes, scan
from claimloom.operators.ranking import ordered_distinct

# Address parts that articles don't have, and limits on text.
BLOCKED = ("#", "/author/", "/category/", "/feed", "/jobs", "/page/", "/ressort/", "/tag/", "/wp-content/")
SHORTEST_TEXT, SHORTEST_PAGE, SHORTEST_PARAGRAPH, LONGEST_TEXT = 20, 120, 35, 20_000
NOISE = frozenset("script style noscript svg nav footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def host(url: Column) -> Column:
    """Host and port of an address as written, without "www."."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def looks_like_article(source: Column, link: Column) -> Column:
    """On the source's host, no blocked part, and a path with a digit."""
    free = F.lit(True)
    for part in BLOCKED:
        free = free & ~link.contains(part)
    return same_host(source, link) & free & (F.regexp_replace(path(link), "^/+|/+$", "") != "") & F.regexp_like(path(link), F.lit("[0-9]"))


def valid_text(text: Column, least: int = SHORTEST_TEXT) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= least


def listing_urls(spark, source: str, paths: list[str], pages: int) -> DataFrame:
    """(page, path_pos, url): the listing pages to read, all paths of a page before the next page."""
    if not 1 <= pages <= 50:
        raise ValueError(f"pages must be from 1 to 50, not {pages}")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "path_pos int, path string")
    base = F.concat(F.rtrim(F.lit(source), F.lit("/")), F.lit("/"), F.trim(F.col("path"), F.lit("/")), F.when(F.trim(F.col("path"), F.lit("/")) == "", "").otherwise("/"))
    each = rows.select("path_pos", base.alias("base"), F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return each.select("page", "path_pos", F.when(F.col("page") > 1, F.concat("base", F.lit("page/"), F.col("page").cast("string"), F.lit("/"))).otherwise(F.col("base")).alias("url"))


#: A paragraph's text holds that of those inside it; from so many times the page's length on, no more are read.
NESTED = 50
#: Tags that an open paragraph or list item doesn't reach out of.
BOUNDARY = frozenset("ul ol article div body".split())
LINKED = frozenset("article main h2 h3".split())
#: A reference with its semicolon; HTML also reads some without.
CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
#: Pages whose rows are made together.
TOGETHER = 100


def unescape_closed(text: str) -> str:
    """Text with those references read that a semicolon ends, as XML has them; "&amp" stays."""
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


class Element:
    """An element as it stands in the page: what it is inside of, and where its words and descendants are.

    Words and elements are in two lists in order of the page, so an element's text
    and what it holds are stretches of these; and what can be said of its ancestors
    is handed down as the page is read. Nothing walks up or down a tree.
    """

    __slots__ = ("at", "attrs", "boxed", "clean", "article", "linked", "noise", "open", "overview", "tag", "to", "up", "words")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, at: int, words: int, clean: int):
        self.tag, self.attrs, self.at, self.to, self.up = tag, attrs, at, at + 1, parent
        self.words, self.clean = [words, words], [clean, clean]
        own = self.classes()
        up = lambda name: parent is not None and getattr(parent, name)
        self.noise = tag in NOISE or up("noise")
        self.article = tag == "article" or up("article")
        self.linked = tag in LINKED or "post" in own or up("linked")
        self.overview = attrs.get("id") == "tagOverview" or up("overview")
        self.boxed = self.overview or "tags" in own or "post-tags" in own or up("boxed")
        # the open paragraph and list item that a new one would close
        self.open = (None, None) if tag in BOUNDARY or parent is None else (self if tag == "p" else parent.open[0], self if tag == "li" else parent.open[1])

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class Page:
    """The elements of a page in order, and its words. closed: references count only with a semicolon."""

    def __init__(self, page: str, closed: bool = False):
        self.unescape = unescape_closed if closed else html.unescape
        self.words: list[str] = []
        self.clean: list[str] = []  # without those inside NOISE
        self.elements: list[Element] = []
        self.stack: list[Element] = [self._element("", {}, None)]
        self.depth: dict[int, int] = {id(self.stack[0]): 0}
        self.open_tags: dict[str, int] = {}
        for kind, name, rest in scan(page):
            if kind == "text":
                self._text(name)
            elif kind == "start":
                self._start(name, attributes(rest, last=True), name in VOID or ALONE.search(rest) is not None)
            else:
                self._close(name)
        self._close_to(0)
        self._end(self.stack[0])

    def _element(self, tag: str, attrs: dict, parent: Element | None) -> Element:
        e = Element(tag, attrs, parent, len(self.elements), len(self.words), len(self.clean))
        self.elements.append(e)
        return e

    def _end(self, e: Element) -> None:
        e.words[1], e.clean[1], e.to = len(self.words), len(self.clean), len(self.elements)

    def _close_to(self, depth: int) -> None:
        """Ends the open elements above a depth; each is ended once."""
        while len(self.stack) > depth + 1:
            e = self.stack.pop()
            del self.depth[id(e)]
            self.open_tags[e.tag] -= 1
            self._end(e)

    def _start(self, tag: str, attrs: dict, empty: bool) -> None:
        if tag in ("p", "li") and not empty:
            before = self.stack[-1].open[tag == "li"]
            if before is not None:
                self._close_to(self.depth[id(before)] - 1)
        e = self._element(tag, attrs, self.stack[-1])
        if not empty:
            self.depth[id(e)] = len(self.stack)
            self.stack.append(e)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        """Ends the last open element of a tag, and those in it; a tag that isn't open ends nothing."""
        if self.open_tags.get(tag):
            depth = len(self.stack) - 1
            while self.stack[depth].tag != tag:
                depth -= 1
            self._close_to(depth - 1)

    def _text(self, text: str) -> None:
        found = (self.unescape(text) if "&" in text and self.stack[-1].tag not in ("script", "style") else text).split()
        self.words += found
        if not self.stack[-1].noise:
            self.clean += found

    def text(self, e: Element) -> str:
        return " ".join(self.words[slice(*e.words)])

    def clean_text(self, e: Element) -> str:
        return " ".join(self.clean[slice(*e.clean)])

    def first(self, test) -> Element | None:
        return next((e for e in self.elements if test(e)), None)

    def meta(self, *names: str) -> str:
        for n in names:
            e = self.first(lambda e, n=n: e.tag == "meta" and (e.attrs.get("name") or e.attrs.get("property") or "").lower() == n)
            if e is not None and (e.attrs.get("content") or "").strip():
                return e.attrs["content"].strip()
        return ""


def _distinct(values) -> list[str]:
    seen: dict[str, str] = {}
    for v in values:
        v = v.strip()
        if v:
            seen.setdefault(v.casefold(), v)
    return list(seen.values())


def article(url: str | None, page: str | None, closed: bool = False) -> tuple:
    """(canonical url, title, summary, author, published, tags, text) of a page."""
    read = Page(page or "", closed)
    one = lambda test: (lambda e: read.text(e) if e is not None else "")(read.first(test))
    link = read.first(lambda e: e.tag == "link" and "canonical" in (e.attrs.get("rel") or "").lower().split())
    canonical = urljoin(url or "", link.attrs.get("href") or "") if link is not None and link.attrs.get("href") else url or ""
    title = one(lambda e: e.tag == "h1") or read.meta("og:title") or one(lambda e: e.tag == "title") or canonical
    when = read.first(lambda e: e.tag == "time" and e.attrs.get("datetime"))
    published = (when.attrs["datetime"] if when is not None else "") or read.meta("article:published_time") or read.meta("date")
    marked = [e for e in read.elements if (e.tag == "a" and ("tag" in (e.attrs.get("rel") or "").split() or e.up.boxed)) or ("data-tag" in e.attrs and e.up.overview)]
    named = [read.text(e) or (e.attrs.get("data-tag") or "").strip() for e in marked]
    listed = [e.attrs["content"] for e in read.elements if e.tag == "meta" and e.attrs.get("content") and (e.attrs.get("property") == "article:tag" or e.attrs.get("name") == "keywords")]
    tags = _distinct(x for t in [*named, *listed] for x in t.strip("#").split(","))
    author = one(lambda e: "author" in (e.attrs.get("rel") or "").split()) or one(lambda e: "author" in e.classes())
    box = None
    for test in (lambda e: e.article and "entry-content" in e.classes(), lambda e: e.article and "post-content" in e.classes(), lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.tag == "body"):
        box = read.first(test)
        if box is not None:
            break
    box = read.elements[0] if box is None else box
    parts, left = [], NESTED * max(1000, len(page or ""))
    for e in read.elements[box.at : box.to]:
        if e.tag in ("p", "li") and not e.noise and left > 0:
            parts.append(read.clean_text(e))
            left -= len(parts[-1])
    text = "\n".join(_distinct(p for p in parts if len(p) > SHORTEST_PARAGRAPH))
    return canonical, title, read.meta("description", "og:description") or None, author or None, published or None, tags, text


ARTICLE = "page_id long, url string, canonical_url string, title string, summary string, author string, published_raw string, tags array<string>, text string"


def _read(pages: DataFrame, rows_of: Callable[[str | None, str | None], list[tuple]], schema: str) -> DataFrame:
    """The rows that a function finds in each page (page_id, url, html), after the page's id, which goes along as an Arrow column: exact, and null as it is."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            rows, at = [], []
            for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())):
                found = rows_of(url, page)
                rows += found
                at += [i] * len(found)
            made = zip(*rows) if rows else [[] for _ in arrow.names[1:]]
            columns = [pa.array(list(c), f.type) for c, f in zip(made, list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *columns], schema=arrow)

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def articles(pages: DataFrame, closed: bool = False) -> DataFrame:
    """The article in each of pages (page_id, url, html).

    closed: in texts only references that a semicolon ends are read, as SQL or XML
    would; else also those that browsers read without one.
    """
    return _read(pages, lambda url, page: [(url, *article(url, page, closed))], ARTICLE)


def page_links(url: str | None, page: str | None) -> list[tuple[int, str]]:
    found = [e for e in Page(page or "").elements if e.tag == "a" and e.attrs.get("href") and e.linked]
    return [(i, urljoin(url or "", e.attrs["href"])) for i, e in enumerate(found)]


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): absolute targets of anchors under .post, article, main, h2 and h3, in order."""
    return _read(pages, page_links, "page_id long, pos int, link string")


def feed_links(spark, path_: str) -> DataFrame:
    """(pos, link) of the items in saved RSS files."""
    rows = spark.read.format("xml").option("rowTag", "item").load(path_)
    return rows.select(F.monotonically_increasing_id().alias("pos"), F.trim("link").alias("link")).where("link <> ''")


def collect_links(found: DataFrame, most: int) -> DataFrame:
    """Links (link, pos) without repeats in any case of letters, the first `most` by position."""
    return ordered_distinct(found, "link", "pos").orderBy("pos", "link").limit(most)


def parse_date(raw: Column) -> Column:
    """ISO 8601 (Z or an offset, or none: UTC), else RFC 822; else null."""
    text = F.trim(raw)
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    rfc = F.regexp_replace(rfc, r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")))


def before_the_end(listing: DataFrame, statuses: DataFrame) -> DataFrame:
    """The listing pages (page, path_pos, url) that would be read, given statuses (url, status): from a 404 on a page after the first, a path has no more."""
    known = statuses.select(F.col("url").alias("u"), "status")
    ends = listing.join(known, F.col("url") == F.col("u")).where("status = 404 AND page > 1").groupBy(F.col("path_pos").alias("p")).agg(F.min("page").alias("end"))
    return listing.join(ends, F.col("path_pos") == F.col("p"), "left").where("end is null OR page < end").select("page", "path_pos", "url")


def collect(source: str, source_name: str, feed: DataFrame, listing: DataFrame, saved: DataFrame, most: int = 150) -> DataFrame:
    """Articles of a source: links of its feed (pos, link), then of its listing pages (pos, link), on its host, once, the first `most`; parsed from saved pages (url, html) where there are such.

    Feed links count as they are; listing links must look like articles.
    Articles of fewer than 120 characters are left out.
    """
    ordered = lambda df, part: df.select("link", F.struct(F.lit(part).alias("part"), "pos").alias("pos"))
    listed = listing.where(looks_like_article(F.lit(source), F.col("link")))
    links_ = ordered(feed, 0).unionByName(ordered(listed, 1)).where(same_host(F.lit(source), F.col("link")))
    chosen = collect_links(links_, most).select(F.trim("link").alias("link"))
    pages = saved.select(F.xxhash64("url").alias("page_id"), "url", "html").join(F.broadcast(chosen), F.col("url") == F.col("link"), "left_semi")
    found = articles(pages).where(valid_text(F.col("text"), SHORTEST_PAGE))
    return found.select(F.concat(F.lit("article:"), F.sha1(F.col("canonical_url").cast("binary"))).alias("article_id"), F.col("canonical_url").alias("url"), "title", F.lit(source_name).alias("source_name"), F.lit(source).alias("source_url"), "summary", "author", parse_date(F.col("published_raw")).alias("published_at"), "tags", "text")
