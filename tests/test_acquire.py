import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.operators.metrics import nearest_rank
from claimloom.operators.ranking import ordered_distinct, ranked_within
from claimloom.sources import acquire
from claimloom.streaming import ingest

PAGE = """<html><head><title>T</title><link rel="canonical" href="/a/1"><meta property="og:title" content="OG"><meta name="description" content="Sum"><meta name="keywords" content="#x, Y"></head>
<body><nav><p>navigation text that is long enough to count as one</p></nav><article><h1> Head <b>line</b></h1><time datetime="2024-03-01T10:00:00Z"></time><a rel="author" href="/u">Jane</a>
<div class="entry-content"><p>This paragraph is surely longer than thirty-five characters.<p>short<p>This paragraph is surely longer than thirty-five characters.</p><ul><li>Another item that is longer than thirty-five characters.</ul></div>
<a rel="tag" href="/t">#AI</a><a href="/2024/05/post-7">more</a></article></body></html>"""


def test_article_fields():
    url, title, summary, author, published, tags, text = acquire.article("https://e.com/x", PAGE)
    assert (url, title, summary, author, published) == ("https://e.com/a/1", "Head line", "Sum", "Jane", "2024-03-01T10:00:00Z")
    assert tags == ["AI", "x", "Y"]
    assert text == "This paragraph is surely longer than thirty-five characters.\nAnother item that is longer than thirty-five characters."
    assert acquire.article(None, None)[6] == ""


def test_addresses_and_dates(spark):
    rows = [("https://www.e.com/", "https://e.com/2024/x", True, True), ("https://e.com/", "https://e.com/tag/1", True, False), ("https://e.com", "https://f.com/1", False, False), ("https://e.com:8", "https://e.com/1", False, False), ("https://e.com", "https://e.com/", True, False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean, article boolean")
    for r in df.select("*", acquire.same_host(F.col("a"), F.col("b")).alias("s"), acquire.looks_like_article(F.col("a"), F.col("b")).alias("l")).collect():
        assert (r.s, r.l) == (r.same, r.article), r.b
    dates = spark.createDataFrame([("2024-03-01T10:00:00Z",), ("Fri, 01 Mar 2024 10:00:00 GMT",), ("Fri, 1 Mar 2024 11:00:00 +0100",), ("2024-03-01",), ("nonsense",), (None,)], "d string").select(acquire.parse_date(F.col("d")).alias("t")).collect()
    assert [d.t for d in dates] == [datetime(2024, 3, 1, 10)] * 3 + [datetime(2024, 3, 1), None, None]


def test_listing_and_links(spark):
    urls = [r.url for r in acquire.listing_urls(spark, "https://e.com/", ["/news/", "blog"], 2).orderBy("page", "path_pos").collect()]
    assert urls == ["https://e.com/news/", "https://e.com/blog/", "https://e.com/news/page/2/", "https://e.com/blog/page/2/"]
    pages = spark.createDataFrame([(1, "https://e.com/x", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert [r.link for r in acquire.links(pages).orderBy("pos").collect()] == ["https://e.com/u", "https://e.com/t", "https://e.com/2024/05/post-7"]
    found = spark.createDataFrame([("A", 3), ("a ", 1), ("b", 2)], "link string, pos int")
    assert [r.link for r in acquire.collect_links(found, 5).collect()] == ["a ", "b"]


def test_ids_stay_as_they_are(spark):
    big = (1 << 60) + 1
    pages = spark.createDataFrame([(big, "https://e.com/x", PAGE), (None, "https://e.com/y", PAGE), (7, None, None), (7, "u", "")], "page_id long, url string, html string").coalesce(1)
    assert sorted(map(str, (r.page_id for r in acquire.articles(pages).collect()))) == sorted(map(str, [big, None, 7, 7]))
    assert sorted(map(str, {r.page_id for r in acquire.links(pages).collect()})) == sorted(map(str, [big, None]))
    assert acquire.articles(pages.limit(0)).count() == acquire.links(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<div><a href='/1'>x</a>" * 43_000, "<span>" * 80_000 + "<li>x</li>" * 50_000, "<div>" * 100_000 + "</x>" * 120_000, "<a rel='tag' href='/2'>" * 43_000, "<p " * 330_000, "<!-- " * 200_000, "<article><div class='tags'>" * 38_000, "<div><p>word " * 76_000],
    ids=["links", "items", "ends", "anchors", "unclosed tags", "comments", "boxes", "paragraphs"],
)
def test_a_megabyte_is_read_in_time(page):
    """Time in proportion to the page: twice of it takes about twice as long, and a megabyte a few seconds on a busy machine."""
    assert len(page) > 950_000
    for read in (acquire.article, acquire.page_links):
        began = time.process_time()
        read("https://e.com/", page)
        assert time.process_time() - began < 6


def test_marks_are_those_of_all_ancestors():
    """Against walks up the tree, on random markup."""
    rng = random.Random(5)
    pieces = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<div class='tags'>", "<div id='tagOverview'>", "<div>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "<a href='/x'>", "</a>", "<br>", "<b/>", "<span class='post x'>", "</span>", "</zz>", "some words ", "&lt;b&gt; "]
    for _ in range(500):
        read = acquire.Page("".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))))
        for e in read.elements:
            line, up = [], e
            while up is not None:
                line.append(up)
                up = up.up
            tags, classes = {x.tag for x in line}, {c for x in line for c in x.classes()}
            assert e.noise == bool(tags & acquire.NOISE) and e.article == ("article" in tags)
            assert e.linked == bool(tags & acquire.LINKED or "post" in classes)
            assert e.overview == any(x.attrs.get("id") == "tagOverview" for x in line) and e.boxed == (e.overview or "tags" in classes)
            inside = [x for x in read.elements if x is e or any(y is e for y in ancestors(x))]
            assert [x.at for x in inside] == list(range(e.at, e.to))
            assert all(e.words[0] <= x.words[0] and x.words[1] <= e.words[1] for x in inside)


def ancestors(e):
    while (e := e.up) is not None:
        yield e


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link> https://e.com/1 </link></item><item><title>u</title><link>https://e.com/2</link></item></channel></rss>")
    assert sorted(r.link for r in acquire.feed_links(spark, str(tmp_path)).collect()) == ["https://e.com/1", "https://e.com/2"]


def test_ranks_and_percentiles(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 11, i) for i in range(100)], "g int, v int, i int")
    want = {}
    for g in range(3):
        for p, r in enumerate(sorted((r for r in df.collect() if r.g == g), key=lambda r: (-r.v, r.i)), 1):
            want[r.i] = p
    got = ranked_within(df, ["g"], [F.desc("v"), F.asc("i")]).collect()
    assert {r.i: r.place for r in got} == want and all(r.total == sum(x.g == r.g for x in got) for r in got)
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "x double")
    assert tuple(nearest_rank(values, "x", [50, 95]).first()) == (3.0, 4.0)
    assert ordered_distinct(df.selectExpr("'x' as t", "i"), "t", "i").count() == 1


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(datetime(2024, 1, 1, h), "x", 1.0) for h in range(24)] + [(datetime(2024, 1, 9), "x", 1.0)], "ts timestamp, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events")
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/wcheck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == sorted(r.n for r in ingest.windowed_counts(events).collect()) == [1, 24]


def test_collect(spark):
    listing = acquire.listing_urls(spark, "https://e.com", ["/news/", "blog"], 3)
    statuses = spark.createDataFrame([("https://e.com/news/page/2/", 404), ("https://e.com/blog/page/3/", 500), ("https://e.com/blog/", 404)], "url string, status int")
    assert [(r.page, r.path_pos) for r in acquire.before_the_end(listing, statuses).orderBy("page", "path_pos").collect()] == [(1, 0), (1, 1), (2, 1), (3, 1)]
    body = "<article><h1>T</h1><time datetime='2024-03-01'></time>" + "".join(f"<p>Paragraph number {i} that is longer than thirty-five characters.</p>" for i in range(4)) + "</article>"
    feed = spark.createDataFrame([(0, "https://e.com/news/about"), (1, "https://other.com/1")], "pos long, link string")
    links = spark.createDataFrame([(0, "https://E.com/1"), (1, "https://e.com/2"), (2, "https://e.com/tag/3"), (3, "https://e.com/NEWS/about"), (4, "https://e.com/4")], "pos long, link string")
    saved = spark.createDataFrame([(u, body) for u in ("https://e.com/news/about", "https://e.com/2", "https://other.com/1", "https://e.com/tag/3")] + [("https://e.com/4", "<p>short</p>")], "url string, html string")
    got = acquire.collect("https://www.e.com/", "E", feed, links, saved).collect()
    assert sorted(r.url for r in got) == ["https://e.com/2", "https://e.com/news/about"] and {r.published_at for r in got} == {datetime(2024, 3, 1)}
    assert acquire.collect("https://www.e.com/", "E", feed, links, saved, most=1).count() == 1


def test_titles_read_closed_references_only(spark):
    page = "<h1>a&amp;&lt;b&gt; &quot;c&quot; &#65;&nosuch; and&amp</h1>"
    pages = spark.createDataFrame([(1, "https://e.com/x", page)], "page_id long, url string, html string")
    assert acquire.articles(pages, closed=True).first().title == 'a&<b> "c" A&nosuch; and&amp'
    assert acquire.articles(pages).first().title == 'a&<b> "c" A&nosuch; and&'


def test_pages_come_in_small_batches(spark):
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    try:
        conf.set(name, "10000")
        pages = spark.range(250).selectExpr("id AS page_id", "'https://e.com/x' AS url", "concat('<h1>', id, '</h1>') AS html")
        assert sorted(int(r.title) for r in acquire.articles(pages).collect()) == list(range(250))
        assert int(conf.get(name)) <= 1000
    finally:
        conf.set(name, before)
