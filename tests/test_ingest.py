from datetime import datetime

import pytest

from claimloom.functions.register import register
from claimloom.operators import ingest
from claimloom.operators.extract import COMPLETE, SEPARATOR
from claimloom.sources.store import Store

LONG = "a text that is long enough"


def text(*rows):
    return "\n".join(SEPARATOR.join(r) for r in rows) + f"\n{COMPLETE}"


def batch(spark, *rows):
    """rows: (article, output)"""
    articles = spark.createDataFrame([(a, f"https://e.com/{a}", f"T {a}", "Daily", datetime(2024, 1, 1), LONG if o is not None else "short") for a, o in rows], "article_id string, url string, title string, source_name string, published_at timestamp, text string")
    outputs = spark.createDataFrame([(a, o) for a, o in rows if o is not None], "article_id string, text string")
    return articles, outputs


def claims(store):
    return {(r.src_id, r.rel_type, r.dst_id): r for r in store.read("claims").collect()}


def test_runs_reviews_and_contradictions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = text(("entity", "Acme GmbH", "Startup", "stated", "makes things"), ("entity", "Beta", "Startup", "attributed", "other"), ("entity", "Robots", "Topic", "stated", "t"), ("entity", "Ghost", "Company", "unsure", "x"), ("relation", "Acme GmbH", "Beta", "ACQUIRED", "stated", "", "bought"), ("relation", "Acme GmbH", "Robots", "HAS_TOPIC", "stated", "", "about"))
    assert ingest.ingest(spark, store, 1, *batch(spark, ("a1", one), ("bad", None))) == {"processed": 1, "failed": 1, "entities": 3, "relationships_created": 3 + 3 + 3 + 2}
    assert {r.id for r in store.read("entities").collect()} == {"startup:acme-gmbh", "startup:beta", "topic:robots"}
    assert claims(store)["startup:acme-gmbh", "ACQUIRED", "startup:beta"].review_status == "unreviewed"
    assert {(r.rel_type, r.dst_id) for r in store.read("article_edges").collect()} == {("MENTIONS", "startup:acme-gmbh"), ("MENTIONS", "startup:beta"), ("HAS_TOPIC", "topic:robots")}
    # another article claims it the other way round, with names written otherwise
    two = text(("entity", "ACME", "Startup", "stated", ""), ("entity", "ACME", "Startup", "stated", "robots"), ("entity", "beta Inc", "Startup", "stated", "b"), ("relation", "beta Inc", "ACME", "ACQUIRED", "stated", "", "bought"))
    ingest.ingest(spark, store, 2, *batch(spark, ("a2", two)))
    assert {r.id for r in store.read("entities").collect()} == {"startup:acme-gmbh", "startup:beta", "topic:robots"}
    got = claims(store)
    assert all(got[k].review_reasons == ["inverse_direction"] for k in got if k[1] == "ACQUIRED") and len([k for k in got if k[1] == "ACQUIRED"]) == 2
    assert ingest.review(spark, store, "startup:beta", "ACQUIRED", "startup:acme-gmbh", "rejected", "no", "me")
    assert not ingest.review(spark, store, "x", "ACQUIRED", "y", "accepted")
    with pytest.raises(ValueError):
        ingest.review(spark, store, "x", "ACQUIRED", "y", "maybe")
    got = claims(store)
    assert got["startup:beta", "ACQUIRED", "startup:acme-gmbh"].review_status == "rejected" and got["startup:acme-gmbh", "ACQUIRED", "startup:beta"].review_status == "unreviewed"
    # the first article again, now without the acquisition
    ingest.ingest(spark, store, 3, *batch(spark, ("a1", text(("entity", "Acme", "Startup", "stated", "m"), ("entity", "Robots", "Topic", "stated", "t"), ("relation", "Acme", "Robots", "HAS_TOPIC", "stated", "", "about")))))
    c = claims(store)["startup:acme-gmbh", "ACQUIRED", "startup:beta"]
    assert (c.lifecycle_status, c.review_status, c.review_reasons, c.support_changed, c.active_article_urls) == ("unsupported_by_latest_source_processing", "needs_review", ["not_reproduced_same_article"], True, [])
    assert (c.evidence_status, c.evidence, c.article_titles) == ("stated", "bought", ["T a1"])
    shown = {(r.relationship, r.direction): r for r in ingest.claim_payload(spark, store, "startup:acme-gmbh").collect()}
    r = shown["ACQUIRED", "outgoing"]
    assert [a.event for a in r.assertions] == ["not_reproduced", "asserted"] and r.assertions[1].evidence == "bought" and r.assertions[1].article_id == "a1" and r.assertions[1].source_name == "Daily" and r.assertions[0].processed_at > r.assertions[1].processed_at
    assert r.primary_assertion.evidence == "bought" and r.counterparty_id == "startup:beta" and r.active_support_count == 1 and r.review_history == []
    r = shown["ACQUIRED", "incoming"]
    assert (r.review_status, r.review_comment, r.reviewed_by, [x.decision for x in r.review_history]) == ("rejected", "no", "me", ["rejected"])
    assert store.read("articles").count() == 2 and store.read("sources").first().id == "source:daily"
    a1 = store.read("articles").where("article_id = 'a1'").first()
    assert len(a1.provenance) == 2 and a1.run == 3 and '"topics":[{"name":"Robots"' in a1.raw_extraction
    # folding everything anew changes nothing
    before = sorted(map(str, store.read("claims").collect()))
    ingest.refresh(spark, store)
    assert sorted(map(str, store.read("claims").collect())) == before


def test_extractor_and_embedder(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "article_id string, text string")
    assert sorted((r.article_id, r.text, r.attempts, r.error) for r in ingest.extracted(df, lambda x: f"<{x}>").collect()) == [("a", "<x>", 1, None), ("b", "<>", 1, None)]
    assert sorted(len(r.vector) for r in ingest.embedded(df, "text", lambda xs: [[float(len(x))] * (1 + len(x)) for x in xs]).collect()) == [1, 2]


def stub(folder, fails):
    """An extractor that fails as often for a text as its number says, and notes when it was called, and how many were under way."""

    def call(text):
        import os
        import time

        name, _, body = text.partition("|")
        mine = os.path.join(folder, name)
        os.makedirs(mine, exist_ok=True)
        open(os.path.join(folder, f"on-{name}"), "w").close()
        under_way = sum(x.startswith("on-") for x in os.listdir(folder))
        calls = len(os.listdir(mine))
        with open(os.path.join(mine, f"{calls}-{time.time()}-{under_way}"), "w"):
            pass
        time.sleep(0.05)
        os.remove(os.path.join(folder, f"on-{name}"))
        if calls < fails[name]:
            raise OSError(f"not now ({calls})")
        return body

    return call


def test_an_extractor_that_fails_is_called_again(spark, tmp_path):
    import os

    fails = {"a": 0, "b": 2, "c": 9, "d": 1}
    df = spark.createDataFrame([(n, f"{n}|text") for n in fails], "article_id string, text string")
    got = {r.article_id: r for r in ingest.extracted(df, stub(str(tmp_path), fails), callers=2, wait=0.1).collect()}
    assert {n: (r.text, r.attempts, r.error) for n, r in got.items()} == {"a": ("text", 1, None), "b": ("text", 3, None), "c": (None, 3, "OSError: not now (2)"), "d": ("text", 2, None)}
    calls = {n: sorted(os.listdir(tmp_path / n)) for n in fails}
    times = [float(x.split("-")[1]) for x in calls["b"]]
    assert 0.2 <= times[1] - times[0] < 0.4 <= times[2] - times[1] < 0.8  # 2 and 4 tenths
    assert max(int(x.split("-")[2]) for xs in calls.values() for x in xs) <= 2
    assert ingest.extracted(df.limit(0), stub(str(tmp_path), fails)).count() == 0


def test_runs_with_an_extractor(spark, tmp_path):
    """Articles whose extraction fails to the end count as failed and write nothing."""
    outputs = {"a1": text(("entity", "Acme", "Startup", "stated", "m")), "a2": None}
    articles, _ = batch(spark, ("a1", "x"), ("a2", "x"), ("a3", None))
    from pyspark.sql import functions as F

    def extractor(told):
        if told.startswith("a2"):
            raise ValueError("never")
        return outputs["a1"]

    store = Store(spark, str(tmp_path))
    ingest.LONGEST_WAIT, before = 0.01, ingest.LONGEST_WAIT
    try:
        got = ingest.ingest(spark, store, 1, articles.withColumn("text", F.concat("article_id", F.lit(" "), "text")).where("article_id <> 'a3'").unionByName(articles.where("article_id = 'a3'")), extractor=extractor)
    finally:
        ingest.LONGEST_WAIT = before
    assert got == {"processed": 1, "failed": 2, "entities": 1, "relationships_created": 3 + 1 + 1}
    assert [r.article_id for r in store.read("articles").collect()] == ["a1"]
    assert {(r.article_id, r.failed, r.graph_operations) for r in store.read("article_runs").collect()} == {("a1", False, 5), ("a2", True, 3), ("a3", True, 3)}
    assert {r.article_id: (r.attempts, r.error) for r in store.read("extractions").collect()} == {"a1": (1, None), "a2": (3, "ValueError: never")}


def test_latency_counts_add_up(spark):
    import random

    from claimloom.operators import metrics

    rng = random.Random(3)
    values = [(i % 3, rng.lognormvariate(5, 2)) for i in range(400)] + [(1, 0.0), (2, None)]
    df = spark.createDataFrame(values, "day int, ms double")
    exact = metrics.nearest_rank(df, "ms", [50, 95]).first()
    whole = metrics.latency_percentiles(metrics.latency_counts(df, "ms"), [50, 95]).first()
    parts = metrics.latency_percentiles(metrics.latency_counts(df, "ms", "day"), [50, 95]).first()
    assert tuple(whole) == tuple(parts) and all(e <= w <= e * 2 ** (1 / 8) * 1.0001 for e, w in zip(exact, whole))
    seen, rows = metrics.observed_tally(spark.createDataFrame([(True, 1, 2), (False, 3, 4), (None, 5, 6)], "failed boolean, entity_count long, graph_operations long"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == metrics.tally(rows).first().asDict() == {"processed": 2, "failed": 1, "entities": 8, "relationships_created": 10}


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT norm_key('Acme GmbH', 'Startup') a, norm_display('Berlin-based Acme') b, norm_slug('Ä B') c, token_set('the acme of x') d, jaro_winkler('martha', 'marhta') e, token_sort_ratio('a b', 'b a') f, token_set_ratio('acme labs', 'acme') g, cosine(array(1d, 0d), array(1d, 1d)) h, parse_article_html('https://e.com', '<h1>T</h1>').title i").first()
    assert (r.a, r.b, r.c, r.d, round(r.e, 4), r.f, r.g, round(r.h, 4), r.i) == ("acme", "Acme", "a-b", ["acme"], 0.9611, 1.0, 1.0, 0.7071, "T")
    assert [tuple(x) for x in spark.sql(f"SELECT * FROM parse_extraction('entity{SEPARATOR}A{SEPARATOR}Topic{SEPARATOR}d')").collect()] == [(0, "entity", ["A", "Topic", "d"])]


def test_feedback(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ingest.feedback(spark, store, "t1", "overall", "good")
    ingest.feedback(spark, store, "t2", "resolution", "wrong_merge", "two Acmes", "me")
    assert sorted((r.trace_id, r.label, r.comment) for r in store.read("feedback").collect()) == [("t1", "good", None), ("t2", "wrong_merge", "two Acmes")]
    with pytest.raises(ValueError):
        ingest.feedback(spark, store, "t", "overall", "fine")


def test_fields_of_an_article_that_comes_again(spark):
    from claimloom.operators.lifecycle import upserted_articles

    blank = dict.fromkeys(f.split()[0] for f in ingest.ARTICLES.split(", "))
    old = spark.createDataFrame([blank | {"article_id": "a", "author": "x", "summary": "s", "trace_id": "t1", "trace_url": "u", "provenance": ["p1"]}, blank | {"article_id": "b", "title": "B"}], ingest.ARTICLES)
    new = spark.createDataFrame([blank | {"article_id": "a", "author": None, "summary": "n", "trace_id": "", "trace_url": "v", "provenance": ["p1"]}, blank | {"article_id": "c", "provenance": ["p3"]}], ingest.ARTICLES)
    got = {r.article_id: r for r in upserted_articles(old, new).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].title == "B" and got["c"].provenance == ["p3"]
    assert (got["a"].author, got["a"].summary, got["a"].trace_id, got["a"].trace_url, got["a"].provenance) == (None, "n", "t1", "v", ["p1"])


def test_snapshot_counts_its_records(spark):
    from pyspark.sql import functions as F

    from claimloom.operators import extract

    df = spark.createDataFrame([("a", text(("entity", "Acme", "Startup", "stated", "x"), ("entity", "R", "Topic", "unsure", "x"), ("relation", "Acme", "R", "HAS_TOPIC", "stated", "", "about"))), ("b", text(("entity", "Ann", "Person", "stated", "x")))], "article_id string, text string")
    shots = extract.snapshot(*extract.typed(extract.parse(df)))
    assert {r.article_id: r.n for r in shots.select("article_id", extract.snapshot_items(F.col("raw_extraction")).alias("n")).collect()} == {"a": 3, "b": 1}
    odd = spark.createDataFrame([('{"startups": [{"a": 1}, 2, null, "x"], "topics": 7}',), ("no json",), (None,)], "raw string")
    assert [r.n for r in odd.select(extract.snapshot_items(F.col("raw")).alias("n")).collect()] == [1, 0, 0]


def test_nothing_merges_into_its_neighbour(spark, tmp_path):
    """A startup that an article relates to Acme is another one, although its vector says otherwise; without the relation it is Acme."""
    embedder = lambda xs: [[1.0, 0.1] if x.startswith(("Acme", "Akme")) else [0.0, 1.0] for x in xs]
    store = Store(spark, str(tmp_path))
    ingest.ingest(spark, store, 1, *batch(spark, ("a1", text(("entity", "Acme", "Startup", "stated", "m")))), embedder=embedder)
    ingest.ingest(spark, store, 2, *batch(spark, ("a2", text(("entity", "Acme", "Startup", "stated", "m"), ("entity", "Akme Labs", "Startup", "stated", "m"), ("relation", "Acme", "Akme Labs", "PARTNERED_WITH", "stated", "", "x")))), embedder=embedder)
    assert {r.id for r in store.read("entities").collect()} == {"startup:acme", "startup:akme-labs"}
    ingest.ingest(spark, store, 3, *batch(spark, ("a3", text(("entity", "Akme Robots", "Startup", "stated", "m")))), embedder=embedder)
    assert {r.id for r in store.read("entities").collect()} == {"startup:acme", "startup:akme-labs"}
    assert store.read("vectors").count() == 2


def test_appends(spark, tmp_path, monkeypatch):
    from claimloom.sources import store as module

    store = Store(spark, str(tmp_path))
    monkeypatch.setattr(module, "MOST_PARTS", 3)
    for i in range(6):
        store.append("t", spark.createDataFrame([(i,)], "i long"))
    assert sorted(r.i for r in store.read("t").collect()) == list(range(6)) and len(store.parts("t")) <= 3
