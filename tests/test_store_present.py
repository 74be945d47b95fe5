import pytest
from pyspark.sql import functions as F

from claimloom.functions import present as p
from claimloom.model import checked_label, within
from claimloom.plans import claims, lookup, subgraph
from claimloom.sources.graph import Graph
from claimloom.sources.store import Store, repeated_edges, repeated_ids, run_summary, write_json, write_lines


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.version("nodes") is None
    with pytest.raises(LookupError):
        s.read("nodes")
    s.write("nodes", spark.range(3).withColumn("label", F.lit("Startup")), ("label",))
    s.write("edges", spark.range(2))
    s.write("nodes", s.read("nodes").union(s.read("nodes")))  # the version that is read stays as it is
    assert s.version("nodes") == 2 and s.read("nodes").count() == 6
    assert repeated_ids(s.read("nodes")).count() == 3
    assert s.clear() == 6 and s.read("nodes").count() == s.read("edges").count() == 0


def test_repeated_edges(spark):
    df = spark.createDataFrame([("a", "R", "b"), ("a", "R", "b"), ("a", "S", "b")], "src_id string, rel_type string, dst_id string")
    assert [r.n for r in repeated_edges(df).collect()] == [2]


def test_artifacts(spark, tmp_path):
    text = run_summary("r1", "src", {"a": 0.001, "b": 1.5, "c": 3}, [{"stage": "extraction", "url": "u", "error": "x" * 300}] * 7)
    assert "- a: 0.001000" in text and "- b: 1.500" in text and "- c: 3" in text and text.count("extraction") == 5
    write_json(spark, {"k": 1}, f"{tmp_path}/j")
    write_lines(spark.range(2), f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/j").first().k == 1 and spark.read.json(f"{tmp_path}/l").count() == 2


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_texts(spark):
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    assert one(spark, p.insight_title(none, text("A"), text("B"), F.lit(1)), p.insight_title(none, text(" "), text("B"), F.lit(1)), p.insight_title(none, none, none, F.lit(4))) == ("A + B", "B", "Cluster 4")
    assert one(spark, p.insight_subtitle(F.array(text(" x "), text(""), text("y"), text("z")), none, none), p.insight_subtitle(F.array().cast("array<string>"), text("A"), text("B"))) == ("x | y", "Co-investment signal between A and B")
    assert one(spark, p.insight_metric(mentions=F.lit(None), rounds=F.lit(3)), p.insight_metric()) == ("3 rounds", "- metric")
    assert one(spark, p.score_text(F.lit(100.5)), p.score_text(F.lit(2.0)), p.score_text(F.lit(None).cast("double")), p.metric_text(F.lit(0.004)), p.metric_text(F.lit(2.0))) == ("101", "2.00", "-", "0.004000", "2.000")
    assert one(spark, p.relation_label(text("INVESTED_IN")), p.reason_label(text("inverse_direction")), p.reason_label(text("other_thing"))) == ("Invested In", "Conflicting direction between the same entities", "other thing")
    assert one(spark, p.direction_title(text("incoming"), text("ACQUIRED"), text("Me"), text("You")), p.direction_title(text("undirected"), text("MERGED_WITH"), text("Me"), text("You"))) == ("You -> ACQUIRED -> Me", "Me <-> MERGED_WITH <-> You")
    assert one(spark, p.money_text(F.lit(1234567.5), none), p.money_text(F.lit(None).cast("double"), none), p.number(text("x")), p.number(text("2.5")), p.clamp(F.lit(9.0), 0.0, 5.0)) == ("1,234,568 EUR", "n/a", None, 2.5, 5.0)
    assert one(spark, p.trace_url(text("http://t/"), text("a b"), text("x/y")), p.trace_url(text("http://t"), none, none)) == ("http://t/#/experiments/a+b/traces/x%2Fy", None)
    assert one(spark, p.group_text("n", F.array(*[text(c) for c in "abcdefg"])), p.group_text("n", F.array().cast("array<string>")), p.prompt_tags(F.array().cast("array<string>"))) == ("n=[a, b, c, d, e, +2 more]".replace(", +", " +"), None, "none")


def test_trace_references(spark):
    refs = spark.createDataFrame([([("k", 1, "2024-01-01", "b"), ("k", 2, "2023-01-01", "a"), ("m", 0, "2024-05-01", "c"), ("n", 0, "2023-01-01", "0")],)], "r array<struct<key: string, priority: int, at: string, title: string>>")
    assert [(x.key, x.title) for x in refs.select(p.distinct_traces(F.col("r")).alias("x")).first().x] == [("m", "c"), ("n", "0"), ("k", "a")]


def test_assertions_and_reviews(spark):
    a = spark.createDataFrame([([("asserted", "2024-01-01", None, ""), ("asserted", "2024-02-01", None, "e"), ("processed", None, "2024-03-01", "f"), ("asserted", None, None, "g")], [("accepted",), ("rejected",)])], "a array<struct<event: string, processed_at: string, published_at: string, evidence: string>>, h array<struct<decision: string>>")
    r = a.select(claims.sorted_assertions(F.col("a")).alias("s"), claims.primary_assertion(F.col("a")).alias("p"), claims.latest_review(F.col("h")).alias("l"), claims.latest_review(F.slice("h", 1, 0)).alias("none")).first()
    assert [x.evidence for x in r.s] == ["f", "e", "", "g"] and r.p.evidence == "e" and r.l.decision == "rejected" and r.none is None


def test_bounds_and_labels(spark):
    with pytest.raises(ValueError):
        checked_label("Planet")
    with pytest.raises(ValueError):
        within(51, 1, 50, "limit")
    with pytest.raises(ValueError):
        subgraph.graph_view(None, view="other")
    with pytest.raises(ValueError):
        claims.filtered(spark.range(1), "none")


def test_graph_views(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    g = Graph(spark, folder)
    nodes, edges = subgraph.graph_view(g, view="feed", limit=20)
    assert edges.count() == 20 and nodes.count() > 1
    nodes, edges = subgraph.visible(g.nodes(), g.edges("INVESTED_IN"), selected="startup:1", depth=1)
    assert nodes.count() == edges.count() + 1 and {r.marker for r in edges.select("marker").distinct().collect()} == {None}
    assert lookup.search(g, "  ").count() == 0
    assert {r.score for r in lookup.search(g, "mall ri").collect()} == {1.0}
    assert subgraph.most_important(g.nodes("Startup"), g.edges("ACQUIRED"), 5, context="startup:1").count() > 5
