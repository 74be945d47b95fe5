"""The word index and the pairs of investors against plain versions, and what their plans read."""

import itertools
import random
import re

from pyspark.sql import functions as F

from claimloom import queries
from claimloom.operators import conflicts
from claimloom.plans import adjacency, insights, lookup, search_index, subgraph
from claimloom.sources import graph

NODE = "id string, name string, type string, aliases array<string>, description string, canonical_name string, own_name string"


def test_words_are_found_by_their_beginnings(spark, tmp_path):
    rng = random.Random(4)
    words = ["ring", "ringo", "small", "smart", "s", "x", "Äpfel", "äpfel", "7up", "a-b", "über", "RING"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) or None
    rows = [(f"e{i}", some(), "Startup", [x for x in (some(), some()) if x] if i % 3 else None, some(), some(), some()) for i in range(200)]
    folder = str(tmp_path)
    search_index.write_index(spark.createDataFrame(rows, NODE), folder)

    def fields(r):
        return [{w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w} for t in (r[6], r[5], " ".join(r[3] or []), r[4])]

    for terms in (["ring"], ["sm", "ri"], ["s"], ["ä"], ["ü"], ["7"], ["x", "x"], ["a"], ["ringo", "small", "b"], ["nothing"]):
        want = {}
        for r in rows:
            hits = [sum(any(w.startswith(t) for w in f) for f in fields(r)) for t in terms]
            if all(hits):
                want[r[0]] = float(sum(hits))
        assert {r.id: r.score for r in search_index.found_by_terms(spark, folder, terms).collect()} == want, terms


def test_a_search_reads_the_folder_of_its_term(spark, tmp_path):
    nodes = spark.range(2000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("Startup").alias("type"), F.lit(None).cast("array<string>").alias("aliases"), F.concat_ws(" ", F.chr(97 + F.col("id") % 26), F.hex("id"), F.lit("common")).alias("description"), F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast("string").alias("own_name"))
    search_index.write_index(nodes, str(tmp_path))
    plan = search_index.found_by_terms(spark, str(tmp_path), ["7a"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(word,7a)" in plan and re.search(r"PartitionFilters: \[[^\]]*head", plan)
    read = search_index.beginning_with(spark.read.parquet(f"{tmp_path}/postings"), "7a")
    assert 0 < len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) and read.select(F.input_file_name().alias("f")).distinct().where("f not like '%head=7A%' and f not like '%head=7a%'").count() == 0


def test_pairs_with_a_startup_that_nearly_all_are_in(spark, monkeypatch):
    """Blocks of a few investors, a bound that leaves most of them out: counts are those of all pairs."""
    rng = random.Random(9)
    deals = {(f"i{i:03}", "hot") for i in range(300)} | {(f"i{rng.randrange(40):03}", f"s{rng.randrange(30)}") for _ in range(400)}
    of = {}
    for i, s in deals:
        of.setdefault(i, set()).add(s)
    want = {(a, b): len(of[a] & of[b]) for a, b in itertools.combinations(sorted(of), 2) if of[a] & of[b]}
    df = spark.createDataFrame(sorted(deals), "src_id string, dst_id string")
    monkeypatch.setattr(insights, "TOGETHER", 16)
    monkeypatch.setattr(insights, "LEADERS", 12)
    got = {(r.source_id, r.target_id): r.shared_startups for r in insights.shared_counts(df).collect()}
    assert got == want
    best = sorted(want.values(), reverse=True)
    for limit in (1, 5, 20):
        bound = insights.least_shared(df, limit)
        assert 1 < bound <= best[limit - 1]
        able = {i for i in of if len(of[i]) >= bound}
        assert len(able) < 45 and {p for p, n in want.items() if n >= best[limit - 1]} <= set(itertools.combinations(sorted(able), 2))
    assert insights.least_shared(df, 10**6) == 1


def test_walks_read_the_buckets_of_their_frontier(spark, tmp_path, monkeypatch):
    rng = random.Random(13)
    links = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(90)] + [("hub", f"m{i}") for i in range(70)] + [("m3", "n1"), ("x", "x"), (None, "n1"), ("n2", None)] * 2
    ways = {}
    for a, b in links:
        if a and b:
            ways.setdefault(a, set()).add(b)
            ways.setdefault(b, set()).add(a)
    monkeypatch.setattr(adjacency, "PACKED", 8)
    folder = f"{tmp_path}/rows"
    adjacency.write_adjacency(spark.createDataFrame(links, "src_id string, dst_id string"), folder, 16)
    rows = spark.read.parquet(folder)
    assert {(r.node, x) for r in rows.collect() for x in r.neighbours} == {(a, b) for a, bs in ways.items() for b in bs}
    assert rows.where("node = 'hub'").count() > 4 and max(len(r.neighbours) for r in rows.collect()) < 40
    for few in (10_000, 3):  # named buckets, or a join
        monkeypatch.setattr(adjacency, "FEW", few)
        for start, depth in ((["n1"], 3), (["hub"], 2), (["x", "n5", "nowhere"], 4), ([], 2), (["n1"], 0)):
            want, frontier = dict.fromkeys(start, 0), set(start)
            for k in range(1, depth + 1):
                frontier = {b for a in frontier for b in ways.get(a, ())} - want.keys()
                want |= dict.fromkeys(frontier, k)
            got = adjacency.walk(spark, folder, spark.createDataFrame([(s,) for s in start], "id string"), depth, 16)
            assert {r.id: r.hops for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(adjacency, "FEW", 10)
    plan = adjacency.neighbours_of(rows, spark.createDataFrame([("hub",)], "id string"), 16)._jdf.queryExecution().executedPlan().toString()
    bucket = spark.createDataFrame([("hub",)], "id string").select(adjacency.bucket_of(F.col("id"), 16)).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\b", plan) and "GreaterThanOrEqual(node,hub)" in plan


ROOT = "/root/testdata/sf0.001"


def odd_tables(spark, folder, far=0):
    """Tables with null keys, negative ones, null texts, a text in two kinds, repeated lines, and a key that is far away."""
    part = [(1, "b1"), (2, "b2"), (3, None), (-4, "b1"), (5, "5-LOW"), (None, "b3")]
    orders = [(1, 1, "1-URGENT"), (2, 2, None), (-3, None, "5-LOW"), (4, -7, "1-URGENT"), (5, 5 + far, "")]
    lines = [(1, 1, 3, 1), (1, 2, 4, 2), (1, 3, 5, 3), (1, -4, None, 6), (2, None, 3, 1), (2, 9, -1, 6), (-3, 1, 3, 1), (-3, 1, 3, 2), (4, 5, 6, 1), (4, 2, 7, 4), (5 + far, 1, 7, 1), (None, 1, 3, 1)]
    spark.createDataFrame(part, "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    rows = [(*x, "A", "O") for x in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    return graph.Graph(spark, folder)


def test_links_in_numbers_are_the_links(spark, tmp_path):
    """No text is shuffled, sampled or sorted for a walk, and no list is made by Python; rows are by one number."""
    g = odd_tables(spark, str(tmp_path), (1 << 60) - 6)
    assert g.numbers_fit()
    links, texts = g.numbered_links()
    assert dict(links.dtypes) == {"src_id": "bigint", "dst_id": "bigint"}
    named = links.distinct().where("src_id is not null and dst_id is not null")
    for end in ("src_id", "dst_id"):
        named = g.with_ids(named.withColumnRenamed(end, "id"), texts).withColumnRenamed("id", end)
    got = {frozenset((r.src_id, r.dst_id)) for r in named.collect()}
    assert got == {frozenset((r.src_id, r.dst_id)) for r in g.links().where("src_id is not null and dst_id is not null").distinct().collect()}
    plan = adjacency.numbered(links)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "rangepartitioning" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan


def test_walk_of_numbers(spark, tmp_path, monkeypatch):
    """Three steps over numbers are those over texts, for few ids and many; keys that have no number go by texts."""
    walk = queries.QUERIES["q14_walk_of_three"]
    odd_tables(spark, f"{tmp_path}/odd")
    assert not odd_tables(spark, f"{tmp_path}/far", 1 << 60).numbers_fit()
    for folder, few in (("odd", 1), ("far", 10_000)):
        monkeypatch.setattr(adjacency, "FEW", few)
        g = graph.Graph(spark, f"{tmp_path}/{folder}")
        want = {(r.id, r.hops) for r in subgraph.hops(g.links(), spark.createDataFrame([("investor:3",)], "id string"), 3).collect() if r.id is not None}
        got = [(r.id, r.hops) for r in walk(spark, f"{tmp_path}/{folder}").collect()]
        assert set(got) == want and len(got) == len(want) > 10


def test_edges_are_grouped_by_numbers(spark, monkeypatch):
    """Hash tables of fixed-width rows, no sort of texts; more lines get more partitions."""
    monkeypatch.setattr(graph, "LINES_A_PART", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        plan = subgraph.degrees(graph.Graph(spark, ROOT).edges())._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and int(spark.conf.get("spark.sql.shuffle.partitions")) >= 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = spark.createDataFrame([(x,) for x in (None, "", "A", "AB", "N", "Q", "R", "r")], "f string")
    assert [r.p for r in rows.select(graph.place_of("f", graph.FLAGS).alias("p")).collect()] == [None, 0, 1, 2, 3, 4, 5, 6]


def test_few_ids_are_asked_for_before_links_are_made(spark, monkeypatch):
    """Both ways of going on reach the same nodes, and few ids are not exploded out of all links."""
    rng = random.Random(3)
    links = spark.createDataFrame([(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [(None, "n1"), ("n2", None)], "src_id string, dst_id string")
    start = spark.createDataFrame([("n1",), ("n2",)], "id string")
    asked, at_ends = [], subgraph.at_ends
    monkeypatch.setattr(subgraph, "at_ends", lambda *a: asked.append(a) or at_ends(*a))
    got = {r.id: r.hops for r in subgraph.hops(links, start, 3).collect()}
    assert len(asked) == 3
    monkeypatch.setattr(subgraph, "FEW", 0)
    assert got == {r.id: r.hops for r in subgraph.hops(links, start, 3).collect()} and len(asked) == 3


def test_a_profile_asks_for_the_edges_of_its_node(spark, monkeypatch):
    """No edge is made that doesn't touch the node: the filters name its id and stand at the scans."""
    plans = []
    monkeypatch.setattr(lookup, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    assert lookup.investor_profile(graph.Graph(spark, ROOT), "Supplier#000000003").count() == 50
    edges = plans[1]
    at = {line.lstrip(" :+-") for line in edges.splitlines() if "Aggregate [rel" in line}
    assert at and edges.index("investor:3") > 0 and "(investor:3)" not in edges.split("Aggregate")[0]


def test_contested_edges_are_those_that_are_flagged(spark):
    rng = random.Random(6)
    kinds = ["INVESTED_IN", "ACQUIRED", "MERGED_WITH", "PARTNERED_WITH"]
    rows = sorted({(f"n{rng.randrange(9)}", rng.choice(kinds), f"n{rng.randrange(9)}") for _ in range(90)})
    rows = [(*r, rng.choice(["supported", "supported", "gone"]), rng.choice(["accepted", "unreviewed", "rejected", None])) for r in rows] + [(None, "ACQUIRED", "n1", "supported", None)]
    edges = spark.createDataFrame(rows, "src_id string, rel_type string, dst_id string, lifecycle_status string, review_status string")
    shown = lambda df: sorted(map(str, conflicts.flagged(df).where("size(review_reasons) > 0").collect()))
    few = conflicts.contested(edges)
    assert shown(few) == shown(edges) and shown(edges) and few.count() < len(rows)


def test_lines_are_paired_in_runs_of_their_numbers(spark, tmp_path):
    """Lines that are one, two or three numbers apart meet, wherever runs of numbers end; a line of a short order is sent to its pairs once."""
    rng = random.Random(6)
    lines = [(o, rng.randrange(40), rng.randrange(9), n, rng.choice("ANR"), rng.choice("OF")) for o in range(12) for n in rng.choices(range(-4, 30), k=25)]
    lines += [(50, None, 1, 3, "A", "O"), (50, 7, 1, None, "A", "O"), (50, 8, 1, 4, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for a, b in itertools.product([x for x in lines if None not in (x[1], x[3])], repeat=2):
        rel = {1: "ACQUIRED", 2: "MERGED_WITH", 3: "PARTNERED_WITH"}.get(b[3] - a[3])
        if a[0] == b[0] and rel and a[1] != b[1]:
            ends = f"startup:{a[1]}", f"startup:{b[1]}"
            k = (rel, *(sorted(ends) if rel == "MERGED_WITH" else ends))
            want[k] = want.get(k, 0) + 1
    found = graph.Graph(spark, str(tmp_path)).edges("ACQUIRED", "MERGED_WITH", "PARTNERED_WITH").collect()
    assert {(r.rel_type, r.src_id, r.dst_id): r.support for r in found} == want and len(found) == len(want)
    assert spark.range(1, 8).select(F.size(graph.runs_before("id", [1, 2, 3])).alias("n")).where("n > 1").isEmpty()


def test_deals_are_dealt_by_their_pairs(spark, monkeypatch):
    """Tasks that make pairs are as many as the pairs need, however few the deals are; none is joined to another."""
    monkeypatch.setattr(insights, "PAIRS_A_TASK", 50)
    deals = [(f"i{i:02}", f"s{s}") for i in range(20) for s in range(6)]
    got = insights.shared_counts(spark.createDataFrame(deals, "src_id string, dst_id string"))
    assert insights.tasks_for(6 * 190) == 23 and insights.tasks_for(0) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\([^\n]*, 23\), REPARTITION_BY_NUM", plan)) == 2
    assert {r.shared_startups for r in got.collect()} == {6} and got.count() == 190
