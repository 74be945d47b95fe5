"""Queries for operators that the main ones use only in passing, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import normalize, present
from claimloom.model import DOMAIN_RELATIONS, EVIDENCE, evidence_rank, insightful, live
from claimloom.operators import conflicts, extract, lifecycle, metrics, ordered, resolve, vectors
from claimloom.operators.ranking import page, side_by_side
from claimloom.oracle import DOMAIN, GRAPH
from claimloom.plans import claims, subgraph
from claimloom.queries import EDGE, joined_lists, line_relations, on_graph, on_table, outputs
from claimloom.sources.graph import Graph
from claimloom.sources.store import repeated_edges, repeated_ids

BOTH = {}


def both(sql: str):
    def take(f):
        BOTH[f.__name__] = (f, sql)
        return f

    return take


def graph(f):
    run = on_graph(f)
    run.__name__ = f.__name__
    return run


def table(name: str):
    def take(f):
        run = on_table(name, f)
        run.__name__ = f.__name__
        return run

    return take


@both(GRAPH + f"SELECT rel_type, count(*) FILTER (coalesce(lifecycle_status, 'supported') = 'supported' AND coalesce(review_status, 'unreviewed') <> 'rejected') AS n_live, count(*) FILTER (coalesce(lifecycle_status, 'supported') = 'supported' AND coalesce(review_status, 'unreviewed') IN ('unreviewed', 'accepted')) AS n_insight FROM edges WHERE rel_type IN ({DOMAIN}) GROUP BY 1")
@graph
def p5_p6_live_claims(g: Graph) -> DataFrame:
    state = F.col("lifecycle_status"), F.col("review_status")
    return g.edges(*DOMAIN_RELATIONS).groupBy("rel_type").agg(F.count_if(live(*state)).alias("n_live"), F.count_if(insightful(*state)).alias("n_insight"))


@both("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at, '{\"event\":\"asserted\",\"article_id\":\"article:' || o_orderkey || '\",\"source_name\":\"' || o_orderpriority || '\"}' AS record FROM orders")
@table("orders")
def p11_g17_json(orders: DataFrame) -> DataFrame:
    record = lifecycle.provenance(F.lit("asserted"), article_id=F.concat(F.lit("article:"), F.col("o_orderkey").cast("string")), source_name=F.col("o_orderpriority"), evidence=F.lit(None).cast("string"))
    return orders.select("o_orderkey", present.iso(F.col("o_orderdate")).alias("at"), record.alias("record"))


@both(GRAPH + ", cut AS (SELECT * FROM edges WHERE dst_id NOT IN ('topic:Brand#13', 'topic:Brand#5') AND src_id NOT IN ('topic:Brand#13', 'topic:Brand#5')) SELECT rel_type, count(*) AS n FROM cut GROUP BY 1")
@graph
def g15_without_geography(g: Graph) -> DataFrame:
    nodes = g.nodes().withColumn("category", F.when(F.col("id").isin("topic:Brand#13", "topic:Brand#5"), "Geography").when(F.col("label") == "Topic", "sector"))
    return conflicts.without_geography(nodes, g.edges())[1].groupBy("rel_type").agg(F.count("*").alias("n"))


@both(GRAPH + "SELECT rel_type, count(*) FILTER (lifecycle_status IS NULL) AS no_lifecycle, count(*) FILTER (review_status IS NULL) AS no_review FROM edges GROUP BY 1")
@graph
def g13_initialised(g: Graph) -> DataFrame:
    return conflicts.initialised(g.edges()).groupBy("rel_type").agg(F.count_if(F.col("lifecycle_status").isNull()).alias("no_lifecycle"), F.count_if(F.col("review_status").isNull()).alias("no_review"))


@both(GRAPH + f"SELECT count(*) FILTER (i) AS inverse, count(*) FILTER (NOT i) AS competing, count(*) AS conflicts FROM (SELECT true AS i FROM living x JOIN living y ON x.src_id = y.dst_id AND x.dst_id = y.src_id AND x.rel_type = y.rel_type WHERE x.rel_type IN ('INVESTED_IN', 'FOUNDED_BY', 'EMPLOYED_BY', 'ACQUIRED') AND x.src_id < x.dst_id UNION ALL SELECT false FROM living x JOIN living y ON least(x.src_id, x.dst_id) = least(y.src_id, y.dst_id) AND greatest(x.src_id, x.dst_id) = greatest(y.src_id, y.dst_id) WHERE x.rel_type = 'ACQUIRED' AND y.rel_type = 'MERGED_WITH')")
@graph
def g12_conflict_count(g: Graph) -> DataFrame:
    return conflicts.conflict_count(g.edges(*DOMAIN_RELATIONS))


@both("""SELECT (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1)) AS nodes, (SELECT sum(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1))::BIGINT AS node_rows,
         (SELECT count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS edges""")
@graph
def s11_repeated_keys(g: Graph) -> DataFrame:
    """Keys that stand for several rows, in nodes and edges as a careless writer would leave them: a topic per part, a claim per line."""
    topics = g.table("part").select(F.concat(F.lit("topic:"), F.col("p_brand")).alias("id"))
    claims = g.table("lineitem").select(g._backer("l_suppkey").alias("src_id"), F.lit("INVESTED_IN").alias("rel_type"), g._startup("l_partkey").alias("dst_id"))
    sound = repeated_ids(g.nodes()).unionByName(repeated_edges(g.edges()).select(F.lit("edge").alias("id"), "n"))  # none: the graph's own keys are unique
    return side_by_side(repeated_ids(topics).unionByName(sound).agg(F.count("*").alias("nodes"), F.sum("n").alias("node_rows")), repeated_edges(claims).agg(F.count("*").alias("edges")))


def line_sightings(lines: DataFrame) -> DataFrame:
    """What lines say of the claims they make: evidence that is missing from every third, keywords on the first of an order."""
    n, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    told = line_relations(
        lines,
        (F.col("l_orderkey") * 8 + n).alias("pos"),
        F.when(n % 3 != 0, F.concat(F.lit("e"), key)).otherwise("").alias("evidence"),
        F.when(n == 1, F.concat(F.lit("k"), key)).alias("keywords"),
        F.concat(F.lit("T"), (F.col("l_orderkey") % 5).cast("string")).alias("article_title"),
        F.when((F.col("l_linestatus") == "O") & (n % 2 == 0), "stated").otherwise("attributed").alias("status"),
    )
    return lifecycle.sightings(told.drop("evidence_status").withColumnRenamed("status", "evidence_status"))


SEEN = """
  WITH seen AS (
    SELECT DISTINCT 'investor:' || l_suppkey % 10 AS src_id, 'startup:' || l_partkey % 4000 AS dst_id, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS run, 'u' || l_orderkey % 7 AS url, l_orderkey * 8 + l_linenumber AS pos,
           CASE WHEN l_linenumber % 3 <> 0 THEN 'e' || l_orderkey ELSE '' END AS evidence, CASE WHEN l_linenumber = 1 THEN 'k' || l_orderkey END AS keywords, 'T' || l_orderkey % 5 AS title, l_linestatus = 'O' AND l_linenumber % 2 = 0 AS stated
    FROM lineitem),
  placed AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY run, url, pos) AS t FROM seen)"""


@both(SEEN + """,
  marked AS (SELECT *, min(t) FILTER (stated) OVER (PARTITION BY src_id, dst_id) AS s FROM placed),
  titles AS (SELECT src_id, dst_id, string_agg(title, '|' ORDER BY t) AS article_titles FROM (SELECT src_id, dst_id, title, min(t) AS t FROM placed GROUP BY ALL) GROUP BY ALL)
  SELECT m.src_id, m.dst_id, CASE WHEN bool_or(stated) THEN 'stated' ELSE 'attributed' END AS evidence_status,
         coalesce(arg_max(evidence, t) FILTER (stated AND evidence <> ''), arg_max(evidence, t) FILTER (NOT stated AND evidence <> '' AND (s IS NULL OR t < s)), arg_min(evidence, t) FILTER (NOT stated AND evidence <> '' AND t > s)) AS evidence,
         arg_max(keywords, t) FILTER (keywords IS NOT NULL) AS keywords, any_value(article_titles) AS article_titles
  FROM marked m JOIN titles ON m.src_id = titles.src_id AND m.dst_id = titles.dst_id GROUP BY m.src_id, m.dst_id""")
@table("lineitem")
def g4_claim_evidence(lines: DataFrame) -> DataFrame:
    return joined_lists(lifecycle.evidence(line_sightings(lines)).drop("rel_type"))


@both(SEEN + """,
  runs AS (SELECT DISTINCT url, run FROM seen)
  SELECT src_id, dst_id, run::BIGINT AS run, 'asserted' AS event, url AS article_url, count(*) AS n FROM seen GROUP BY ALL
  UNION ALL SELECT src_id, dst_id, 2, 'not_reproduced', url, 1 FROM (SELECT src_id, dst_id, url, max(run) AS last FROM seen GROUP BY ALL) s WHERE last = 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.url = s.url AND r.run = 2)""")
@table("lineitem")
def g9_claim_history(lines: DataFrame) -> DataFrame:
    seen = line_sightings(lines)
    made = seen.select("run", "url", *lifecycle.KEYS).distinct()
    past = lifecycle.history(seen, lifecycle.support(lifecycle.article_events(made)))
    return past.groupBy("src_id", "dst_id", "run", "event", "article_url").agg(F.count("*").alias("n"))


@both(SEEN + """,
  one AS (SELECT * FROM placed WHERE src_id = 'investor:3'),
  runs AS (SELECT DISTINCT url, run FROM seen),
  lost AS (SELECT dst_id, count(*) AS n FROM (SELECT dst_id, url, max(run) AS last FROM one GROUP BY ALL) s WHERE last = 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.url = s.url AND r.run = 2) GROUP BY dst_id),
  urls AS (SELECT dst_id, count(DISTINCT url) AS n FROM one GROUP BY dst_id),
  newest AS (SELECT dst_id, arg_max(coalesce(evidence, ''), (run, -pos)) FILTER (evidence <> '') AS shown FROM one GROUP BY dst_id)
  SELECT 'INVESTED_IN' AS relationship, 'outgoing' AS direction, o.dst_id AS counterparty_id, CASE WHEN coalesce(l.n, 0) = u.n THEN 'unsupported_by_latest_source_processing' ELSE 'supported' END AS lifecycle_status,
         CASE WHEN coalesce(l.n, 0) = u.n THEN u.n ELSE u.n - coalesce(l.n, 0) END AS active_support_count, count(*) + any_value(coalesce(l.n, 0)) AS n_assertions, any_value(shown) AS primary_evidence
  FROM one o JOIN urls u ON o.dst_id = u.dst_id LEFT JOIN lost l ON o.dst_id = l.dst_id JOIN newest w ON o.dst_id = w.dst_id GROUP BY o.dst_id, l.n, u.n""")
@table("lineitem")
def q7_claim_payload(lines: DataFrame) -> DataFrame:
    """The claims of an investor with their histories; a run's number stands for the time at which it came."""
    seen = line_sightings(lines)
    events = lifecycle.article_events(seen.select("run", "url", *lifecycle.KEYS).distinct())
    past = lifecycle.history(seen, lifecycle.support(events)).withColumn("processed_at", F.col("run"))
    articles = lines.sparkSession.createDataFrame([], "url string, article_id string, source_name string, published_at timestamp, trace_id string")
    reviews = lines.sparkSession.createDataFrame([], "src_id string, rel_type string, dst_id string, run long, decision string, comment string, reviewer string")
    shown = claims.payload("investor:3", lifecycle.fold(events), past, reviews, articles)
    return shown.select("relationship", "direction", "counterparty_id", "lifecycle_status", "active_support_count", F.size("assertions").cast("long").alias("n_assertions"), F.nullif("primary_assertion.evidence", F.lit("")).alias("primary_evidence"))


@both("""
  WITH reg AS (SELECT lower(p_name) AS key, max('startup:' || p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
  said AS (SELECT o_orderkey, lower(p_name) AS key, CASE WHEN o_orderkey % 2 = 0 THEN p_name ELSE p_name || ' GmbH' END AS name FROM orders JOIN part ON o_orderkey % 500 = p_partkey),
  placed AS (SELECT *, row_number() OVER w AS n, first_value(name) OVER w AS first FROM said WINDOW w AS (PARTITION BY key ORDER BY o_orderkey))
  SELECT o_orderkey AS cand_id, coalesce(reg.id, 'startup:' || trim(regexp_replace(lower(first), '[^a-z0-9]+', '-', 'g'), '-')) AS entity_id, CASE WHEN reg.id IS NULL AND n = 1 THEN 'new' ELSE 'exact' END AS method
  FROM placed LEFT JOIN reg ON placed.key = reg.key""")
@graph
def r15_r16_resolution_in_order(g: Graph) -> DataFrame:
    """Orders as mentions of parts, one after the other; every third part is known before."""
    part = g.table("part")
    own = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("startup:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Startup").alias("label"), F.col("p_name").alias("name"), F.col("p_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    named = g.table("orders").join(part.select("p_partkey", "p_name"), F.col("o_orderkey") % 500 == F.col("p_partkey"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" GmbH")))
    cands = named.select(F.col("o_orderkey").alias("cand_id"), F.col("o_orderkey").alias("seq"), F.lit("Startup").alias("entity_type"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))
    return ordered.resolve_in_order(cands, resolve.registry(own, normalize.key_column), normalize.key_column).select("cand_id", "entity_id", "method")


@both("""
  WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT q.vec_id AS cand_id, e.vec_id AS entity_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS c FROM q JOIN embeddings e ON q.label = e.label),
  r AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY c DESC, entity_id) AS place FROM s)
  SELECT cand_id, entity_id, place::INT AS place, round(c, 6) AS cosine FROM r WHERE place <= 10""")
@table("embeddings")
def j10_nearest_of_a_kind(rows: DataFrame) -> DataFrame:
    """The ten nearest vectors of the same label, for the stated query set."""
    kind = F.col("label").cast("string").alias("entity_type")
    cells = vectors.placed_in_cells(rows.select(kind, F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vector")))
    asked = rows.where("vec_id % 50 = 0").select(kind, F.col("vec_id").alias("cand_id"), F.col("embedding").alias("vector"))
    return vectors.k_nearest(asked, cells, 10).select("cand_id", "entity_id", "place", F.round("cosine", 6).alias("cosine"))


@both("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6 OFFSET 12")
@table("orders")
def o6_page(orders: DataFrame) -> DataFrame:
    return page(orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@both("""SELECT p_partkey AS article_id, '{"startups":[{"name":"' || p_name || '","evidence_status":"' || CASE p_size % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'attributed' ELSE 'unsure' END || '","description":"' || p_type || '"}],"investors":[],"people":[],"topics":[{"name":"' || p_brand
         || '","evidence_status":"stated","description":"brand"}],"companies":[],"relationships":[{"rel_type":"HAS_TOPIC","source_name":"' || p_name || '","source_type":"Startup","target_name":"' || p_brand || '","target_type":"Topic","evidence_status":"unsure","evidence":"made by"}]}' AS raw_extraction, 3::BIGINT AS items FROM part""")
@table("part")
def g18_a20_snapshot(part: DataFrame) -> DataFrame:
    shots = extract.snapshot(*extract.typed(extract.parse(outputs(part))))
    return shots.select("article_id", "raw_extraction", extract.snapshot_items(F.col("raw_extraction")).alias("items"))


@both(GRAPH + """
      , d AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id),
      c AS (SELECT n.id FROM nodes n LEFT JOIN d ON n.id = d.id WHERE label NOT IN ('Article', 'Source') AND (lower(name) LIKE '%small ring%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%small ring%')) > 0)
            ORDER BY CASE WHEN lower(name) = 'small ring' THEN 4 WHEN list_contains(list_transform(aliases, lambda a: lower(a)), 'small ring') THEN 2 ELSE 1 END DESC, coalesce(d.n, 0) DESC, lower(name), n.id LIMIT 1),
      one AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM c)), two AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM one)),
      near AS (SELECT id, min(h) AS hops FROM (SELECT id, 0 AS h FROM c UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY id),
      ranked AS (SELECT n.id, hops, row_number() OVER (PARTITION BY hops = 0 ORDER BY hops, lower(coalesce(n.name, n.title, n.id)), n.id) AS r FROM near JOIN nodes n ON n.id = near.id),
      kept AS (SELECT id FROM ranked WHERE hops = 0 OR r <= 40)
      SELECT src_id, rel_type, dst_id FROM edges WHERE src_id IN (SELECT id FROM kept) AND dst_id IN (SELECT id FROM kept) AND coalesce(review_status, 'unreviewed') <> 'rejected'""")
@graph
def q9_entity_graph_by_name(g: Graph) -> DataFrame:
    return subgraph.entity_graph(g, "small ring", 40)[1].select("src_id", "rel_type", "dst_id")


@both(GRAPH + "SELECT id, count(*) AS degree FROM (SELECT a AS id FROM ways) GROUP BY id")
@graph
def a6_raw_degree(g: Graph) -> DataFrame:
    from claimloom.sources.graph import undirected

    return undirected(g.edges()).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


@both("SELECT l_partkey, CASE max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END) WHEN 2 THEN 'stated' WHEN 1 THEN 'attributed' ELSE 'unsure' END AS strongest FROM lineitem GROUP BY 1")
@table("lineitem")
def a16_strongest_evidence(lines: DataFrame) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", EVIDENCE[2]).when(F.col("l_returnflag") == "N", EVIDENCE[1]).otherwise(EVIDENCE[0])
    return lines.groupBy("l_partkey").agg(F.max_by(status, evidence_rank(status)).alias("strongest"))


@both("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN count(DISTINCT l_suppkey) FILTER (l_linestatus = 'O') ELSE count(DISTINCT l_suppkey) END AS supports FROM lineitem GROUP BY 1")
@table("lineitem")
def a18_support_count(lines: DataFrame) -> DataFrame:
    url = F.col("l_suppkey").cast("string")
    grouped = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linestatus") == "O", url)).alias("active"), F.collect_set(url).alias("all"))
    return grouped.select("l_orderkey", claims.support_count(F.col("active"), F.col("all")).alias("supports"))


@both("SELECT coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS prompt_tokens, coalesce(sum(l_linenumber), 0)::BIGINT AS completion_tokens, round(avg(l_linenumber), 4) AS avg_attempts FROM lineitem")
@table("lineitem")
def a17_m8_usage(lines: DataFrame) -> DataFrame:
    return metrics.usage(lines.select(F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens"), F.col("l_linenumber").alias("attempts")))


@both("SELECT round(count(*) FILTER (l_returnflag <> 'R') / count(*), 4) AS entity_admission, round(count(*) FILTER (l_linestatus = 'O') / count(*), 4) AS relation_admission FROM lineitem")
@table("lineitem")
def m3_admission(lines: DataFrame) -> DataFrame:
    one = lines.select(F.when(F.col("l_returnflag") == "R", "unsure").otherwise("stated").alias("evidence_status"))
    two = lines.select(F.when(F.col("l_linestatus") == "O", "attributed").otherwise("unsure").alias("evidence_status"))
    return metrics.admission(one, two)


@both("SELECT o_orderkey AS article_id, o_orderstatus <> 'P' AS schema_valid, o_custkey % 5 <> 0 AS no_unsure_admitted, o_custkey % 7 > 0 AS not_empty, o_totalprice <= 30000 AS fast_enough FROM orders")
@table("orders")
def m6_scores(orders: DataFrame) -> DataFrame:
    return metrics.scores(orders.select(F.col("o_orderkey").alias("article_id"), (F.col("o_orderstatus") != "P").alias("schema_valid"), F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("admitted_unsure"), (F.col("o_custkey") % 7).alias("entity_count"), F.col("o_totalprice").alias("latency_ms")))


@both("SELECT p_name AS name, 'startup:' || p_partkey AS entity_id, (p_size + p_partkey / 1000000)::DOUBLE AS similarity FROM part WHERE p_size % 2 = 0 ORDER BY similarity, name, entity_id LIMIT 10")
@table("part")
def a14_weakest_merges(part: DataFrame) -> DataFrame:
    outcomes = part.select(F.col("p_name").alias("name"), F.concat(F.lit("startup:"), F.col("p_partkey").cast("string")).alias("entity_id"), (F.col("p_size") + F.col("p_partkey") / 1000000).alias("similarity"), F.when(F.col("p_size") % 2 == 0, "fuzzy").otherwise("new").alias("method"))
    return metrics.weakest_merges(outcomes)


@both("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_partkey::VARCHAR) FILTER (l_linenumber <= 2), list(l_partkey::VARCHAR) FILTER (l_linenumber > 2)))), '|') AS joined, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR) FILTER (l_linenumber > 2)), '|') AS rest FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber <= 2) > 0 AND count(*) FILTER (l_linenumber > 2) > 0")
@table("lineitem")
def o15_o16_array_sets(lines: DataFrame) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    grouped = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") <= 2, key)).alias("a"), F.collect_list(F.when(F.col("l_linenumber") > 2, key)).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return grouped.select("l_orderkey", F.array_join(F.array_sort(F.array_union("a", "b")), "|").alias("joined"), F.array_join(F.array_sort(F.array_distinct("b")), "|").alias("rest"))


@both("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'O' THEN 'Reset to unreviewed' ELSE 'Rejected' END AS decision, o_orderstatus <> 'F' AS may_accept, o_orderstatus <> 'P' AS may_reject, o_orderstatus <> 'O' AS may_reset FROM orders")
@table("orders")
def o19_allowed_actions(orders: DataFrame) -> DataFrame:
    review = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "unreviewed").otherwise("rejected")
    a, b, c = claims.allowed_actions(review)
    return orders.select("o_orderkey", present.decision_label(review).alias("decision"), a.alias("may_accept"), b.alias("may_reject"), c.alias("may_reset"))


@both("""SELECT o_orderkey, coalesce(arg_min(l_comment, l_linenumber) FILTER (l_returnflag = 'A' AND l_comment <> ''), arg_min(l_comment, l_linenumber) FILTER (l_returnflag = 'A'), arg_min(l_comment, l_linenumber)) AS evidence
      FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'p' || l_partkey END AS l_comment, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) ON o_orderkey = l_orderkey AND r = 1 GROUP BY 1""")
@table("lineitem")
def o12_primary_assertion(lines: DataFrame) -> DataFrame:
    evidence = F.when(F.col("l_partkey") % 2 == 0, "").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "asserted").otherwise("processed").alias("event"), evidence.alias("evidence"))).alias("x"))
    gathered = one.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))), lambda y: F.struct(y["x"]["event"].alias("event"), y["x"]["evidence"].alias("evidence"))).alias("a"))
    return gathered.select("o_orderkey", claims.primary_assertion(F.col("a"))["evidence"].alias("evidence"))


@both(GRAPH + ", d AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id) SELECT n.id, round(CASE label WHEN 'Startup' THEN 9.2 WHEN 'Investor' THEN 8.5 WHEN 'Company' THEN 8.2 WHEN 'Article' THEN 7.0 ELSE 6.8 END + least(8.0, 0.62 * coalesce(d.n, 0)), 4) AS radius FROM nodes n LEFT JOIN d ON n.id = d.id")
@graph
def q20_node_radius(g: Graph) -> DataFrame:
    return subgraph.importance(g.nodes(), g.edges()).select("id", F.round(subgraph.radius(F.col("label"), F.col("degree")), 4).alias("radius"))


@both(GRAPH + "SELECT src_id, rel_type, dst_id, CASE WHEN review_status = 'needs_review' THEN 'review' WHEN lifecycle_status <> 'supported' THEN 'changed' END AS marker FROM edges WHERE rel_type = 'ACQUIRED'")
@graph
def q19_link_marker(g: Graph) -> DataFrame:
    return g.edges("ACQUIRED").select(*EDGE, subgraph.marker(F.col("review_status"), F.col("lifecycle_status") != "supported").alias("marker"))


@both("SELECT p_partkey, trim(p_name) AS title, 'Open to focus graph on this signal' AS subtitle, p_size || ' investments' AS metric, CASE WHEN p_retailprice >= 100 THEN floor(p_retailprice + 0.5)::BIGINT::VARCHAR ELSE printf('%.2f', p_retailprice) END AS score, CASE WHEN length(p_type) <= 9 THEN p_type ELSE substr(p_type, 1, 6) || '...' END AS clipped FROM part")
@table("part")
def p13_f12_f30_insight_text(part: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return part.select("p_partkey", present.insight_title(F.col("p_name"), none, none, F.lit(1)).alias("title"), present.insight_subtitle(F.array().cast("array<string>"), none, none).alias("subtitle"), present.insight_metric(mentions=F.lit(None).cast("long"), investments=F.col("p_size")).alias("metric"), present.score_text(F.col("p_retailprice")).alias("score"), extract.clip(F.col("p_type"), 9).alias("clipped"))


@both(GRAPH + "SELECT DISTINCT rel_type, array_to_string(list_transform(string_split(lower(rel_type), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM edges")
@graph
def f28_relation_label(g: Graph) -> DataFrame:
    return g.edges().select("rel_type").distinct().withColumn("label", present.relation_label(F.col("rel_type")))


@both("SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 'Stated' WHEN 'N' THEN 'Attributed' ELSE 'Unsure - not written to graph' END AS evidence, CASE l_returnflag WHEN 'A' THEN 'Not reproduced' WHEN 'N' THEN 'Direction changed' ELSE 'Asserted' END AS event, count(*) AS n FROM lineitem GROUP BY 1")
@table("lineitem")
def f33_labels(lines: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "stated").when(flag == "N", "attributed").otherwise("unsure")
    event = F.when(flag == "A", "not_reproduced").when(flag == "N", "direction_changed").otherwise("asserted")
    return lines.groupBy(flag.alias("flag"), present.evidence_label(status).alias("evidence"), present.event_label(event).alias("event")).agg(F.count("*").alias("n"))


@both("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS day, CASE o_orderstatus WHEN 'F' THEN 'Order ' || o_orderkey || ' appears in 3 graph links.' ELSE 'Order ' || o_orderkey || ' connects to 3 nearby graph signals.' END AS synopsis, 'http://t/#/experiments/1/traces/' || o_orderkey AS trace FROM orders")
@table("orders")
def f32_f35_synopsis(orders: DataFrame) -> DataFrame:
    name = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "Startup").otherwise("Article")
    return orders.select("o_orderkey", present.date_text(F.col("o_orderdate")).alias("day"), present.synopsis(kind, name, F.lit(3), F.lit(2)).alias("synopsis"), present.trace_url(F.lit("http://t/"), F.lit(None).cast("string"), F.col("o_orderkey").cast("string")).alias("trace"))


@both("SELECT doc_id, substr(text, 1, 14000) AS body, lang || ', ' || source AS tags FROM documents")
@table("documents")
def f27_prompt(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", present.prompt_text(F.col("text")).alias("body"), present.prompt_tags(F.array("lang", "source")).alias("tags"))


@both("SELECT l_orderkey % 50 AS article, 'parts=[' || array_to_string(list_slice(list_sort(list(DISTINCT l_partkey::VARCHAR)), 1, 5), ', ') || CASE WHEN count(DISTINCT l_partkey) > 5 THEN ' +' || (count(DISTINCT l_partkey) - 5) || ' more' ELSE '' END || ']' AS summary FROM lineitem GROUP BY 1")
@table("lineitem")
def f37_group_summary(lines: DataFrame) -> DataFrame:
    grouped = lines.groupBy((F.col("l_orderkey") % 50).alias("article")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("names"))
    return grouped.select("article", present.group_text("parts", F.col("names")).alias("summary"))


@both("SELECT p_partkey, array_to_string(list_distinct([lower(p_name), replace(lower(p_name), '-', ' ')]), '|') AS variants FROM part")
@table("part")
def f5_name_variants(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", F.array_join(normalize.variants_column(F.col("p_name")), "|").alias("variants"))


@both("""WITH m AS (SELECT 'article:' || l_orderkey AS a, 'startup:' || l_partkey AS e, l_returnflag AS f FROM lineitem)
      SELECT a AS src_id, 'MENTIONS' AS rel_type, e AS dst_id, CASE WHEN max(CASE f WHEN 'A' THEN 1 ELSE 0 END) = 1 THEN 'stated' ELSE 'attributed' END AS evidence_status FROM m WHERE f <> 'R' GROUP BY 1, 3""")
@table("lineitem")
def g6_article_edges(lines: DataFrame) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "stated").when(F.col("l_returnflag") == "N", "attributed").otherwise("unsure")
    rows = lines.select(F.concat(F.lit("article:"), F.col("l_orderkey").cast("string")).alias("article_id"), F.concat(F.lit("startup:"), F.col("l_partkey").cast("string")).alias("entity_id"), F.lit("Startup").alias("entity_type"), status.alias("evidence_status"), F.col("l_linenumber").alias("seq"))
    one = lifecycle.merged_evidence(rows, ["article_id", "entity_id", "entity_type"], "seq")
    return lifecycle.article_edges(one.withColumn("description", F.lit("")).withColumn("evidence", F.lit(""))).drop("evidence")


@both("SELECT 'source:' || o_orderpriority AS id, arg_max(o_custkey, o_orderkey) AS last_customer FROM orders GROUP BY 1")
@table("orders")
def g1_latest_source(orders: DataFrame) -> DataFrame:
    rows = orders.select(F.concat(F.lit("source:"), F.col("o_orderpriority")).alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("last_customer"))
    return lifecycle.latest(rows, ["id"], "seq").drop("seq")


@both("SELECT l_partkey AS id, arg_max(l_suppkey::VARCHAR, l_orderkey * 10 + l_linenumber) AS name, CASE WHEN max(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) = 1 THEN 'stated' ELSE 'attributed' END AS evidence_status FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey DESC) AS r FROM lineitem WHERE l_returnflag <> 'R') WHERE r = 1 GROUP BY 1")
@table("lineitem")
def g3_entity_upsert(lines: DataFrame) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "stated").when(F.col("l_returnflag") == "N", "attributed").otherwise("unsure")
    rows = lines.where("l_returnflag <> 'R'").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max(F.struct("l_suppkey", "l_returnflag")).alias("m")).select("l_partkey", "l_orderkey", "l_linenumber", "m.*")
    new = rows.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("name"), F.array().cast("array<string>").alias("aliases"), status.alias("evidence_status"), F.lit("").alias("description"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return lifecycle.upserted(new.drop("seq").limit(0), new, ["id"], "seq").select("id", "name", "evidence_status")


@both("""WITH m AS (SELECT l_orderkey AS a, l_partkey AS e, l_partkey % 5 = 0 AS t FROM lineitem WHERE l_returnflag <> 'R')
      SELECT a AS article_id, count(DISTINCT e) AS entities, count(DISTINCT e) AS links, 0::BIGINT AS claims, 3 + 2 * count(DISTINCT e) AS operations FROM m GROUP BY 1""")
@table("lineitem")
def g16_operation_count(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("entity_id"), F.when(F.col("l_partkey") % 5 == 0, "Topic").otherwise("Startup").alias("entity_type"), F.when(F.col("l_returnflag") == "R", "unsure").otherwise("stated").alias("evidence_status"))
    return lifecycle.operations(rows, rows.select("article_id").limit(0))


@both("SELECT article_id, k AS name FROM (SELECT l_orderkey AS article_id, 'topic ' || l_suppkey % 4 AS k, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1")
@table("lineitem")
def r1_topic_dedupe(lines: DataFrame) -> DataFrame:
    topic = F.concat(F.lit("topic "), (F.col("l_suppkey") % 4).cast("string"))
    rows = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pos"), F.lit("Topic").alias("entity_type"), topic.alias("name"), topic.alias("key"))
    return extract.deduplicated_topics(rows, "key").select("article_id", "name")


@both("SELECT DISTINCT l_orderkey AS article_id, 'supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS name, 'Investor' AS entity_type FROM lineitem WHERE l_returnflag <> 'R'")
@table("lineitem")
def r2_endpoints(lines: DataFrame) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "unsure").otherwise("stated")
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    mentions = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pos"), F.lit("Startup").alias("entity_type"), part.alias("name"), F.lit("stated").alias("evidence_status"), F.lit(False).alias("evidence_status_defaulted"), F.lit("").alias("description"))
    relations = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pos"), F.format_string("supplier#%09d", "l_suppkey").alias("source_name"), F.lit("Investor").alias("source_type"), part.alias("target_name"), F.lit("Startup").alias("target_type"), status.alias("evidence_status"), F.lit("").alias("evidence"))
    made = extract.with_endpoints(mentions, relations, lambda n, t: F.lower(n)).where("materialised")
    return made.select("article_id", "name", "entity_type")


@both("WITH r AS (SELECT DISTINCT l_orderkey AS o, 'i' || l_suppkey AS i, 's' || l_partkey AS s FROM lineitem WHERE l_returnflag <> 'R') SELECT o AS article_id, i AS k, array_to_string(list_sort(list(DISTINCT 'Startup:' || s)), '|') AS neighbours FROM r GROUP BY 1, 2")
@table("lineitem")
def r3_neighbour_keys(lines: DataFrame) -> DataFrame:
    relations = lines.select(F.col("l_orderkey").alias("article_id"), F.concat(F.lit("i"), F.col("l_suppkey").cast("string")).alias("source_name"), F.lit("Investor").alias("source_type"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("target_name"), F.lit("Startup").alias("target_type"), F.when(F.col("l_returnflag") == "R", "unsure").otherwise("stated").alias("evidence_status"))
    return extract.neighbour_keys(relations, lambda n, t: n).where("entity_type = 'Investor'").select("article_id", "k", F.array_join("neighbours", "|").alias("neighbours"))


@both("SELECT DISTINCT a.l_orderkey * 10 + a.l_linenumber AS cand_id, 'e' || b.l_partkey AS entity_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey")
@table("lineitem")
def r4_blocked_by_neighbours(lines: DataFrame) -> DataFrame:
    """A line's part may not merge into that of the next line. The candidate is the line, keyed apart from other lines of its part."""
    line = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))
    own = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("n"), "l_partkey", line.alias("key"))
    after = own.select(F.col("article_id").alias("a"), (F.col("n") - 1).alias("m"), F.col("l_partkey").alias("next"))
    pairs = own.join(after, (F.col("article_id") == F.col("a")) & (F.col("n") == F.col("m")) & (F.col("l_partkey") != F.col("next")))
    relations = pairs.select("article_id", F.col("key").alias("source_name"), F.lit("Startup").alias("source_type"), F.concat(F.lit("p"), F.col("next").cast("string")).alias("target_name"), F.lit("Startup").alias("target_type"), F.lit("stated").alias("evidence_status"))
    near = extract.neighbour_keys(relations, lambda n, t: n)
    cands = own.select((F.col("article_id") * 10 + F.col("n")).alias("cand_id"), "article_id", F.lit("Startup").alias("entity_type"), "key")
    index = lines.select(F.lit("Startup").alias("entity_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("key"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("entity_id")).distinct()
    return resolve.blocked_by_neighbours(cands, near, index)


@both("""WITH o AS (SELECT * FROM orders)
      SELECT o_orderkey, 0 AS place, 'amount' AS property, format('{:,}', floor(o_totalprice + 0.5)::BIGINT) || ' EUR' AS value FROM o
      UNION ALL SELECT o_orderkey, 1, 'published_at', strftime(o_orderdate, '%d %b %Y') FROM o
      UNION ALL SELECT o_orderkey, 2, 'evidence_status', CASE o_orderstatus WHEN 'F' THEN 'Stated' ELSE 'Attributed' END FROM o WHERE o_orderstatus IN ('F', 'O')
      UNION ALL SELECT o_orderkey, 3, 'source_name', o_orderpriority FROM o""")
@table("orders")
def f36_property_rows(orders: DataFrame) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "stated").when(F.col("o_orderstatus") == "O", "attributed").otherwise("")
    nodes = orders.select("o_orderkey", F.col("o_orderpriority").alias("source_name"), F.nullif(status, F.lit("")).alias("evidence_status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("string").alias("published_at"), F.lit("").alias("url"), F.lit("x").alias("another"))
    return present.property_rows(nodes, "o_orderkey")


@both("""SELECT doc_id, place, property, value FROM (
      SELECT doc_id, 0 AS place, 'source_name' AS property, source AS value FROM documents
      UNION ALL SELECT doc_id, 1, 'text', CASE WHEN length(trim(text, ' ')) > 0 THEN format('{:,}', length(text)) || ' characters' END FROM documents
      UNION ALL SELECT doc_id, 2, 'doc_id', format('{:,}', doc_id) FROM documents UNION ALL SELECT doc_id, 3, 'lang', lang FROM documents) WHERE value <> ''""")
@table("documents")
def f36_article_rows(documents: DataFrame) -> DataFrame:
    articles = documents.select("doc_id", "text", "lang", F.col("source").alias("source_name"), F.lit("{}").alias("trace_provenance"))
    return present.property_rows(articles, "doc_id", article=True)


@both("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN printf('%.3f', o_totalprice) ELSE printf('%.6f', (o_custkey % 9 + 1) / 1e6) END AS shown FROM orders")
@table("orders")
def f31_metric_text(orders: DataFrame) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise((F.col("o_custkey") % 9 + 1) / 1e6)
    return orders.select("o_orderkey", present.metric_text(value.cast("double")).alias("shown"))


@both("SELECT o_orderkey, coalesce(o_custkey, 0)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, (o_custkey * 2)::BIGINT AS total_tokens FROM orders WHERE o_orderstatus <> 'P'")
@table("orders")
def f40_call_usage(orders: DataFrame) -> DataFrame:
    told = lambda c: F.when(F.col("o_orderstatus") != "P", c)
    used = metrics.call_usage(told(F.col("o_custkey")), F.lit(None).cast("long"), told(F.col("o_custkey") * 2))
    return orders.select("o_orderkey", used.alias("u")).where("u IS NOT NULL").select("o_orderkey", "u.*")


@both("SELECT 2 AS gleaning_configured_passes, 1 AS gleaning_passes_run, count(*) FILTER (p_size % 3 = 0) AS total_changes, 0::BIGINT AS entities_added, count(*) FILTER (p_size % 3 = 0) AS entities_corrected, 0::BIGINT AS relationships_added, 0::BIGINT AS relationships_corrected, count(*) AS final_raw_entities, 0::BIGINT AS final_raw_relationships FROM part")
@table("part")
def f40_extraction_audit(part: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    facts = part.select(F.col("p_partkey").alias("article_id"), F.lit(0).alias("pos"), F.lit("entity").alias("kind"), F.lower("p_name").alias("name"), none.alias("source"), none.alias("target"), none.alias("rel_type"), F.lit("first").alias("description"), "p_size")
    second = facts.where("p_size % 3 = 0").withColumn("description", F.lit("second"))
    return extract.audit(facts, extract.gleaned(facts.drop("p_size"), second.drop("p_size")), configured_passes=2, passes_run=1)


@both("SELECT count(DISTINCT k) AS registry_size FROM (SELECT lower(p_name) AS k FROM part UNION ALL SELECT lower(p_type) FROM part) WHERE k <> ''")
@table("part")
def m15_registry_size(part: DataFrame) -> DataFrame:
    entities = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("Startup").alias("label"), F.col("p_name").alias("name"), F.lit("").alias("canonical_name"), F.array("p_type").alias("aliases"))
    return metrics.registry_size(resolve.registry(entities, lambda name, kind: F.lower(name)))


QUERIES = {name: f for name, (f, _) in BOTH.items()}
SQL = {name: sql for name, (_, sql) in BOTH.items()}
