"""Bounded subgraphs: around an entity, the landscape, the feed, what a client shows.

A subgraph is a pair of DataFrames, nodes and edges. Frontiers are deduplicated
per hop before they are joined again, so a hub is expanded once. Ids that edges
are asked for are broadcast if they are few, by count; such a semi-join goes
below the aggregations that make the edges, so only the asked ones are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.normalize import key as name_key
from claimloom.model import DOMAIN_RELATIONS, ENTITY_TYPES, FEED_RELATIONS, within
from claimloom.operators.components import durable
from claimloom.operators.ranking import ranked_within, side_by_side
from claimloom.plans.lookup import matches
from claimloom.sources.graph import Graph, undirected

#: How node types rank and how large they are drawn.
TYPE_PRIORITY = {"Startup": 62, "Investor": 58, "Company": 54, "Topic": 45, "Person": 38, "Article": 24, "Source": 20}
OTHER_PRIORITY = 18
EDGE_KEYS = ["src_id", "rel_type", "dst_id"]
#: Ids that are few enough to send to every task.
FEW = 100_000


def few(ids: DataFrame) -> bool:
    return ids.limit(FEW + 1).count() <= FEW


def sent_if_few(ids: DataFrame) -> DataFrame:
    """ids, kept, and marked for broadcast if there are FEW at most."""
    ids = durable(ids)
    return F.broadcast(ids) if few(ids) else ids


def at_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(near, far) for each end of an edge that is among ids (id)."""
    ids = ids.select(F.col("id").alias("end"))
    out = edges.join(ids, F.col("src_id") == F.col("end"), "left_semi").select(F.col("src_id").alias("near"), F.col("dst_id").alias("far"))
    return out.unionByName(edges.join(ids, F.col("dst_id") == F.col("end"), "left_semi").select(F.col("dst_id").alias("near"), F.col("src_id").alias("far")))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among ids (id)."""
    ids = ids.select(F.col("id").alias("end"))
    return edges.join(ids, F.col("src_id") == F.col("end"), "left_semi").join(ids, F.col("dst_id") == F.col("end"), "left_semi")


def public(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a response holds: each node once; no rejected edge, none with an end outside."""
    return nodes.dropDuplicates(["id"]), induced(edges.where(F.coalesce("review_status", F.lit("unreviewed")) != "rejected"), nodes).dropDuplicates(EDGE_KEYS)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at a node; a loop counts twice."""
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def startup_degrees(graph: Graph) -> DataFrame:
    """(id, degree) of startups: distinct domain edges at either end plus mentions by articles. An edge is one by its key."""
    domain = graph.edges(*DOMAIN_RELATIONS)
    own = F.array_distinct(F.array(*[F.when(F.col(f"{x}_label") == "Startup", F.col(f"{x}_id")) for x in ("src", "dst")]))
    ends = domain.select(F.explode(own).alias("id")).where("id is not null")
    mentions = graph.edges("MENTIONS").where("dst_label = 'Startup'").select(F.col("dst_id").alias("id"))
    counts = ends.unionByName(mentions).groupBy("id").agg(F.count("*").alias("degree"))
    ids = graph.nodes("Startup").select(F.col("id").alias("own"), "name")
    return ids.join(counts, F.col("own") == F.col("id"), "left").select(F.col("own").alias("id"), "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def center(graph: Graph, entity: str) -> str | None:
    """The best match's id: by kind of match, degree, name, id. One row comes to the driver."""
    needle = name_key(entity, "Startup")
    found = sent_if_few(matches(graph.nodes(*ENTITY_TYPES), needle))
    ends = at_ends(graph.edges(), found).groupBy("near").agg(F.count("*").alias("degree"))
    ranked = found.join(ends, F.col("id") == F.col("near"), "left")
    row = ranked.orderBy(F.desc("relevance"), F.desc(F.coalesce("degree", F.lit(0))), F.lower(F.coalesce("name", "canonical_name", "id")), "id").select("id").first()
    return row and row.id


def hops(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of all nodes within depth of start (id), start at 0. links: (src_id, dst_id), repeated or not."""
    ways = links.select(F.explode(F.array(F.struct(F.col("src_id").alias("near"), F.col("dst_id").alias("far")), F.struct(F.col("dst_id").alias("near"), F.col("src_id").alias("far")))).alias("way")).select("way.*")
    frontier = durable(start.select("id").distinct())
    seen = frontier.withColumn("hops", F.lit(0))
    for k in range(1, depth + 1):
        # few ids go below the joins that make the links, to either end; with many, the links are made once
        found = at_ends(links, F.broadcast(frontier)) if few(frontier) else ways.join(frontier, F.col("near") == F.col("id"), "left_semi")
        reached = found.select(F.col("far").alias("id")).distinct()
        frontier = durable(reached.join(seen.select(F.col("id").alias("old")), F.col("id") == F.col("old"), "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(k)))
    return seen


def entity_graph(graph: Graph, entity: str, limit: int = 120) -> tuple[DataFrame, DataFrame]:
    """The best match, its neighbours within two hops (nearest first, then by name, up to limit), and their edges."""
    within(limit, 10, 500, "limit")
    return around(graph, center(graph, entity), limit)


def around(graph: Graph, middle: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """entity_graph() of a node that is known by its id."""
    nodes, edges = graph.nodes(), graph.edges()
    start = graph.spark.createDataFrame([(middle,)] if middle else [], "id string")
    near = hops(graph.links(), start, 2).withColumnRenamed("id", "near")
    placed = durable(nodes.join(near, F.col("id") == F.col("near")).drop("near"))
    others = placed.where("hops > 0").orderBy("hops", F.lower(F.coalesce("name", "title", "id")), "id").limit(limit)
    return public(F.broadcast(durable(placed.where("hops = 0").unionByName(others))), edges)  # at most limit + 1 nodes


def landscape(graph: Graph, limit: int = 120) -> tuple[DataFrame, DataFrame]:
    """The best-connected startups with their partners, articles, sources and topics."""
    within(limit, 10, 500, "limit")
    top = startup_degrees(graph).orderBy(F.desc("degree"), F.asc_nulls_last("name"), "id").limit(limit).select(F.col("id").alias("top"))
    ids = [r.top for r in top.collect()]  # at most 500, so a filter that goes below the aggregations can name them
    top = graph.spark.createDataFrame([(x,) for x in ids], "top string")
    core = graph.edges(*DOMAIN_RELATIONS).where(F.col("src_id").isin(ids) | F.col("dst_id").isin(ids)).dropDuplicates(EDGE_KEYS)
    mentions = durable(graph.edges("MENTIONS").where(F.col("dst_id").isin(ids)))
    articles = sent_if_few(mentions.select(F.col("src_id").alias("article")).distinct())
    about = graph.edges("FROM_SOURCE", "HAS_TOPIC").where("src_label = 'Article'").join(articles, F.col("src_id") == F.col("article"), "left_semi")
    edges = durable(core.unionByName(mentions).unionByName(about))
    ids = sent_if_few(edges.select(F.explode(F.array("src_id", "dst_id")).alias("end")).unionByName(top.select(F.col("top").alias("end"))).distinct())
    return public(sent_if_few(graph.nodes().join(ids, F.col("id") == F.col("end"), "left_semi")), edges)


def feed(graph: Graph, limit: int = 120) -> tuple[DataFrame, DataFrame]:
    """The newest articles' edges (the limit counts edges; articles without a date come first) and their ends."""
    within(limit, 10, 500, "limit")
    articles = graph.nodes("Article").select(F.col("id").alias("article"), "published_at")
    edges = graph.edges(*FEED_RELATIONS).where("src_label = 'Article'").join(articles, F.col("src_id") == F.col("article"))
    edges = edges.orderBy(F.desc_nulls_first("published_at"), "src_id", "rel_type", "dst_id").limit(limit).drop("article", "published_at")
    edges = durable(edges)  # at most 500 rows
    ids = edges.select(F.explode(F.array("src_id", "dst_id")).alias("end")).distinct()
    return public(graph.nodes().join(F.broadcast(ids), F.col("id") == F.col("end"), "left_semi"), edges)


def graph_view(graph: Graph, entity: str | None = None, limit: int = 120, view: str = "landscape") -> tuple[DataFrame, DataFrame]:
    """Entity before feed before landscape."""
    if view not in ("landscape", "feed"):
        raise ValueError(f"view must be landscape or feed, not {view!r}")
    if entity:
        return entity_graph(graph, entity, limit)
    return feed(graph, limit) if view == "feed" else landscape(graph, limit)


def lens(nodes: DataFrame, edges: DataFrame, labels: list[str], relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """The subgraph of some labels and relations."""
    nodes = nodes.where(F.col("label").isin(*labels))
    return nodes, induced(edges.where(F.col("rel_type").isin(*relations)), nodes)


def priority(label: Column) -> Column:
    out = F.when(label == "Startup", TYPE_PRIORITY["Startup"])
    for name, value in list(TYPE_PRIORITY.items())[1:]:
        out = out.when(label == name, value)
    return out.otherwise(OTHER_PRIORITY)


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree, score = 2 degree + type priority, and shown, the label that ties go by."""
    counts = degrees(edges).withColumnRenamed("id", "end")
    joined = nodes.join(counts, F.col("id") == F.col("end"), "left").drop("end").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.withColumn("score", 2 * F.col("degree") + priority(F.col("label"))).withColumn("shown", F.coalesce("name", "title", "id"))


def most_important(nodes: DataFrame, edges: DataFrame, limit: int = 100, context: str | None = None) -> DataFrame:
    """The top nodes by score; with a context node, also that and its neighbours."""
    scored = importance(nodes, edges)
    top = scored.orderBy(F.desc("score"), "shown", "id").limit(limit)
    if context is None:
        return top
    ring = undirected(edges).where(F.col("a") == context).select(F.col("b").alias("end")).unionByName(edges.sparkSession.createDataFrame([(context,)], "end string")).distinct()
    return top.unionByName(scored.join(ring, F.col("id") == F.col("end"), "left_semi")).dropDuplicates(["id"])


def visible(nodes: DataFrame, edges: DataFrame, selected: str | None = None, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """What a client draws: around the selected node, else the most important ones if there are many; with radius and markers."""
    if selected is not None:
        if depth not in (1, 2, 3):
            raise ValueError(f"depth must be 1, 2 or 3, not {depth}")
        start = edges.sparkSession.createDataFrame([(selected,)], "id string")
        ids = hops(edges, start, depth).select(F.col("id").alias("end"))
        shown = importance(nodes, edges).join(ids, F.col("id") == F.col("end"), "left_semi")
    else:
        shown = most_important(nodes, edges, limit)
    inside = induced(edges, shown)
    return shown.withColumn("radius", radius(F.col("label"), F.col("degree"))), inside.withColumn("marker", marker(F.col("review_status"), F.col("support_changed") if "support_changed" in inside.columns else F.lit(False)))


def radius(label: Column, degree: Column) -> Column:
    base = F.when(label == "Startup", 9.2).when(label == "Investor", 8.5).when(label == "Company", 8.2).when(label == "Article", 7.0).otherwise(6.8)
    return base + F.least(F.lit(8.0), 0.62 * degree)


def marker(review: Column, changed: Column) -> Column:
    """review for claims that need it, changed for those whose support changed, else null."""
    return F.when(review == "needs_review", "review").when(changed, "changed")


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """(id) of a node and those next to it."""
    return undirected(edges).where(F.col("a") == node).select(F.explode(F.array("a", "b")).alias("id")).distinct()


def flow_layout(nodes: DataFrame, edges: DataFrame, height: float = 600.0, margin: float = 40.0) -> DataFrame:
    """A column per type, ordered by score and label; y = margin + height (i + 1) / (n + 1).

    Places are whole numbers per type; types are few and may be large, so the
    rank within a type is made from sorted runs, not in one task: rows are
    ranged by (label, score, shown, id), counted per range, and numbered by the
    counts of the ranges before.
    """
    scored = importance(nodes, edges).select("id", "label", "shown", "score")
    placed = ranked_within(scored, ["label"], [F.desc("score"), F.asc("shown"), F.asc("id")])
    return placed.select("id", "label", "score", F.col("place").alias("position"), (F.lit(margin) + F.lit(height) * F.col("place") / (F.col("total") + 1)).alias("y"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links per node; 0 with one node or none."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    return side_by_side(n, m).select("n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("density")) 


def highest_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return importance(nodes, edges).orderBy(F.desc("degree"), "id").limit(1).select("id", "degree")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Startups, and investors: Investor nodes and companies and people that invested."""
    backers = edges.where((F.col("rel_type") == "INVESTED_IN") & F.col("src_label").isin("Company", "Person")).select(F.col("src_id").alias("id"))
    investors = nodes.where("label = 'Investor'").select("id").unionByName(backers)
    return side_by_side(nodes.where("label = 'Startup'").agg(F.countDistinct("id").alias("startups")), investors.agg(F.countDistinct("id").alias("investors")))


def histogram(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
