"""Finding entities: search, profiles, listings, the node to focus on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.normalize import key as name_key
from claimloom.model import ENTITY_TYPES, checked_label, within
from claimloom.operators.components import durable
from claimloom.plans.search_index import found_by_terms
from claimloom.sources.graph import Graph

#: Neighbours that are few enough to send to every task.
FEW = 100_000


def matches(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name, canonical name or an alias contains the needle, with relevance: 4 equal name, 3 canonical, 2 alias, 1 part."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    hit = low("name").contains(needle) | low("canonical_name").contains(needle) | F.exists(aliases, lambda a: F.lower(a).contains(needle))
    rank = F.when(low("name") == needle, 4).when(low("canonical_name") == needle, 3).when(F.exists(aliases, lambda a: F.lower(a) == needle), 2).otherwise(1)
    return nodes.where(hit).withColumn("relevance", rank)


def beginning(term: str):
    return lambda word: word.startswith(term)


def searched(graph: Graph) -> DataFrame:
    """Entities as search reads them."""
    return graph.nodes(*ENTITY_TYPES).select("id", F.coalesce("name", "canonical_name").alias("name"), F.col("label").alias("type"), "aliases", "description", "canonical_name", F.col("name").alias("own_name"))


def search(graph: Graph, query: str, limit: int = 15, index: str | None = None) -> DataFrame:
    """Entities of which every term begins a word of name, canonical name, alias or description.

    score: over the terms, the number of fields with such a word. If none is
    found, entities whose names contain the query, at score 1. index: the folder
    of search_index.write_index(searched(graph)); with it only the postings of the
    terms are read, and the entities that they name.
    """
    within(limit, 1, 50, "limit")
    nodes = searched(graph) if index is None else graph.spark.read.parquet(f"{index}/shown")
    columns = ["id", "name", "type", "score", "aliases", "description"]
    if not query.strip():
        return nodes.withColumn("score", F.lit(0.0)).select(*columns).limit(0)
    terms = name_key(query, "Startup").split()
    if terms and index is not None:
        scored = found_by_terms(graph.spark, index, terms).withColumnRenamed("id", "hit")
        hits = nodes.join(scored, F.col("id") == F.col("hit")).orderBy(F.desc("score"), "name", "id").limit(limit).select(*columns)
        if not hits.isEmpty():
            return hits
    elif terms:
        fields = {"f1": F.col("own_name"), "f2": F.col("canonical_name"), "f3": F.concat_ws(" ", "aliases"), "f4": F.col("description")}
        words = nodes.select("*", *[F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+").alias(n) for n, c in fields.items()])
        found, total = F.lit(True), F.lit(0)
        for t in terms:
            each = [F.exists(F.col(n), beginning(t)).cast("int") for n in fields]
            some = each[0] + each[1] + each[2] + each[3]
            found, total = found & (some > 0), total + some
        hits = words.where(found).withColumn("score", total.cast("double")).orderBy(F.desc("score"), "name", "id").limit(limit).select(*columns)
        if not hits.isEmpty():
            return hits
    low = query.casefold()
    part = F.lower(F.coalesce("own_name", F.lit(""))).contains(low) | F.lower(F.coalesce("canonical_name", F.lit(""))).contains(low) | F.exists("aliases", lambda a: F.lower(a).contains(low))
    return nodes.where(part).withColumn("score", F.lit(1.0)).orderBy("name", "id").limit(limit).select(*columns)


def profile(graph: Graph, label: str, name: str, most: int = 50) -> DataFrame:
    """The best match of a label (by kind of match, then id) and up to `most` neighbours, one row for each, at least one."""
    checked_label(label)
    node = durable(matches(graph.nodes(label), name_key(name, label)).orderBy(F.desc("relevance"), "id").limit(1).select("id", "name", F.col("label").alias("type"), "description"))
    # one row; its id is named in the filters, which go below the aggregations that make edges
    center = (node.first() or [None])[0]
    edges = graph.edges()
    ends = lambda near, far: edges.where(F.col(near) == F.lit(center)).select(F.col(far).alias("b"), "rel_type")
    ways = durable(ends("src_id", "dst_id").unionByName(ends("dst_id", "src_id")).distinct())
    names = graph.nodes().select(F.col("id").alias("related_id"), F.coalesce("name", "title").alias("related_name"), F.col("label").alias("related_type"))
    few = ways.limit(FEW + 1).count() <= FEW
    related = names.join(F.broadcast(ways) if few else ways, F.col("b") == F.col("related_id")).orderBy("rel_type", "related_name", "related_id").limit(most)
    shown = related.select(F.lit(center).alias("center"), "related_id", "related_name", "related_type", F.col("rel_type").alias("relationship"))
    return durable(node.join(F.broadcast(shown), F.col("id") == F.col("center"), "left").drop("center"))  # most rows, asked for more than once


def investor_profile(graph: Graph, name: str) -> DataFrame:
    """The first of an Investor, a Company and a Person of that name; the latter two only if they invested."""
    for label in ("Investor", "Company", "Person"):
        found = profile(graph, label, name)
        wanted = found if label == "Investor" else found.where("relationship = 'INVESTED_IN'")
        if label == "Person" or not wanted.isEmpty():
            return found if label != "Person" else found.join(F.broadcast(wanted.select(F.col("id").alias("own")).distinct()), F.col("id") == F.col("own"), "left_semi")
    return found


def listing(graph: Graph, label: str, most: int = 50_000) -> DataFrame:
    """The entities of a label, by id, up to the registry's cap."""
    return graph.nodes(checked_label(label)).orderBy("id").limit(most).select("id", "label", "name", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "description")


def focus(nodes: DataFrame, entity: str) -> DataFrame:
    """The node that is meant: equal id, name or alias before a part of one; then by id."""
    low = entity.strip().lower()
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("id", "name", "title", "canonical_name")]
    equal, part = F.exists("aliases", lambda a: F.lower(a) == low), F.exists("aliases", lambda a: F.lower(a).contains(low))
    for f in fields:
        equal, part = equal | (f == low), part | f.contains(low)
    return nodes.where(part | equal).withColumn("rank", F.when(equal, 1).otherwise(2)).orderBy("rank", "id").limit(1).select("id", "label", F.coalesce("name", "title").alias("name"), "rank")
