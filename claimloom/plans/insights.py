"""The four insight queries over nodes and edges.

Nulls in orders stand as the graph database has them: last when ascending,
first when descending. Example lists are sorted before they are cut, so that
they are the same on every run.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.model import admitted, insightful, within
from claimloom.operators.components import durable, kept
from claimloom.operators.ranking import few_per
from claimloom.sources.graph import Graph

BACKERS = ("Investor", "Company", "Person")


def counted(edges: DataFrame) -> DataFrame:
    return edges.where(insightful(F.col("lifecycle_status"), F.col("review_status")))


def trending_startups(graph: Graph, as_of: datetime | None = None, days: int = 30, limit: int = 10) -> DataFrame:
    """Startups by the articles that mention them within `days` before as_of (default: the latest article)."""
    within(days, 1, 365, "days"), within(limit, 1, 50, "limit")
    articles = graph.nodes("Article").select(F.col("id").alias("article"), "title", "published_at")
    if as_of is None:
        as_of = graph.table("orders").agg(F.max("o_orderdate")).first()[0]
    recent = articles.where(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    mentions = graph.mentions_by(recent.select(F.col("article").alias("id"))).where(admitted(F.coalesce("evidence_status", F.lit("stated")))).select("src_id", "dst_id")
    seen = mentions.join(recent, F.col("src_id") == F.col("article")).select("dst_id", "title", "published_at")
    counts = seen.groupBy("dst_id").agg(F.count("*").alias("mentions"), F.max("published_at").alias("last"))  # an article mentions a startup once
    order = [F.desc_nulls_first("mentions"), F.desc_nulls_first("last"), F.asc_nulls_last("name"), F.asc("id")]
    top = graph.nodes("Startup").select("id", "name").join(counts, F.col("id") == F.col("dst_id")).drop("dst_id").orderBy(*order).limit(limit)
    top = durable(top)  # a few rows, used twice
    shown = few_per(seen.join(F.broadcast(top.select(F.col("id").alias("top_id"))), F.col("dst_id") == F.col("top_id")), "top_id", "title", 5, "articles")
    return top.join(shown, F.col("id") == F.col("top_id")).orderBy(*order).select("id", "name", "mentions", "articles", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def top_investors(graph: Graph, limit: int = 10) -> DataFrame:
    within(limit, 1, 50, "limit")
    deals = counted(graph.edges("INVESTED_IN")).where(F.col("src_label").isin(*BACKERS) & (F.col("dst_label") == "Startup"))
    # ranked on keys alone: names and examples are fetched for the few rows that are left
    names = graph.nodes(*BACKERS).select("id", "name", F.col("label").alias("type"))
    counts = deals.groupBy("src_id").agg(F.countDistinct("dst_id").alias("investments"))
    top = names.join(counts, F.col("id") == F.col("src_id")).orderBy(F.desc("investments"), F.asc_nulls_last("name"), "id").limit(limit).drop("src_id")
    top = durable(top)  # a few rows, used twice
    startups = graph.nodes("Startup").select(F.col("id").alias("startup"), F.col("name").alias("startup_name"))
    shown = deals.join(F.broadcast(top.select(F.col("id").alias("top_id"))), F.col("src_id") == F.col("top_id")).join(startups, F.col("dst_id") == F.col("startup"))
    shown = few_per(shown, "top_id", "startup_name", 5, "examples")
    return top.join(shown, F.col("id") == F.col("top_id")).select("id", "name", "type", "investments", "examples").orderBy(F.desc("investments"), F.asc_nulls_last("name"), "id")


#: Investors that the bound is found with, and those of a startup that are compared in one go.
LEADERS, TOGETHER = 256, 1000
#: Pairs of investors, one for each startup that both are in, that a task makes.
PAIRS_A_TASK = 1_000_000


def least_shared(deals: DataFrame, limit: int) -> int:
    """A number that the pair in the last shown place shares at least: what it is among the investors with most deals alone."""
    degrees = deals.groupBy("src_id").agg(F.count("*").alias("n"))
    leaders = degrees.orderBy(F.desc("n"), "src_id").limit(LEADERS).select(F.col("src_id").alias("leader"))
    own = durable(deals.join(F.broadcast(leaders), F.col("src_id") == F.col("leader"), "left_semi"))  # LEADERS rows are sent
    best = shared_counts(own).orderBy(F.desc("shared_startups")).limit(limit).select("shared_startups").collect()
    return best[-1][0] if len(best) == limit else 1


def tasks_for(pairs: int) -> int:
    return max(1, -(-pairs // PAIRS_A_TASK))


def shared_counts(deals: DataFrame) -> DataFrame:
    """(source_id, target_id, shared_startups) of deals (src_id, dst_id), each once; source before target.

    A startup with more than TOGETHER investors is cut into blocks of about so
    many, and each block meets each block by itself: no task holds more than two
    blocks of a startup. Pairs are far more than the deals that they come of, so
    deals go to as many tasks as their pairs need: by the size of the deals
    adaptive execution would join these tasks until one held most pairs.
    """
    sizes = kept(deals.groupBy(F.col("dst_id").alias("of")).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / TOGETHER).cast("int")))
    parts = tasks_for(sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)
    cut = deals.join(sizes.select("of", "blocks"), F.col("dst_id") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("src_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = cut.select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("s"), F.col("own").alias("i"), F.col("other").alias("j")).repartition(parts, "s", "i", "j")
    two = cut.select(F.col("src_id").alias("target_id"), F.col("dst_id").alias("t"), F.col("other").alias("k"), F.col("own").alias("l")).repartition(parts, "t", "k", "l")
    met = (F.col("s") == F.col("t")) & (F.col("i") == F.col("k")) & (F.col("j") == F.col("l")) & (F.col("source_id") < F.col("target_id"))
    return one.join(two, met).groupBy("source_id", "target_id").agg(F.count("*").alias("shared_startups"))


def co_investments(graph: Graph, limit: int = 20) -> DataFrame:
    """Pairs of investors by the startups that both are in.

    A pair shares no more startups than either has: those with fewer than the
    last shown pair shares at least take no part, whatever they are in. Names and
    examples are looked up for the pairs that are shown only.
    """
    within(limit, 1, 100, "limit")
    deals = counted(graph.edges("INVESTED_IN")).where(F.col("src_label").isin(*BACKERS) & (F.col("dst_label") == "Startup")).select("src_id", "dst_id")
    deals = durable(deals)  # two columns, used for the bound, the pairs and the examples
    enough = deals.groupBy("src_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_shared(deals, limit)).select(F.col("src_id").alias("able"))
    counts = shared_counts(deals.join(enough, F.col("src_id") == F.col("able"), "left_semi"))  # (investor, startup) is unique
    one = deals.select(F.col("src_id").alias("source_id"), "dst_id")
    two = deals.select(F.col("src_id").alias("target_id"), F.col("dst_id").alias("other"))
    names = graph.nodes(*BACKERS).select("id", "name", "label")
    named = counts.join(names.select(F.col("id").alias("i1"), F.col("name").alias("source"), F.col("label").alias("source_type")), F.col("source_id") == F.col("i1"))
    named = named.join(names.select(F.col("id").alias("i2"), F.col("name").alias("target"), F.col("label").alias("target_type")), F.col("target_id") == F.col("i2"))
    order = [F.desc("shared_startups"), F.asc_nulls_last("source"), F.asc_nulls_last("target"), "source_id", "target_id"]
    top = durable(named.orderBy(*order).limit(limit).drop("i1", "i2"))  # a few rows, used twice
    keys = F.broadcast(top.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")))
    startups = graph.nodes("Startup").select(F.col("id").alias("startup"), F.col("name").alias("startup_name"))
    left = one.join(keys, F.col("source_id") == F.col("s")).select("s", "t", "dst_id")
    both = left.join(two, (F.col("dst_id") == F.col("other")) & (F.col("t") == F.col("target_id")), "left_semi")
    paired = both.join(startups, F.col("dst_id") == F.col("startup")).withColumn("pair", F.struct("s", "t"))
    shown = few_per(paired, "pair", "startup_name", 5, "examples").select("pair.*", "examples")
    return (
        top.join(shown, (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")))
        .select("source_id", "source", "source_type", "target_id", "target", "target_type", "shared_startups", F.col("shared_startups").alias("rounds"), "examples")
        .orderBy(*order)
    )


def topic_clusters(graph: Graph, limit: int = 20) -> DataFrame:
    within(limit, 1, 100, "limit")
    tagged = counted(graph.edges("HAS_TOPIC")).where(F.col("src_label").isin("Startup", "Investor", "Company", "Person", "Article"))
    counts = tagged.groupBy("dst_id").agg(F.countDistinct("src_id").alias("entity_count"))
    topics = graph.nodes("Topic").select("id", "name")
    top = topics.join(counts, F.col("id") == F.col("dst_id")).orderBy(F.desc("entity_count"), F.asc_nulls_last("name"), "id").limit(limit).drop("dst_id")
    top = durable(top)  # a few rows, used twice
    names = graph.nodes("Startup", "Investor", "Company", "Person", "Article").select(F.col("id").alias("entity"), F.coalesce("name", "title").alias("shown"))
    shown = tagged.join(F.broadcast(top.select(F.col("id").alias("top_id"))), F.col("dst_id") == F.col("top_id")).join(names, F.col("src_id") == F.col("entity"))
    shown = few_per(shown, "top_id", "shown", 6, "examples")
    return top.join(shown, F.col("id") == F.col("top_id")).select("id", "name", "entity_count", "examples").orderBy(F.desc("entity_count"), F.asc_nulls_last("name"), "id")
