"""Claims about a node: payloads, order, filters, counts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.model import DOMAIN_RELATIONS, SUPPORTED
from claimloom.sources.graph import Graph

FILTERS = ("review", "supported", "reviewed", "all")


def node_claims(graph: Graph, node_id: str, edges: DataFrame | None = None) -> DataFrame:
    """Edges at a node with kind "claim" or "mention", the counterparty, states and support; FROM_SOURCE edges are neither.

    Claims are domain relations without an article at either end. A node
    without edges, or that doesn't exist, has no rows.
    """
    edges = graph.edges(articles=True) if edges is None else edges
    at = edges.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))
    out = F.col("src_id") == node_id
    other = F.when(out, F.col("dst_id")).otherwise(F.col("src_id"))
    article = (F.col("src_label") == "Article") | (F.col("dst_label") == "Article")
    kind = F.when(F.col("rel_type").isin(*DOMAIN_RELATIONS) & ~article, "claim").when(F.col("rel_type").isin("MENTIONS", "HAS_TOPIC"), "mention")
    rows = at.select(
        kind.alias("kind"),
        F.col("rel_type").alias("relationship"),
        F.when(F.col("rel_type") == "MERGED_WITH", "undirected").when(out, "outgoing").otherwise("incoming").alias("direction"),
        other.alias("counterparty_id"),
        F.coalesce("lifecycle_status", F.lit(SUPPORTED)).alias("lifecycle_status"),
        F.coalesce("review_status", F.lit("unreviewed")).alias("review_status"),
        support_count(F.lit(None).cast("array<string>"), F.col("articles")).alias("active_support_count"),
        F.col("src_id").alias("source_id"),
        F.col("dst_id").alias("target_id"),
    ).where("kind is not null")
    names = graph.nodes().select(F.col("id").alias("end"), F.coalesce("name", "title").alias("counterparty"), F.col("label").alias("counterparty_type"))
    joined = rows.join(names, F.col("counterparty_id") == F.col("end"), "left").drop("end")
    return joined.orderBy("kind", *claim_order())


def support_count(active: Column, articles: Column) -> Column:
    """The active articles, or where there are none, all articles of the claim."""
    return F.coalesce(F.size(F.when(F.size(active) > 0, active).otherwise(F.coalesce(articles, F.array().cast("array<string>")))), F.lit(0)).cast("long")


def claim_order() -> list[Column]:
    return [F.when(F.col("review_status") == "needs_review", 0).otherwise(1).asc(), F.asc("relationship"), F.asc_nulls_last("counterparty"), F.asc("counterparty_id")]


def bucket(review: Column, changed: Column) -> Column:
    """review, supported or neither: what needs a look, what stands."""
    look = (review == "needs_review") | F.coalesce(changed, F.lit(False))
    return F.when(look, "review").when(review != "rejected", "supported").otherwise("other")


def client_rank(review: Column, changed: Column) -> Column:
    """Order in a client's list: what needs review first, rejected last."""
    return F.when(review == "needs_review", 0).when(F.coalesce(changed, F.lit(False)), 1).when(review == "unreviewed", 2).when(review == "accepted", 3).when(review == "rejected", 4).otherwise(5)


def status_label(review: Column, changed: Column) -> Column:
    return F.when(review == "needs_review", "Review required").when(review == "rejected", "Rejected").when(review == "accepted", "Accepted").when(F.coalesce(changed, F.lit(False)), "Support changed").otherwise("Supported")


def filtered(claims: DataFrame, which: str) -> DataFrame:
    """Claims of a client's filter, in its order. claims: node_claims() rows with support_changed, if known."""
    if which not in FILTERS:
        raise ValueError(f"filter must be one of {FILTERS}, not {which!r}")
    changed = F.col("support_changed") if "support_changed" in claims.columns else F.lit(False)
    review = F.col("review_status")
    kind = bucket(review, changed)
    wanted = {"all": F.lit(True), "review": kind == "review", "supported": kind == "supported", "reviewed": review.isin("accepted", "rejected")}[which]
    label, rank = status_label(review, changed), client_rank(review, changed)
    text = F.concat_ws(":", "relationship", "direction", F.coalesce("counterparty", "counterparty_id"))
    return claims.where(wanted).withColumn("status_label", label).withColumn("rank", rank).withColumn("label", text).orderBy("rank", "label", "counterparty_id")


def counts(claims: DataFrame) -> DataFrame:
    """A row: how many claims in review, supported, reviewed, accepted, rejected."""
    changed = F.col("support_changed") if "support_changed" in claims.columns else F.lit(False)
    kind = bucket(F.col("review_status"), changed)
    n = lambda c, name: F.count_if(c).alias(name)
    return claims.agg(n(kind == "review", "review"), n(kind == "supported", "supported"), n(F.col("review_status").isin("accepted", "rejected"), "reviewed"), n(F.col("review_status") == "accepted", "accepted"), n(F.col("review_status") == "rejected", "rejected"))


def relationship_mix(claims: DataFrame) -> DataFrame:
    return claims.groupBy("relationship").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relationship")


def related_entities(claims: DataFrame, most: int = 12) -> DataFrame:
    """Counterparties by the number of edges to them, with the first two of their relations."""
    grouped = claims.groupBy("counterparty_id").agg(F.count("*").alias("weight"), F.array_join(F.slice(F.array_sort(F.collect_set("relationship")), 1, 2), "|").alias("relations"))
    return grouped.orderBy(F.desc("weight"), "counterparty_id").limit(most)


def latest_review(history: Column) -> Column:
    return F.when(F.size(history) > 0, F.element_at(history, -1))


def primary_assertion(assertions: Column) -> Column:
    """The first asserted one with evidence, else the first asserted one, else the first."""
    made = F.filter(assertions, lambda a: a["event"] == "asserted")
    with_evidence = F.filter(made, lambda a: F.coalesce(F.trim(a["evidence"]), F.lit("")) != "")
    return F.coalesce(F.get(with_evidence, F.lit(0)), F.get(made, F.lit(0)), F.get(assertions, F.lit(0)))


def sorted_assertions(assertions: Column) -> Column:
    """Newest first by processing time, else publication; equal ones keep their order."""
    at = lambda a: F.coalesce(a["processed_at"], a["published_at"], F.lit(""))
    numbered = F.transform(assertions, lambda a, i: F.struct(at(a).alias("at"), (-i).alias("i"), a.alias("a")))
    return F.transform(F.sort_array(numbered, asc=False), lambda x: x["a"])


def allowed_actions(review: Column) -> tuple[Column, Column, Column]:
    """Whether a client may accept, reject, reset."""
    return review != "accepted", review != "rejected", review.isin("accepted", "rejected")


def payload(node_id: str, states: DataFrame, history: DataFrame, reviews: DataFrame, articles: DataFrame) -> DataFrame:
    """The claims of a node as a client shows them, with their assertions and their reviews.

    states: claims with their states (src_id, rel_type, dst_id, article_urls,
    active_article_urls, lifecycle_status, review_status, review_reasons,
    support_changed and whatever else is known of them). history:
    lifecycle.history() rows with processed_at. reviews: src_id, rel_type,
    dst_id, run, decision, comment, reviewer. articles: url, article_id,
    source_name, published_at, trace_id.

    All three logs are brought down to the node's own claims before anything is
    gathered. Assertions are newest first, reviews in order; of the last review
    comment, reviewer and run stand beside the claim.
    """
    at = states.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))
    out = F.col("src_id") == node_id
    keys = ["src_id", "rel_type", "dst_id"]

    def own(df: DataFrame) -> DataFrame:
        return df.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))

    known = articles.select(F.col("url").alias("a_url"), "article_id", "source_name", F.col("published_at").cast("string").alias("published_at"), "trace_id")
    told = own(history).withColumn("processed_at", F.col("processed_at").cast("string")).join(known, F.col("article_url") == F.col("a_url"), "left")
    record = F.struct("event", "article_id", "article_url", "article_title", "source_name", "published_at", "run", "processed_at", "trace_id", "evidence_status", "evidence")
    listed = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", F.coalesce("pos", F.lit(1 << 62)).alias("pos"), "event", record.alias("r")))).alias("h"))
    listed = listed.select(*[F.col(k).alias(f"h_{k}") for k in keys], sorted_assertions(F.transform("h", lambda x: x["r"])).alias("assertions"))
    decided = own(reviews).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "decision", "comment", "reviewer"))).alias("review_history"))
    decided = decided.select(*[F.col(k).alias(f"r_{k}") for k in keys], "review_history", latest_review(F.col("review_history")).alias("last"))
    both = at.join(listed, [F.col(k) == F.col(f"h_{k}") for k in keys], "left").join(decided, [F.col(k) == F.col(f"r_{k}") for k in keys], "left")
    rest = [c for c in states.columns if c not in (*keys, "lifecycle_status", "review_status", "review_reasons", "support_changed")]
    return both.select(
        F.col("rel_type").alias("relationship"),
        F.when(F.col("rel_type") == "MERGED_WITH", "undirected").when(out, "outgoing").otherwise("incoming").alias("direction"),
        F.when(out, F.col("dst_id")).otherwise(F.col("src_id")).alias("counterparty_id"),
        F.coalesce("lifecycle_status", F.lit(SUPPORTED)).alias("lifecycle_status"),
        F.coalesce("review_status", F.lit("unreviewed")).alias("review_status"),
        "review_reasons",
        F.coalesce("support_changed", F.lit(False)).alias("support_changed"),
        support_count(F.col("active_article_urls"), F.col("article_urls")).alias("active_support_count"),
        F.coalesce("assertions", F.array().cast(listed.schema["assertions"].dataType)).alias("assertions"),
        primary_assertion(F.col("assertions")).alias("primary_assertion"),
        F.coalesce("review_history", F.array().cast(decided.schema["review_history"].dataType)).alias("review_history"),
        F.col("last.comment").alias("review_comment"),
        F.col("last.reviewer").alias("reviewed_by"),
        F.col("last.run").alias("reviewed_after_run"),
        F.col("src_id").alias("source_id"),
        F.col("dst_id").alias("target_id"),
        *rest,
    )
