"""Contradictions between live claims, and the other whole-graph clean-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import CONFLICT_REASONS, DIRECTIONAL_RELATIONS, DOMAIN_RELATIONS, SUPPORTED, live
from claimloom.operators.components import durable
from claimloom.operators.ranking import side_by_side

#: Pairs that are few enough to send to every task.
FEW = 100_000
KEYS = ["src_id", "rel_type", "dst_id"]


def _live(edges: DataFrame) -> DataFrame:
    return edges.where(live(F.col("lifecycle_status"), F.col("review_status"))).select(*KEYS)


def inverse_pairs(edges: DataFrame) -> DataFrame:
    """(rel_type, low_id, high_id): live directed claims that are claimed the other way round too.

    Both directions of a claim fall on one key, so this is one aggregation.
    """
    directed = _live(edges).where(F.col("rel_type").isin(*DIRECTIONAL_RELATIONS)).where("src_id <> dst_id")
    grouped = directed.groupBy("rel_type", F.least("src_id", "dst_id").alias("low_id"), F.greatest("src_id", "dst_id").alias("high_id"))
    return grouped.agg(F.max((F.col("src_id") < F.col("dst_id")).cast("int")).alias("up"), F.max((F.col("src_id") > F.col("dst_id")).cast("int")).alias("down")).where("up = 1 AND down = 1").drop("up", "down")


def transaction_pairs(edges: DataFrame) -> DataFrame:
    """(src_id, dst_id, merged_src, merged_dst): a live acquisition and a live merger of the same two."""
    both = lambda df: df.withColumn("low", F.least("src_id", "dst_id")).withColumn("high", F.greatest("src_id", "dst_id"))
    bought = both(_live(edges).where("rel_type = 'ACQUIRED'"))
    merged = both(_live(edges).where("rel_type = 'MERGED_WITH'")).select("low", "high", F.col("src_id").alias("merged_src"), F.col("dst_id").alias("merged_dst"))
    return bought.join(merged, ["low", "high"]).select("src_id", "dst_id", "merged_src", "merged_dst")


def conflict_count(edges: DataFrame) -> DataFrame:
    return side_by_side(inverse_pairs(edges).agg(F.count("*").alias("inverse")), transaction_pairs(edges).agg(F.count("*").alias("competing"))).withColumn("conflicts", F.col("inverse") + F.col("competing"))


def contested(edges: DataFrame) -> DataFrame:
    """The edges between two nodes that have live claims of both directions, or an acquisition and a merger: all that flagged() can flag, and little else.

    A pair's live claims are bits of one number, so the pairs are found by a hash
    aggregation; they are few, and edges are then asked for by them.
    """
    kinds = [*DIRECTIONAL_RELATIONS, "MERGED_WITH"]
    up, low, high = F.col("src_id") < F.col("dst_id"), F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")
    bit = F.lit(0)
    for i, r in enumerate(kinds):
        bit = F.when(F.col("rel_type") == r, F.when(up, 1 << 2 * i).otherwise(2 << 2 * i)).otherwise(bit)
    own = _live(edges).where(F.col("rel_type").isin(*kinds) & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    pairs = own.groupBy(low.alias("low"), high.alias("high")).agg(F.bit_or(bit).alias("bits"))
    has = lambda *bits: F.forall(F.array(*[F.lit(sum(b)) for b in bits]), lambda b: F.col("bits").bitwiseAND(b) != 0)
    test = has([3 << 2 * kinds.index("ACQUIRED")], [3 << 2 * kinds.index("MERGED_WITH")])
    for i in range(len(DIRECTIONAL_RELATIONS)):
        test |= has([1 << 2 * i], [2 << 2 * i])
    found = durable(pairs.where(test).select("low", "high"))
    found = F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found
    return edges.join(found, (low == F.col("low")) & (high == F.col("high")), "left_semi")


def flagged(edges: DataFrame) -> DataFrame:
    """edges with claims in conflict set to needs_review and the reason added to review_reasons once.

    All that can contradict a claim stands between the same two nodes: at most
    two directions of each relation, so a window over the pair holds a few rows.
    """
    claim = F.coalesce(live(F.col("lifecycle_status"), F.col("review_status")), F.lit(False)) & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()
    pair = Window.partitionBy(F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id"))
    up = F.col("src_id") < F.col("dst_id")
    kind, turned = F.struct("rel_type", up.alias("up")), F.struct("rel_type", (~up).alias("up"))
    seen = F.collect_set(F.when(F.col("_claim"), kind)).over(pair)
    rival = F.when(F.col("rel_type") == "ACQUIRED", "MERGED_WITH").when(F.col("rel_type") == "MERGED_WITH", "ACQUIRED")
    tests = (
        F.col("rel_type").isin(*DIRECTIONAL_RELATIONS) & (F.col("src_id") != F.col("dst_id")) & F.array_contains("_seen", turned),
        F.exists("_seen", lambda x: x["rel_type"] == rival),
    )
    none = F.array().cast("array<string>")
    found = F.array_compact(F.array(*[F.when(F.col("_claim") & test, reason) for test, reason in zip(tests, CONFLICT_REASONS)]))
    if "review_reasons" not in edges.columns:
        edges = edges.withColumn("review_reasons", none)
    return (
        edges.withColumn("_claim", claim)
        .withColumn("_seen", seen)
        .withColumn("_found", found)
        .withColumn("review_status", F.when(F.size("_found") > 0, "needs_review").otherwise(F.col("review_status")))
        .withColumn("review_reasons", F.array_union(F.coalesce("review_reasons", none), F.col("_found")))
        .drop("_claim", "_seen", "_found")
    )


def initialised(edges: DataFrame) -> DataFrame:
    """Claim states filled in where they are null, on domain edges without an article."""
    claim = F.col("rel_type").isin(*DOMAIN_RELATIONS) & (F.col("src_label") != "Article") & (F.col("dst_label") != "Article")
    fill = lambda c, v: F.when(claim, F.coalesce(F.col(c), v)).otherwise(F.col(c))
    return edges.withColumn("lifecycle_status", fill("lifecycle_status", F.lit(SUPPORTED))).withColumn("review_status", fill("review_status", F.lit("unreviewed")))


def without_geography(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics of category geography go with their edges; other topics lose their category."""
    place = (F.col("label") == "Topic") & (F.lower(F.coalesce("category", F.lit(""))) == "geography")
    gone = nodes.where(place).select(F.col("id").alias("gone"))
    edges = edges.join(gone, F.col("src_id") == F.col("gone"), "left_anti").join(gone, F.col("dst_id") == F.col("gone"), "left_anti")
    kept = nodes.where(~place).withColumn("category", F.when(F.col("label") != "Topic", F.col("category")))
    return kept, edges
