"""Metrics of an ingestion run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimloom.operators.ranking import ranked_within, side_by_side

METHODS = ("exact", "fuzzy", "embedding", "new")
LATENCY_LIMIT_MS = 30_000


def nearest_rank(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """Percentiles (columns p50, ...) by nearest rank: the value at round-half-even(p/100 (n-1)) of the sorted values.

    The values are counted per distinct value first, and places are found by
    running counts of sorted runs, so no task holds them all. Nulls don't count.
    """
    distinct = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = ranked_within(distinct.withColumn("g", F.lit(0)), ["g"], [F.asc("v")])
    # the running total of n over ranges: sums of earlier ranges and of earlier rows in the range
    total = F.lit(distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    ends = _running_total(placed)
    out = []
    for p in percents:
        want = F.bround(F.lit(p / 100.0) * (total - 1)) + 1
        out.append(F.min(F.when((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want), F.col("v"))).alias(f"p{p}"))
    return ends.agg(*out)


def _running_total(placed: DataFrame) -> DataFrame:
    """placed (v, n, place) with upto, the sum of n up to v; by blocks of places."""
    block = F.floor((F.col("place") - 1) / 4096).alias("block")
    rows = placed.select("v", "n", "place", block)
    sums = rows.groupBy("block").agg(F.sum("n").alias("s"))
    before = sums.select(F.col("block").alias("b"), (F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))  # one row per 4096 distinct values
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(before, F.col("block") == F.col("b")).select("v", "n", (F.col("before") + F.col("inside")).alias("upto"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def _tally() -> list[Column]:
    ok = ~F.coalesce("failed", F.lit(False))
    return [F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("entity_count"))), F.lit(0)).alias("entities"), F.coalesce(F.sum(F.when(ok, F.col("graph_operations"))), F.lit(0)).alias("relationships_created")]


def tally(articles: DataFrame) -> DataFrame:
    """articles: failed, entity_count, graph_operations. relationships_created counts all graph operations, as callers expect."""
    return articles.agg(*_tally())


def observed_tally(articles: DataFrame) -> tuple[Observation, DataFrame]:
    """articles as they are, and an observation that has their tally once they have been written: no job of its own."""
    seen = Observation()
    return seen, articles.observe(seen, *_tally())


#: Steps of an octave that latencies are counted in: an upper bound of 9 % of the error of a percentile.
STEPS = 8


def latency_counts(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, step, n): how many values are in each step of an eighth of an octave. Counts of parts, runs or days add up to those of the whole."""
    step = F.when(F.col(column) > 0, F.floor(F.log2(column) * STEPS).cast("int")).otherwise(-(1 << 20))
    return values.where(F.col(column).isNotNull()).groupBy(*keys, step.alias("step")).agg(F.count("*").alias("n"))


def latency_percentiles(counts: DataFrame, percents: list[int]) -> DataFrame:
    """Percentiles (columns p50, ...) from latency_counts(): the upper end of the step that nearest_rank()'s value is in."""
    steps = counts.groupBy("step").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # a row a step
    ranked = steps.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ends = F.when(F.col("step") > -(1 << 20), F.pow(F.lit(2.0), (F.col("step") + 1) / STEPS)).otherwise(0.0)
    return ranked.agg(*[F.min(F.when(F.col("upto") >= F.bround(F.lit(p / 100.0) * (F.col("total") - 1)) + 1, ends)).alias(f"p{p}") for p in percents])


def resolution_report(outcomes: DataFrame) -> DataFrame:
    """By entity type and in all: outcomes by method, and the share that was merged."""
    n = [F.count_if(F.col("method") == m).alias(m) for m in METHODS]
    rolled = outcomes.rollup("entity_type").agg(F.count("*").alias("total"), *n)
    return rolled.select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "total", *METHODS, ratio(F.col("total") - F.col("new"), F.col("total")).alias("dedup_rate"))


def weakest_merges(outcomes: DataFrame, most: int = 10) -> DataFrame:
    return outcomes.where("method = 'fuzzy'").orderBy("similarity", "name", "entity_id").limit(most).select("name", "entity_id", "similarity")


def evidence_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Eight counters: stated, attributed, unsure and defaulted, of entities and relations."""
    def four(df: DataFrame, what: str) -> DataFrame:
        of = lambda s: F.count_if(F.col("evidence_status") == s).alias(f"{what}_{s}")
        return df.agg(of("stated"), of("attributed"), of("unsure"), F.count_if("evidence_status_defaulted").alias(f"{what}_defaulted"))

    return side_by_side(four(entities, "entities"), four(relations, "relations"))


def admission(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Shares of entities and relations that pass the evidence gate."""
    passes = F.col("evidence_status").isin("stated", "attributed")
    one = entities.agg(F.count("*").alias("n"), F.count_if(passes).alias("k")).select(ratio(F.col("k"), F.col("n")).alias("entity_admission"))
    two = relations.agg(F.count("*").alias("n"), F.count_if(passes).alias("k")).select(ratio(F.col("k"), F.col("n")).alias("relation_admission"))
    return side_by_side(one, two)


def scores(articles: DataFrame) -> DataFrame:
    """Per article (article_id, schema_valid, admitted_unsure, entity_count, latency_ms): four checks."""
    return articles.select(
        "article_id",
        F.coalesce("schema_valid", F.lit(False)).alias("schema_valid"),
        (F.coalesce("admitted_unsure", F.lit(0)) == 0).alias("no_unsure_admitted"),
        (F.coalesce("entity_count", F.lit(0)) > 0).alias("not_empty"),
        F.coalesce(F.col("latency_ms") <= LATENCY_LIMIT_MS, F.lit(False)).alias("fast_enough"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Token sums and mean attempts of calls (prompt_tokens, completion_tokens, attempts)."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return calls.agg(total("prompt_tokens"), total("completion_tokens"), F.coalesce(F.round(F.avg("attempts"), 4), F.lit(0.0)).alias("avg_attempts"))


def call_usage(prompt: Column, completion: Column, total: Column) -> Column:
    """A call's tokens as a struct; null if the call tells none of the three, 0 for what it leaves out."""
    known = {"input_tokens": prompt, "output_tokens": completion, "total_tokens": total}
    some = F.coalesce(prompt, completion, total).isNotNull()
    return F.when(some, F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in known.items()]))


def registry_size(registry: DataFrame) -> DataFrame:
    """How many keys a registry has: its names and aliases, not its entities."""
    return registry.agg(F.count("*").alias("registry_size"))
