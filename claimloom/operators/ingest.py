"""A batch of articles from extraction output to the stored graph.

Tables of the store: sources, articles, entities, article_edges, vectors (of
entities), claims (folded from the logs, then checked for contradictions); and
logs that are only added to: emitted (the claims that each run of an article
made), runs (which articles a run processed), reviews. A run or a review folds
the claims that it touches again, and those between the same two ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.normalize import display_column, key_column, slug_column
from claimloom.model import REVIEW, admitted, live
from claimloom.operators import conflicts, extract, lifecycle, resolve
from claimloom.operators.components import durable
from claimloom.operators.metrics import observed_tally
from claimloom.operators.ordered import resolve_in_order
from claimloom.operators.ranking import ranked_within
from claimloom.plans import claims
from claimloom.sources.store import Store

ENTITY = "id string, label string, name string, canonical_name string, aliases array<string>, evidence_status string, description string"
EMITTED = "run long, url string, rel_type string, src_id string, dst_id string, pos long, evidence_status string, evidence string, keywords string, article_title string"
REVIEWS = "src_id string, rel_type string, dst_id string, run long, decision string, comment string, reviewer string"
CLAIMS = "src_id string, rel_type string, dst_id string, article_urls array<string>, active_article_urls array<string>, lifecycle_status string, review_status string, review_reasons array<string>, support_changed boolean, evidence_status string, evidence string, keywords string, article_titles array<string>"
#: The two ends of a claim, whichever way it goes.
PAIR = ("least(src_id, dst_id) AS lo", "greatest(src_id, dst_id) AS hi")
LONGEST_TEXT = 20_000
ARTICLES = "article_id string, url string, title string, summary string, text string, author string, source_name string, source_url string, published_at timestamp, tags array<string>, raw_extraction string, run long, trace_id string, trace_url string, experiment_id string, provenance array<string>"
VECTORS = "entity_id string, entity_type string, vector array<float>"
EMPTY = {"entities": ENTITY, "emitted": EMITTED, "runs": "url string, run long, processed_at timestamp", "reviews": REVIEWS, "articles": ARTICLES, "sources": "id string, name string, url string, run long", "article_edges": "src_id string, rel_type string, dst_id string, evidence_status string, evidence string", "vectors": VECTORS}


#: Calls of an extractor for one article, seconds of the longest wait between two, and how many call at once.
ATTEMPTS, LONGEST_WAIT, CALLERS = 3, 12.0, 3
EXTRACTED = "article_id string, text string, attempts int, seconds double, error string"


def extracted(articles: DataFrame, extractor: Callable[[str], str], attempts: int = ATTEMPTS, callers: int = CALLERS, wait: float = 1.0) -> DataFrame:
    """articles (article_id, text) with the output of a function of a text, attempts, the seconds of the last one, and the error of those that failed to the end.

    A call that raises is made again, `attempts` times in all, after the lesser of
    2^attempt and LONGEST_WAIT times `wait` seconds. There are as many tasks as
    callers, and each makes one call after another, so no more are ever under way;
    an executor that is lost has its tasks' calls made again elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                for attempt in range(1, attempts + 1):
                    began = time.perf_counter()
                    try:
                        out, error = extractor(text or ""), None
                    except Exception as e:  # whatever a service's client raises
                        out, error = None, f"{type(e).__name__}: {e}"[:500]
                    if error is None or attempt == attempts:
                        break
                    time.sleep(wait * min(2.0**attempt, LONGEST_WAIT))
                rows.append((out, attempt, time.perf_counter() - began, error))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], [c.split()[0] for c in EXTRACTED.split(", ")])

    return articles.select(F.col("article_id").cast("string").alias("article_id"), "text").repartition(callers).mapInArrow(run, EXTRACTED)


def embedded(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """rows with vector, from a function from a batch of at most 100 texts to their vectors."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            values = [x or "" for x in part]
            yield pd.Series([v for at in range(0, len(values), batch) for v in embedder(values[at : at + batch])], dtype=object)

    return rows.withColumn("vector", run(F.col(text)))


def _old(spark: SparkSession, store: Store, name: str) -> DataFrame:
    return store.read(name) if store.version(name) else spark.createDataFrame([], EMPTY[name])


def _full(articles: DataFrame) -> DataFrame:
    """articles with all fields of ARTICLES that come with them; those they lack are null."""
    given = {f.split()[0]: f.split()[1] for f in ARTICLES.split(", ") if f.split()[0] not in ("raw_extraction", "run", "provenance")}
    return articles.select(*[F.col(c).cast(t).alias(c) if c in articles.columns else F.lit(None).cast(t).alias(c) for c, t in given.items()])


def ingest(spark: SparkSession, store: Store, run: int, articles: DataFrame, outputs: DataFrame | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, extractor: Callable[[str], str] | None = None) -> dict[str, int]:
    """Writes a run's articles and what outputs (article_id, text) or an extractor say of them.

    articles: article_id, url, title, source_name, published_at, text; summary,
    author, source_url, tags, trace_id, trace_url, experiment_id if they have
    them. Those whose text has fewer than 20 characters are refused and count as
    failed; so are those that the extractor failed for, which write nothing. A row
    for each article goes to article_runs, and the counts returned are observed as
    it is written. embedder: from texts to vectors, for entities that names don't tell.
    """
    fits = F.length(F.trim(F.coalesce("text", F.lit("")))) >= 20
    good = durable(_full(articles).where(fits))
    if outputs is None:
        said = durable(extracted(good, extractor))
        store.append("extractions", said.select("article_id", F.lit(run).cast("long").alias("run"), "attempts", "seconds", "error"))
        outputs = said.where("error is null").select("article_id", "text")
        good = durable(good.join(outputs.select(F.col("article_id").alias("told")), F.col("article_id") == F.col("told"), "left_semi"))
    mentions, relations = extract.typed(extract.parse(outputs.join(good.select(F.col("article_id").alias("own")), F.col("article_id") == F.col("own"), "left_semi")))
    raw = extract.snapshot(mentions, relations)
    mentions = extract.deduplicated_topics(mentions.where(admitted(F.col("evidence_status"))).withColumn("k", key_column(F.col("name"), F.col("entity_type"))), "k").drop("k")
    relations = durable(relations.where(admitted(F.col("evidence_status"))))
    mentions = durable(extract.with_endpoints(mentions, relations, key_column).withColumn("cand_id", F.xxhash64("article_id", "entity_type", "name", "pos")))
    old = _old(spark, store, "entities")
    index = durable(resolve.registry(old, key_column))
    order = mentions.select("cand_id", "article_id", "pos", "entity_type", "name", "description", F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("all")).dropDuplicates(["cand_id"])
    ranked = ranked_within(order, ["all"], [F.asc("article_id"), F.asc("pos"), F.asc("cand_id")])
    cands = durable(ranked.select("cand_id", "article_id", "entity_type", "name", "description", "aliases", key_column(F.col("name"), F.col("entity_type")).alias("key"), F.col("place").cast("long").alias("seq")))
    vectors = known = None
    if embedder:
        text = F.concat(display_column(F.col("name")), F.lit(". "), F.coalesce("description", F.lit("")))
        vectors = durable(embedded(cands.select("cand_id", F.trim(text).alias("said")), "said", embedder).select("cand_id", "vector"))
        known = _old(spark, store, "vectors")
    resolved = _resolved(cands, relations, index, old, _claims(spark, store), vectors, known)
    # entities, by the article order of their mentions
    seen = mentions.join(resolved.select(F.col("cand_id").alias("r"), "entity_id"), F.col("cand_id") == F.col("r")).join(cands.select(F.col("cand_id").alias("s"), "seq"), F.col("cand_id") == F.col("s"))
    seen = durable(seen.select("article_id", "entity_id", "entity_type", "name", "evidence_status", "description", "seq", F.lit("").alias("evidence")))
    merged = resolve.merged_entities(seen.select(F.col("seq").alias("cand_id"), "entity_id").distinct(), seen.select(F.col("seq").alias("cand_id"), "seq", "entity_type", "name", "evidence_status", "description"), key_column)
    new = merged.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.concat(F.array("canonical_name"), "aliases").alias("aliases"), "evidence_status", F.get("descriptions", F.lit(0)).alias("description"), F.lit(run).cast("long").alias("seq"), F.col("entity_type").alias("kind"))
    labels = old.select("id", F.col("label").alias("kind")).unionByName(new.select("id", "kind")).groupBy("id").agg(F.first("kind").alias("label")).withColumnRenamed("id", "lid")
    state = lifecycle.upserted(old, new, ["id"], "seq")
    entities = state.join(labels, F.col("id") == F.col("lid")).select("id", "label", "name", F.coalesce(F.get("aliases", F.lit(0)), F.col("name")).alias("canonical_name"), "aliases", "evidence_status", "description")
    # claims: ends by key, within the article
    keyed = durable(seen.select("article_id", "entity_type", key_column(F.col("name"), F.col("entity_type")).alias("k"), "entity_id", "seq").groupBy("article_id", "entity_type", "k").agg(F.max_by("entity_id", "seq").alias("entity_id")))
    ends = relations
    for side, column in (("source", "src_id"), ("target", "dst_id")):
        own = keyed.select(F.col("article_id").alias("a"), F.col("entity_type").alias("t"), "k", F.col("entity_id").alias(column))
        ends = ends.withColumn("sk", key_column(F.col(f"{side}_name"), F.col(f"{side}_type"))).join(own, (F.col("article_id") == F.col("a")) & (F.col(f"{side}_type") == F.col("t")) & (F.col("sk") == F.col("k"))).drop("a", "t", "k", "sk")
    urls = good.select(F.col("article_id").alias("u"), "url", F.col("title").alias("article_title"))
    made = ends.join(urls, F.col("article_id") == F.col("u")).select(F.lit(run).cast("long").alias("run"), "url", "rel_type", "src_id", F.col("source_type").alias("src_label"), "dst_id", F.col("target_type").alias("dst_label"), F.col("pos").cast("long").alias("pos"), "evidence_status", "evidence", "keywords", "article_title", "article_id")
    emitted = durable(lifecycle.sightings(made))
    counts = tally_of(store, run, good, articles, seen, made)
    if embedder:
        first = resolved.where("method = 'new'").select(F.col("cand_id").alias("r"), "entity_id", "entity_type").join(vectors, F.col("r") == F.col("cand_id")).where("vector is not null")
        store.append("vectors", first.groupBy("entity_id", "entity_type").agg(F.min_by("vector", "cand_id").alias("vector")))
    store.write("entities", entities)
    store.write("article_edges", _old(spark, store, "article_edges").unionByName(lifecycle.article_edges(seen)).dropDuplicates(["src_id", "rel_type", "dst_id"]))
    event = lifecycle.provenance(F.lit("processed"), run=F.lit(run), url=F.col("url"), trace_id=F.nullif("trace_id", F.lit("")))
    of_run = good.join(raw.withColumnRenamed("article_id", "x_id"), F.col("article_id") == F.col("x_id"), "left").withColumns({"run": F.lit(run).cast("long"), "text": F.substring("text", 1, LONGEST_TEXT), "provenance": F.array(event)})
    of_run = lifecycle.latest(of_run.drop("x_id"), ["article_id"], "url")
    store.write("articles", lifecycle.upserted_articles(_old(spark, store, "articles"), of_run))
    sources = good.select(F.concat(F.lit("source:"), slug_column(F.coalesce("source_name", F.lit("")))).alias("id"), F.col("source_name").alias("name"), F.coalesce("source_url", "url").alias("url"), F.lit(run).cast("long").alias("run"))
    store.write("sources", lifecycle.latest(_old(spark, store, "sources").unionByName(sources), ["id"], "run").select("id", "name", "url", "run"))
    own_urls = good.select(F.col("url").alias("own")).distinct()
    touched = durable(_old(spark, store, "emitted").join(own_urls, F.col("url") == F.col("own"), "left_semi").unionByName(emitted).selectExpr(*PAIR).distinct())
    store.append("emitted", emitted)
    store.append("runs", own_urls.select(F.col("own").alias("url"), F.lit(run).cast("long").alias("run"), F.current_timestamp().alias("processed_at")))
    refresh(spark, store, touched)
    return counts


def _resolved(cands: DataFrame, relations: DataFrame, index: DataFrame, entities: DataFrame, stored: DataFrame, vectors: DataFrame | None, known: DataFrame | None) -> DataFrame:
    """A batch resolved in order; nothing merges into what it has a relation with, in its article or in the graph."""
    near = durable(extract.neighbour_keys(relations, key_column))
    names = entities.select(F.col("id").alias("node_id"), key_column(F.col("name"), F.col("label")).alias("key"))
    live_claims = stored.where(live(F.col("lifecycle_status"), F.col("review_status"))).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    ways = live_claims.unionByName(live_claims.select(F.col("b").alias("a"), F.col("a").alias("b")))
    blocked = durable(resolve.blocked_by_neighbours(cands, near, index).unionByName(resolve.blocked_by_graph(cands.select("cand_id", "key"), names, ways)).distinct())
    return durable(resolve_in_order(cands, index, key_column, blocked, near, vectors, known))


def tally_of(store: Store, run: int, good: DataFrame, articles: DataFrame, seen: DataFrame, made: DataFrame) -> dict[str, int]:
    """Writes what a run did with each article; the counts are taken from the rows as they pass."""
    work = lifecycle.operations(seen, made.select("article_id"))
    passed = good.select(F.col("article_id").alias("g")).distinct()
    per = articles.select("article_id").join(passed, F.col("article_id") == F.col("g"), "left").join(work.select(F.col("article_id").alias("w"), F.col("entities").alias("entity_count"), F.col("operations").alias("graph_operations")), F.col("article_id") == F.col("w"), "left")
    rows = per.select("article_id", F.lit(run).cast("long").alias("run"), F.col("g").isNull().alias("failed"), F.coalesce("entity_count", F.lit(0)).cast("long").alias("entity_count"), F.coalesce("graph_operations", F.lit(3)).cast("long").alias("graph_operations"))
    observed, rows = observed_tally(rows)
    store.append("article_runs", rows)
    return observed.get


def _claims(spark: SparkSession, store: Store) -> DataFrame:
    return store.read("claims") if store.version("claims") else spark.createDataFrame([], CLAIMS)


def refresh(spark: SparkSession, store: Store, touched: DataFrame | None = None) -> None:
    """Folds claims from the logs and flags contradictions: all, or those between the ends of touched (lo, hi); the others stay as they are."""
    emitted, reviews = _old(spark, store, "emitted"), _old(spark, store, "reviews")
    ends = lambda df: df.withColumns({"p_lo": F.least("src_id", "dst_id"), "p_hi": F.greatest("src_id", "dst_id")})
    same = (F.col("p_lo") == F.col("lo")) & (F.col("p_hi") == F.col("hi"))
    if touched is not None:
        emitted, reviews = (ends(x).join(touched, same, "left_semi").drop("p_lo", "p_hi") for x in (emitted, reviews))
    runs = _old(spark, store, "runs").groupBy("url").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    events = lifecycle.article_events_for(emitted, runs).unionByName(lifecycle.review_events(reviews))
    told = lifecycle.evidence(emitted).select(*[F.col(k).alias(f"e_{k}") for k in lifecycle.KEYS], "evidence_status", "evidence", "keywords", "article_titles")
    folded = conflicts.flagged(lifecycle.fold(events)).join(told, [F.col(k) == F.col(f"e_{k}") for k in lifecycle.KEYS], "left").drop(*[f"e_{k}" for k in lifecycle.KEYS])
    if touched is not None and store.version("claims"):
        folded = folded.unionByName(ends(store.read("claims")).join(touched, same, "left_anti").drop("p_lo", "p_hi"))
    store.write("claims", folded)


def claim_payload(spark: SparkSession, store: Store, node_id: str) -> DataFrame:
    """The claims of a node with their assertions and reviews, from the store's logs."""
    emitted, runs, reviews = (_old(spark, store, x) for x in ("emitted", "runs", "reviews"))
    emitted = emitted.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))
    of = runs.groupBy("url").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    past = lifecycle.history(emitted, lifecycle.support(lifecycle.article_events_for(emitted, of)))
    when = runs.groupBy(F.col("url").alias("w_url"), F.col("run").alias("w_run")).agg(F.max("processed_at").alias("processed_at"))
    past = past.join(when, (F.col("article_url") == F.col("w_url")) & (F.col("run") == F.col("w_run")), "left").drop("w_url", "w_run")
    return claims.payload(node_id, _claims(spark, store), past, reviews, _old(spark, store, "articles"))


def review(spark: SparkSession, store: Store, src_id: str, rel_type: str, dst_id: str, decision: str, comment: str | None = None, reviewer: str | None = None) -> bool:
    """Records a decision about a claim after the latest run; False if there is no such claim. Ends are taken as given."""
    if decision not in REVIEW or decision == "needs_review":
        raise ValueError(f"decision must be accepted, rejected or unreviewed, not {decision!r}")
    known = store.read("claims").where((F.col("src_id") == src_id) & (F.col("rel_type") == rel_type) & (F.col("dst_id") == dst_id))
    if known.isEmpty():
        return False
    run = store.read("runs").agg(F.max("run")).first()[0]
    row = spark.createDataFrame([(src_id, rel_type, dst_id, run, decision, comment, reviewer)], REVIEWS)
    store.append("reviews", row)
    refresh(spark, store, row.selectExpr(*PAIR))
    return True


# What feedback can be about, and what it can say.
FEEDBACK_TARGETS = ("extraction", "resolution", "overall")
FEEDBACK_LABELS = ("good", "bad", "wrong_merge", "missed_entity", "other")
FEEDBACK = "trace_id string, target string, label string, comment string, reviewer string, given_at timestamp"


def feedback(spark: SparkSession, store: Store, trace_id: str, target: str, label: str, comment: str | None = None, reviewer: str | None = None) -> None:
    """Appends a person's verdict on a run."""
    if target not in FEEDBACK_TARGETS or label not in FEEDBACK_LABELS:
        raise ValueError(f"feedback must have a target of {FEEDBACK_TARGETS} and a label of {FEEDBACK_LABELS}")
    row = spark.createDataFrame([(trace_id, target, label, comment, reviewer)], "trace_id string, target string, label string, comment string, reviewer string").withColumn("given_at", F.current_timestamp())
    store.append("feedback", row)
