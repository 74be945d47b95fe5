"""The life of a claim, event-sourced.

A claim's state is the fold of its events in order: asserted by an article,
not reproduced or turned round when the same article is processed again, in
conflict, reviewed. Events are rows, and the fold is aggregations that combine
before they shuffle: by article and claim, by claim and time, by claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.model import CONFLICT_REASONS, DIRECTIONAL_RELATIONS, DOMAIN_RELATIONS, SUPPORTED, UNSUPPORTED, admitted, valid_direction

EVENTS = "src_id string, rel_type string, dst_id string, seq long, kind string, url string, detail string"
KEYS = ["src_id", "rel_type", "dst_id"]


def emitted_claims(relations: DataFrame) -> DataFrame:
    """Claims that articles make, from resolved relations, once for each run.

    relations: run, url, rel_type, src_id, src_label, dst_id, dst_label,
    evidence_status. Only admitted relations of a valid direction count; a
    merger's ends are put in order of id; loops are left out.
    """
    return claim_ends(relations).where("src_id is not null").distinct()


def claim_ends(relations: DataFrame, *more: str) -> DataFrame:
    """(run, url, rel_type, src_id, dst_id, more columns) of each row of relations; without relation and ends, if it makes no claim."""
    merger = F.col("rel_type") == "MERGED_WITH"
    good = F.col("rel_type").isin(*DOMAIN_RELATIONS) & admitted(F.col("evidence_status")) & valid_direction(F.col("rel_type"), F.col("src_label"), F.col("dst_label")) & (F.col("src_id") != F.col("dst_id"))
    low, high = F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")
    return relations.select("run", "url", F.when(good, F.col("rel_type")).alias("rel_type"), F.when(good, F.when(merger, low).otherwise(F.col("src_id"))).alias("src_id"), F.when(good, F.when(merger, high).otherwise(F.col("dst_id"))).alias("dst_id"), *more)


def sightings(relations: DataFrame) -> DataFrame:
    """Each time that an article says a claim: the columns of emitted_claims(), and pos, evidence_status, evidence, keywords, article_title."""
    return claim_ends(relations, "pos", "evidence_status", "evidence", "keywords", "article_title").where("src_id is not null")


def evidence(seen: DataFrame) -> DataFrame:
    """(src_id, rel_type, dst_id) with evidence_status, evidence, keywords and article_titles, from sightings() in order of run, url, pos.

    The status is stated once anything stated it. Evidence is replaced by
    evidence that is stated or, as long as nothing is, by the latest; where what
    is stated comes without, that of others stands. Keywords are the last ones,
    titles a list without repeats.

    What decides are first and last times, so this is one aggregation by claim;
    only claims with stated sightings, all without evidence, and others with it
    on both sides of the first of them are looked at again.
    """
    t = F.struct("run", "url", "pos")
    stated, told = F.col("evidence_status") == "stated", F.coalesce(F.col("evidence"), F.lit("")) != ""
    said, worded = F.struct(t.alias("t"), "evidence"), F.coalesce(F.col("keywords"), F.lit("")) != ""
    marks = seen.groupBy(*KEYS).agg(
        F.min(F.when(stated, t)).alias("stated"),
        F.max(F.when(stated & told, said)).alias("best"),
        F.min(F.when(~stated & told, said)).alias("first"),
        F.max(F.when(~stated & told, said)).alias("last"),
        F.max(F.when(worded, F.struct(t.alias("t"), "keywords"))).alias("words"),
    )
    between = F.col("stated").isNotNull() & F.col("best").isNull() & (F.col("first.t") < F.col("stated")) & (F.col("last.t") > F.col("stated"))
    asked = marks.where(between).select(*[F.col(k).alias(f"a_{k}") for k in KEYS], F.col("stated").alias("until"))
    before = seen.join(asked, [F.col(k) == F.col(f"a_{k}") for k in KEYS]).where(~stated & told & (t < F.col("until"))).groupBy(*[F.col(k).alias(f"b_{k}") for k in KEYS]).agg(F.max(said).alias("before"))
    titled = seen.where(F.coalesce(F.col("article_title"), F.lit("")) != "").groupBy(*KEYS, "article_title").agg(F.min(t).alias("t"))
    titles = titled.groupBy(*[F.col(k).alias(f"t_{k}") for k in KEYS]).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "article_title"))), lambda x: x["article_title"]).alias("article_titles"))
    both = marks.join(before, [F.col(k) == F.col(f"b_{k}") for k in KEYS], "left").join(titles, [F.col(k) == F.col(f"t_{k}") for k in KEYS], "left")
    late = F.when(F.col("stated").isNull() | (F.col("last.t") < F.col("stated")), F.col("last.evidence")).otherwise(F.col("first.evidence"))
    return both.select(
        *KEYS,
        F.when(F.col("stated").isNotNull(), "stated").otherwise("attributed").alias("evidence_status"),
        F.coalesce("best.evidence", "before.evidence", late).alias("evidence"),
        F.col("words.keywords").alias("keywords"),
        F.coalesce("article_titles", F.array().cast("array<string>")).alias("article_titles"),
    )


def history(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Provenance of claims, a row an event: asserted for each sighting, and not_reproduced or direction_changed where an article's support went (known: support()).

    Rows: src_id, rel_type, dst_id, run, pos, event, article_url, article_title, evidence_status, evidence.
    """
    none = F.lit(None).cast("string")
    said = seen.select(*KEYS, "run", "pos", F.lit("asserted").alias("event"), F.col("url").alias("article_url"), "article_title", "evidence_status", "evidence").distinct()
    lost = known.select(*KEYS, "url", F.explode("moves").alias("m")).where("m.step < 0")
    gone = lost.select(*KEYS, F.expr("m.seq div 10").alias("run"), F.lit(None).cast("long").alias("pos"), F.lower("m.kind").alias("event"), F.col("url").alias("article_url"), none.alias("article_title"), none.alias("evidence_status"), none.alias("evidence"))
    return said.unionByName(gone)


def article_events(emitted: DataFrame) -> DataFrame:
    """Events of all runs: ASSERT for what a run of an article emits, and what that article no longer emits.

    A retraction is due when a run of an article comes after one that emitted
    the claim and doesn't emit it: DIRECTION_CHANGED if a directed claim is now
    made the other way round, else NOT_REPRODUCED. Only claims that the article
    then supports are retracted; the fold sees to that, so the event may stand
    for every later run. An article's runs are few; its claims of all runs meet
    in one group by (article, claim).
    """
    runs = emitted.select("url", "run").distinct().groupBy("url").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return article_events_for(emitted, runs)


def article_events_for(emitted: DataFrame, runs: DataFrame) -> DataFrame:
    """article_events() with the runs (url, runs array) given, for articles that emit nothing in some run."""
    made = emitted.groupBy("url", *KEYS).agg(F.array_sort(F.collect_set("run")).alias("made"))
    turned = made.select(F.col("url").alias("t_url"), F.col("dst_id").alias("t_src"), F.col("rel_type").alias("t_rel"), F.col("src_id").alias("t_dst"), F.col("made").alias("t_made"))
    same = (F.col("url") == F.col("t_url")) & (F.col("src_id") == F.col("t_src")) & (F.col("rel_type") == F.col("t_rel")) & (F.col("dst_id") == F.col("t_dst"))
    both = made.join(turned, same, "left").drop("t_url", "t_src", "t_rel", "t_dst")
    both = both.join(runs.select(F.col("url").alias("r_url"), "runs"), F.col("url") == F.col("r_url")).drop("r_url")
    each = both.select("url", *KEYS, "made", "t_made", F.explode("runs").alias("run")).where(F.col("run") >= F.array_min("made"))
    inverse = F.col("rel_type").isin(*DIRECTIONAL_RELATIONS) & F.coalesce(F.array_contains("t_made", F.col("run")), F.lit(False))
    kind = F.when(F.array_contains("made", F.col("run")), "ASSERT").when(inverse, "DIRECTION_CHANGED").otherwise("NOT_REPRODUCED")
    return each.select(*KEYS, (F.col("run") * 10 + F.when(kind == "ASSERT", 1).otherwise(2)).alias("seq"), kind.alias("kind"), "url", F.lit(None).cast("string").alias("detail"))


def review_events(reviews: DataFrame) -> DataFrame:
    """reviews: src_id, rel_type, dst_id, run (after which it came), decision."""
    return reviews.select(*KEYS, (F.col("run") * 10 + 9).alias("seq"), F.lit("REVIEW").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("decision").alias("detail"))


#: Order of kinds of one seq: what an article makes comes before what it no longer makes, conflicts before reviews.
PHASES = "CASE WHEN kind = 'ASSERT' THEN 1 WHEN kind IN ('NOT_REPRODUCED', 'DIRECTION_CHANGED') THEN 2 WHEN kind = 'CONFLICT' THEN 3 ELSE 4 END"


def support(events: DataFrame) -> DataFrame:
    """(src_id, rel_type, dst_id, url): the articles of each claim, with first (its first assertion), since (from when it supports the claim now; null if it doesn't), changed (was that support ever lost) and moves (when it came and went).

    What an article does to a claim is decided by that article's own events, which are few.
    """
    own = events.where(F.col("kind").isin("ASSERT", "NOT_REPRODUCED", "DIRECTION_CHANGED")).withColumn("phase", F.expr(PHASES))
    asserts = F.col("kind") == "ASSERT"
    held = F.coalesce(F.lag(asserts).over(Window.partitionBy(*KEYS, "url").orderBy("seq", "phase", "kind")), F.lit(False))
    moved = own.withColumn("step", F.when(asserts, F.when(held, 0).otherwise(1)).when(held, -1)).where("step is not null")
    rows = moved.groupBy(*KEYS, "url").agg(
        F.min(F.when(asserts, F.col("seq"))).alias("first"),
        F.max(F.when(F.col("step") != 0, F.struct("seq", "phase", "step"))).alias("_last"),
        (F.min("step") < 0).alias("changed"),
        F.collect_list(F.struct("seq", "phase", "step", "kind")).alias("moves"),
    )
    return rows.select(*KEYS, "url", "first", F.when(F.col("_last.step") > 0, F.col("_last.seq")).alias("since"), "changed", "moves")


def fold(events: DataFrame) -> DataFrame:
    """(src_id, rel_type, dst_id) with the state that its events lead to; claims that were never asserted have none.

    No row holds a claim's history. Each article's part is decided by itself
    (support()); then a claim has one row for each time at which something
    happened, a running sum over which tells when its last support went; and all
    that is left of the order of events is maxima and minima of those times:

    - A claim is supported if some article supports it now.
    - Nothing before the last acceptance or rejection matters to its review.
    - A conflict counts if the claim had support and wasn't rejected then; such
      conflicts stay as reasons. That support went stays one until the next assertion.
    - The review is that of the last event that sets it. An assertion sets it
      only if it isn't decided and there is no conflict.

    At one seq, assertions come before losses, these before conflicts, these
    before reviews; the details of conflicts are of CONFLICT_REASONS. article_urls,
    in order of their first assertion, are the only lists that grow with a claim:
    support() has the same as rows.
    """
    known = support(events)
    listed = lambda at: F.transform(F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, "url")))), lambda x: x["url"])
    of_urls = known.groupBy(*KEYS).agg(listed("first").alias("article_urls"), listed("since").alias("active_article_urls"), F.max("changed").alias("support_changed"))
    text = F.lit(None).cast("string")
    moves = known.select(*KEYS, "url", F.explode("moves").alias("m")).select(*KEYS, "m.seq", "m.phase", text.alias("detail"), "m.step", F.when(F.col("m.step") < 0, F.struct("url", "m.kind")).alias("loss"))
    rest = events.where(F.col("kind").isin("CONFLICT", "REVIEW")).select(*KEYS, "seq", F.expr(PHASES).alias("phase"), "detail", F.lit(0).alias("step"), F.lit(None).cast("struct<url:string,kind:string>").alias("loss"))
    at = moves.unionByName(rest).groupBy(*KEYS, "seq", "phase", "detail").agg(F.sum("step").alias("step"), F.max("loss").alias("loss"))  # of several losses the last by address
    claim = Window.partitionBy(*KEYS)
    until = claim.orderBy("seq", "phase", "detail").rowsBetween(Window.unboundedPreceding, 0)
    t, phase, detail = F.col("t"), F.col("phase"), F.col("detail")
    decisive = (phase == 4) & detail.isin("accepted", "rejected")
    ran = at.withColumn("t", F.struct("seq", "phase", F.coalesce("detail", F.lit("")).alias("detail"))).withColumn("n", F.sum("step").over(until)).withColumn("d", F.max(F.when(decisive, t)).over(claim))
    after = F.col("d").isNull() | (t > F.col("d"))
    opened = (phase == 4) & after & ~decisive
    # after a rejection, conflicts and losses count from the next review on
    ran = ran.withColumn("open", F.coalesce(F.col("d.detail") != "rejected", F.lit(True)) | (F.max(opened.cast("int")).over(until) == 1))
    conflict = (phase == 3) & after & (F.col("n") > 0) & F.col("open")
    orphan = (phase == 2) & after & (F.col("n") == 0)
    marks = ran.groupBy(*KEYS).agg(
        F.max("d").alias("d"),
        F.max(F.when(phase == 1, t)).alias("asserted"),
        F.max(F.when(orphan, F.struct("t", "loss.kind"))).alias("lost"),
        F.max(F.when(orphan & F.col("open"), t)).alias("lost_open"),
        F.max(F.when(opened, t)).alias("reviewed"),
        F.max(F.when(conflict, t)).alias("conflicted"),
        *[F.min(F.when(conflict & (detail == r), t)).alias(r) for r in CONFLICT_REASONS],
    )
    both = of_urls.join(marks, KEYS)
    none = F.array().cast("array<string>")
    later = lambda x, y: F.coalesce(x > y, x.isNotNull() & y.isNull())
    active, lost, asserted, reviewed, needs = F.size("active_article_urls") > 0, F.col("lost"), F.col("asserted"), F.col("reviewed"), F.greatest("lost_open", "conflicted")
    started = F.coalesce(F.col("d.detail"), F.lit("unreviewed"))
    undone = (started != "accepted") | F.col("lost_open").isNotNull() | reviewed.isNotNull()
    reset = F.when(F.col("conflicted").isNull() & undone & later(asserted, F.col("d")), asserted)
    review = (
        F.when((started == "rejected") & reviewed.isNull(), "rejected")
        .when(needs.isNotNull() & ~later(F.greatest(reviewed, reset), needs), "needs_review")
        .when(later(reset, reviewed), "unreviewed")
        .otherwise(F.coalesce(reviewed["detail"], started))
    )
    conflicts = F.transform(F.array_sort(F.filter(F.array(*[F.struct(F.col(r).alias("t"), F.lit(r).alias("r")) for r in CONFLICT_REASONS]), lambda x: x["t"].isNotNull())), lambda x: x["r"])
    reason = F.when(lost["kind"] == "DIRECTION_CHANGED", "direction_changed_same_article").otherwise("not_reproduced_same_article")
    gone = F.when(~active & later(lost["t"], asserted), F.array(reason)).otherwise(none)
    return both.select(*KEYS, "article_urls", "active_article_urls", F.when(active, SUPPORTED).otherwise(UNSUPPORTED).alias("lifecycle_status"), review.alias("review_status"), F.array_union(conflicts, gone).alias("review_reasons"), "support_changed")


def merged_evidence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """evidence_status of a fact over its sightings: stated, once stated; unsure never counts."""
    seen = rows.where(admitted(F.col("evidence_status")))
    return seen.groupBy(*keys).agg(F.when(F.max((F.col("evidence_status") == "stated").cast("int")) == 1, "stated").otherwise("attributed").alias("evidence_status"), F.min(order).alias("first_seen"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Entities after new sightings come in, in the order of `order`; both have keys, name, aliases, evidence_status, description.

    Names are overwritten by the last sighting, aliases are an ordered union,
    evidence is only raised, a description is replaced by a non-empty one if
    there was none, or the new fact is stated, or both have the same status.
    """
    none = F.array().cast("array<string>")
    columns = [*keys, "name", "aliases", "evidence_status", "description"]
    rows = old.select(*columns, F.lit(None).cast("long").alias("_at")).unionByName(new.where(admitted(F.col("evidence_status"))).select(*columns, F.col(order).cast("long").alias("_at")))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_at", F.lit(-1)).alias("at"), "name", "evidence_status", "description", "aliases"))).alias("seen"))
    kind = "struct<name: string, aliases: array<string>, status: string, description: string>"
    start = F.struct(F.lit(None).cast("string").alias("name"), none.alias("aliases"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("description")).cast(kind)

    def take(s: Column, r: Column) -> Column:
        fresh = F.coalesce(r["description"], F.lit("")) != ""
        blank = F.coalesce(s["description"], F.lit("")) == ""
        replace = fresh & (blank | (r["evidence_status"] == "stated") | F.coalesce(s["status"] == r["evidence_status"], F.lit(False)))
        status = F.when(s["status"].isNull() | (r["evidence_status"] == "stated"), r["evidence_status"]).otherwise(s["status"])
        return F.struct(r["name"].alias("name"), F.array_union(s["aliases"], F.coalesce(r["aliases"], none)).alias("aliases"), status.alias("status"), F.when(replace, r["description"]).otherwise(s["description"]).alias("description")).cast(kind)

    state = grouped.select(*keys, F.aggregate("seen", start, take).alias("s"))
    return state.select(*keys, F.col("s.name").alias("name"), F.col("s.aliases").alias("aliases"), F.col("s.status").alias("evidence_status"), F.col("s.description").alias("description"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last sighting of each key as a whole row (sources, articles)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def article_edges(mentions: DataFrame) -> DataFrame:
    """Edges from articles to the entities they name: HAS_TOPIC for topics, else MENTIONS; evidence up to 1200 characters.

    mentions: article_id, entity_id, entity_type, evidence_status, description, evidence.
    """
    good = mentions.where(admitted(F.col("evidence_status")))
    return good.select(F.col("article_id").alias("src_id"), F.when(F.col("entity_type") == "Topic", "HAS_TOPIC").otherwise("MENTIONS").alias("rel_type"), F.col("entity_id").alias("dst_id"), "evidence_status", F.substring(F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.col("description")), 1, 1200).alias("evidence")).dropDuplicates(KEYS)


def provenance(event: Column, **fields: Column) -> Column:
    """A provenance record as JSON; null fields are left out."""
    return F.to_json(F.struct(event.alias("event"), *[c.alias(n) for n, c in fields.items()]))


def operations(mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """Per article, how many graph operations a write takes: 3, its admitted entities, its edges to them, its claims."""
    seen = mentions.where(admitted(F.col("evidence_status"))).groupBy("article_id").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("entity_id", F.col("entity_type") == "Topic").alias("links"))
    made = claims.groupBy(F.col("article_id").alias("a")).agg(F.count("*").alias("claims"))
    joined = seen.join(made, F.col("article_id") == F.col("a"), "left")
    return joined.select("article_id", "entities", "links", F.coalesce("claims", F.lit(0)).alias("claims")).withColumn("operations", 3 + F.col("entities") + F.col("links") + F.col("claims"))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with seq, their place within a key."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


# An article's fields that the last processing sets, and those that it sets only if it has them.
ARTICLE_FIELDS = ("url", "title", "summary", "text", "author", "source_name", "source_url", "published_at", "tags", "raw_extraction", "run")
TRACE_FIELDS = ("trace_id", "trace_url", "experiment_id")


def upserted_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles after a run, a row each: the fields of the run; traces stay where the run has none; provenance is an ordered union.

    old: article_id, ARTICLE_FIELDS, TRACE_FIELDS, provenance array; new the same, once per article.
    """
    fresh = new.select(F.struct(*ARTICLE_FIELDS, *TRACE_FIELDS, "provenance").alias("n"), F.col("article_id").alias("n_id"))
    both = old.select("article_id", F.struct(*ARTICLE_FIELDS, *TRACE_FIELDS, "provenance").alias("o")).join(fresh, F.col("article_id") == F.col("n_id"), "full")
    none = F.array().cast("array<string>")
    last = [F.when(F.col("n_id").isNull(), F.col("o")[c]).otherwise(F.col("n")[c]).alias(c) for c in ARTICLE_FIELDS]
    traces = [F.coalesce(F.nullif(F.col("n")[c], F.lit("")), F.col("o")[c]).alias(c) for c in TRACE_FIELDS]
    return both.select(F.coalesce("article_id", "n_id").alias("article_id"), *last, *traces, F.array_union(F.coalesce(F.col("o.provenance"), none), F.coalesce(F.col("n.provenance"), none)).alias("provenance"))
