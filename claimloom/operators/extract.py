"""Delimited extraction output to typed rows, and merging of a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.model import ENTITY_TYPES, DOMAIN_RELATIONS, EVIDENCE, evidence_rank
from claimloom.operators.ranking import first_per

# The text format.
SEPARATOR = "<|#|>"
COMPLETE = "<|COMPLETE|>"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _status(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*EVIDENCE), low)


def parse(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of kind entity or relation from outputs (article_id, text), in order of pos.

    A line stops the text if it holds the completion marker; lines of fewer than
    four parts, of other kinds, or with a required part empty are passed over.
    A missing or unknown status is unsure and defaulted. A null text has no rows.
    """
    lines = outputs.where("article_id is not null").select("article_id", F.transform(F.split(F.col(text), LINE_ENDS), lambda x: F.trim(x)).alias("lines"))
    stop = F.array_position(F.transform("lines", lambda x: x.contains(COMPLETE)), True).cast("int")
    cut = F.when(stop > 0, F.slice("lines", F.lit(1), stop - 1)).otherwise(F.col("lines"))
    lines = lines.select("article_id", F.posexplode(cut).alias("pos", "line")).where("line <> ''")
    part = F.split("line", r"<\|#\|>", 7)
    lines = lines.select("article_id", "pos", F.transform(part, lambda x: F.trim(x)).alias("p")).withColumn("n", F.size("p")).where("n >= 4")
    at = lambda i: F.get("p", F.lit(i))
    kind, n = F.lower(at(0)), F.col("n")
    entity, relation = kind == "entity", (kind == "relation") & (n >= 6)
    raw = F.when(entity & (n >= 5), at(3)).when(relation & (n == 7), at(4))
    rows = lines.where(entity | relation).select(
        "article_id",
        "pos",
        kind.alias("kind"),
        F.when(entity, at(1)).alias("name"),
        F.when(entity, at(2)).alias("entity_type"),
        F.when(relation, at(1)).alias("source"),
        F.when(relation, at(2)).alias("target"),
        F.when(relation, F.upper(at(3))).alias("rel_type"),
        F.nullif(F.when(relation & (n == 7), at(5)).when(relation, at(4)), F.lit("")).alias("keywords"),
        F.coalesce(_status(raw), F.lit("unsure")).alias("evidence_status"),
        _status(raw).isNull().alias("evidence_status_defaulted"),
        F.when(entity & (n >= 5), at(4)).when(entity, at(3)).when(relation & (n == 7), at(6)).otherwise(at(5)).alias("description"),
    )
    full = lambda *cs: F.forall(F.array(*cs), lambda x: F.coalesce(x, F.lit("")) != "")
    return rows.where(F.when(F.col("kind") == "entity", full("name", "entity_type", "description")).otherwise(full("source", "target", "rel_type", "description")))


def typed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, relations): entities of a known type; relations of a known type between extracted entities, with their types.

    An end's type is that of the last entity row of its name, in any case of letters.
    """
    label = F.element_at(F.create_map(*[F.lit(x) for t in ENTITY_TYPES for x in (t.lower(), t)]), F.lower(F.trim("entity_type")))
    label = F.when(F.lower(F.trim("entity_type")).isin(*[t.lower() for t in ENTITY_TYPES]), label)
    mentions = parsed.where("kind = 'entity'").withColumn("entity_type", label).where("entity_type is not null").select("article_id", "pos", "entity_type", "name", "evidence_status", "evidence_status_defaulted", "description")
    number = F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("entity_type"))  # a number, so that a hash table can hold it
    ends = mentions.groupBy("article_id", F.lower("name").alias("low")).agg(F.max_by(number, "pos").alias("number"))
    ends = ends.select("article_id", "low", F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), F.col("number").cast("int")).alias("type"))
    out = parsed.where((F.col("kind") == "relation") & F.col("rel_type").isin(*DOMAIN_RELATIONS))
    for side in ("source", "target"):
        own = ends.select(F.col("article_id").alias("a"), "low", F.col("type").alias(f"{side}_type"))
        out = out.join(own, (F.col("article_id") == F.col("a")) & (F.lower(side) == F.col("low"))).drop("a", "low")
    relations = out.select("article_id", "pos", "rel_type", F.col("source").alias("source_name"), "source_type", F.col("target").alias("target_name"), "target_type", "keywords", "evidence_status", "evidence_status_defaulted", F.col("description").alias("evidence"))
    return mentions, relations


def _fact_key() -> list[Column]:
    return [F.when(F.col("kind") == "entity", F.lower("name")).otherwise(F.concat_ws("\x1f", F.lower("source"), F.lower("target"), "rel_type")).alias("fact")]


def gleaned(first: DataFrame, second: DataFrame) -> DataFrame:
    """First pass with the second merged in: a fact of the second replaces its like at the like's place, others follow.

    change is added, corrected or kept.
    """
    rest = [c for c in first.columns if c not in ("article_id", "pos", "kind")]
    side = lambda df, p: df.select("article_id", "kind", *_fact_key(), F.lit(p).alias("pass"), "pos", *rest)
    both = side(first, 1).unionByName(side(second, 2))
    values = F.struct(*rest)
    old, new = F.col("pass") == 1, F.col("pass") == 2
    at = F.struct("pass", "pos")
    grouped = both.groupBy("article_id", "kind", "fact").agg(F.min(at).alias("place"), F.max_by(values, at).alias("v"), F.max_by(values, F.when(old, at)).alias("was"), F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"))
    change = F.when(F.col("n_old") == 0, "added").when((F.col("n_new") > 0) & ~F.col("v").eqNullSafe(F.col("was")), "corrected").otherwise("kept")
    return grouped.select("article_id", F.col("place.pass").alias("pass"), F.col("place.pos").alias("pos"), "kind", *[F.col("v")[c].alias(c) for c in rest], change.alias("change"))


def gleaning_summary(merged: DataFrame) -> DataFrame:
    n = lambda k, c: F.count_if((F.col("kind") == k) & (F.col("change") == c)).alias(f"{k}_{c}")
    return merged.agg(n("entity", "added"), n("entity", "corrected"), n("relation", "added"), n("relation", "corrected"))


def clip(text: Column, most: int) -> Column:
    """Single-spaced text of at most `most` characters, an ellipsis included."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def fact_summaries(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted facts as an audit lists them: names, statuses, descriptions of at most 240 characters; relations with a label."""
    shared = ["evidence_status", "evidence_status_defaulted"]
    clipped = clip(F.col("description"), 240).alias("description")
    label = F.format_string("%s -> %s (%s)", "source", "target", "rel_type").alias("label")
    return entities.select("article_id", "pos", "name", "entity_type", *shared, clipped), relations.select("article_id", "pos", "source", "target", "rel_type", *shared, "keywords", clipped, label)


def audit(first: DataFrame, merged: DataFrame | None = None, configured_passes: int = 1, passes_run: int = 0) -> DataFrame:
    """One row about the passes over first (kind, ...): how many were to run and ran, what they changed, what there is at the end.

    merged: gleaned() of first and what the passes found; without it nothing was changed.
    """
    end = first.withColumn("change", F.lit("kept")) if merged is None else merged
    n = lambda kind, change: F.count_if((F.col("kind") == kind) & (F.col("change") == change))
    changes = {f"{plural}_{c}": n(kind, c) for kind, plural in (("entity", "entities"), ("relation", "relationships")) for c in ("added", "corrected")}
    finals = [F.count_if(F.col("kind") == kind).alias(f"final_raw_{plural}") for kind, plural in (("entity", "entities"), ("relation", "relationships"))]
    ran = end.agg(*[c.alias(name) for name, c in changes.items()], *finals)
    return ran.select(F.lit(configured_passes).alias("gleaning_configured_passes"), F.lit(passes_run).alias("gleaning_passes_run"), sum((F.col(c) for c in changes), F.lit(0)).cast("long").alias("total_changes"), *ran.columns)


def deduplicated_topics(mentions: DataFrame, key: str) -> DataFrame:
    """Topics once per article and key, the first one; empty keys go. Other mentions stay."""
    topics = first_per(mentions.where((F.col("entity_type") == "Topic") & (F.coalesce(F.col(key), F.lit("")) != "")), ["article_id", key], ["pos"])
    return mentions.where("entity_type <> 'Topic'").unionByName(topics.select(*mentions.columns))


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, counts before and after): only stated and attributed facts pass."""
    passes = F.coalesce(F.col("evidence_status").isin("stated", "attributed"), F.lit(False))
    counts = rows.agg(F.count("*").alias("before"), F.count_if(passes).alias("after")).withColumn("dropped", F.col("before") - F.col("after"))
    return rows.where(passes), counts


def with_endpoints(mentions: DataFrame, relations: DataFrame, key) -> DataFrame:
    """mentions and, for admitted relations, the ends that no mention of the article and type covers.

    Such an end gets the strongest status of the relations that name it.
    key: column function (name, entity_type) to a matching key.
    """
    passes = F.col("evidence_status").isin("stated", "attributed")
    ends = F.explode(F.array(F.struct(F.col("source_name").alias("name"), F.col("source_type").alias("entity_type")), F.struct(F.col("target_name").alias("name"), F.col("target_type").alias("entity_type")))).alias("end")
    named = relations.where(passes).select("article_id", "pos", "evidence_status", "evidence", ends).select("article_id", "pos", "evidence_status", "evidence", F.col("end.name").alias("name"), F.col("end.entity_type").alias("entity_type"))
    named = named.withColumn("k", key(F.col("name"), F.col("entity_type"))).where("k <> ''")
    have = mentions.select(F.col("article_id").alias("a"), F.col("entity_type").alias("t"), key(F.col("name"), F.col("entity_type")).alias("have")).distinct()
    missing = named.join(have, (F.col("article_id") == F.col("a")) & (F.col("entity_type") == F.col("t")) & (F.col("k") == F.col("have")), "left_anti")
    made = missing.groupBy("article_id", "entity_type", "k").agg(F.min_by("name", "pos").alias("name"), F.max_by("evidence_status", evidence_rank(F.col("evidence_status"))).alias("evidence_status"), F.min("pos").alias("pos"), F.min_by("evidence", "pos").alias("description"))
    return mentions.withColumn("materialised", F.lit(False)).unionByName(made.select("article_id", "pos", "entity_type", "name", "evidence_status", F.lit(False).alias("evidence_status_defaulted"), "description", F.lit(True).alias("materialised")))


def neighbour_keys(relations: DataFrame, key) -> DataFrame:
    """(article_id, entity_type, k, neighbours): keys that an entity has an admitted relation with."""
    named = relations.where(F.col("evidence_status").isin("stated", "attributed")).select("article_id", F.col("source_type").alias("st"), key(F.col("source_name"), F.col("source_type")).alias("sk"), F.col("target_type").alias("tt"), key(F.col("target_name"), F.col("target_type")).alias("tk"))
    named = named.where("NOT (st = tt AND sk = tk)")
    both = named.unionByName(named.select("article_id", F.col("tt").alias("st"), F.col("tk").alias("sk"), F.col("st").alias("tt"), F.col("sk").alias("tk")))
    return both.groupBy("article_id", F.col("st").alias("entity_type"), F.col("sk").alias("k")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "tt", "tk"))).alias("neighbours"))


# The groups of a snapshot of what was extracted, and the entity types in them.
SNAPSHOT_GROUPS = {"startups": "Startup", "investors": "Investor", "people": "Person", "topics": "Topic", "companies": "Company"}
SNAPSHOT_RELATIONS = "relationships"


def snapshot(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(article_id, raw_extraction): an article's extracted entities by type and its relations, before any gate, as JSON of six lists."""
    own = ["name", "evidence_status", "description"]
    ends = ["rel_type", "source_name", "source_type", "target_name", "target_type", "evidence_status", "evidence"]
    rows = mentions.select("article_id", "pos", F.col("entity_type").alias("kind"), F.struct(*own).alias("entity"), F.lit(None).alias("relation"))
    empty = relations.select("article_id", "pos", F.lit(None).cast("string").alias("kind"), F.lit(None).alias("entity"), F.struct(*ends).alias("relation"))
    shape = dict(rows.dtypes)["entity"], dict(empty.dtypes)["relation"]
    rows = rows.withColumn("relation", F.lit(None).cast(shape[1])).unionByName(empty.withColumn("entity", F.lit(None).cast(shape[0])))
    listed = lambda test, what: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", what)))), lambda x: x[what])
    groups = [listed(F.col("kind") == kind, "entity").alias(group) for group, kind in SNAPSHOT_GROUPS.items()]
    gathered = rows.groupBy("article_id").agg(*groups, listed(F.col("relation").isNotNull(), "relation").alias(SNAPSHOT_RELATIONS))
    return gathered.select("article_id", F.to_json(F.struct(*SNAPSHOT_GROUPS, SNAPSHOT_RELATIONS)).alias("raw_extraction"))


def snapshot_items(raw: Column) -> Column:
    """How many records a snapshot's six lists hold; what is no list, or no record in one, doesn't count."""
    names = [*SNAPSHOT_GROUPS, SNAPSHOT_RELATIONS]
    items = F.from_json(raw, ", ".join(f"{x} array<string>" for x in names))
    return sum((F.size(F.coalesce(F.filter(items[x], lambda v: F.coalesce(v.startswith("{"), F.lit(False))), F.array().cast("array<string>"))) for x in names), F.lit(0)).cast("long")
