"""How results are shown: titles, labels, dates, money, prompts, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels and limits.
REASON_LABELS = {
    "not_reproduced_same_article": "Not reproduced when its source article was processed again",
    "direction_changed_same_article": "Direction changed when its source article was processed again",
    "inverse_direction": "Conflicting direction between the same entities",
    "competing_transaction_type": "Another article describes this pair using a competing transaction type",
}
PROMPT_TAGS, PROMPT_CHARS = 20, 14_000
# Properties of a node in the order in which they are shown; of an article, those that come first, and those that don't show.
SHOWN = ("canonical_name", "category", "stage", "amount", "currency", "published_at", "announced_at", "evidence_status", "evidence", "source_name", "url")
ARTICLE_FIRST = ("id", "title", "url", "author", "published_at", "source_name", "source_url", "summary", "tags", "text")
ARTICLE_HIDDEN = ("raw_extracted_entities", "trace_provenance")


def present(text: Column) -> Column:
    """Trimmed text, or null if that is empty."""
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    return text.try_cast("double")


def clamp(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(x, F.lit(most)))


def insight_title(name: Column, source: Column, target: Column, place: Column) -> Column:
    name, source, target = present(name), present(source), present(target)
    return F.coalesce(name, F.when(source.isNotNull() & target.isNotNull(), F.concat(source, F.lit(" + "), target)), source, target, F.concat(F.lit("Cluster "), place.cast("string")))


def insight_subtitle(examples: Column, source: Column, target: Column) -> Column:
    """The first two non-empty examples, else the pair, else a hint."""
    some = F.filter(F.transform(examples, lambda x: F.trim(x)), lambda x: x != "")
    pair = F.when(present(source).isNotNull() & present(target).isNotNull(), F.concat(F.lit("Co-investment signal between "), F.trim(source), F.lit(" and "), F.trim(target)))
    return F.coalesce(F.when(F.size(some) > 0, F.array_join(F.slice(some, 1, 2), " | ")), pair, F.lit("Open to focus graph on this signal"))


def insight_metric(**values: Column) -> Column:
    """The first of mentions, investments, shared_startups, rounds, entity_count that is there, with its label."""
    labels = {"mentions": "mentions", "investments": "investments", "shared_startups": "shared startups", "rounds": "rounds", "entity_count": "entities"}
    found = [F.when(values[n].isNotNull(), F.concat_ws(" ", values[n].cast("string"), F.lit(label))) for n, label in labels.items() if n in values]
    return F.coalesce(*found, F.lit("- metric"))


def relation_label(relation: Column) -> Column:
    """INVESTED_IN as "Invested In"."""
    return F.initcap(F.replace(F.lower(relation), F.lit("_"), F.lit(" ")))


def score_text(score: Column) -> Column:
    whole = F.floor(score + 0.5).cast("long").cast("string")
    return F.when(score.isNull() | F.isnan(score), "-").when(score >= 100, whole).otherwise(F.format_string("%.2f", score))


def metric_text(value: Column) -> Column:
    return F.when((F.abs(value) < 0.01) & (value != 0), F.format_string("%.6f", value)).otherwise(F.format_string("%.3f", value))


def date_text(at: Column) -> Column:
    return F.date_format(at, "dd MMM yyyy")


def money_text(amount: Column, currency: Column) -> Column:
    return F.when(amount.isNull() | F.isnan(amount), "n/a").otherwise(F.concat_ws(" ", F.format_number(F.floor(amount + 0.5).cast("long"), 0), F.coalesce(currency, F.lit("EUR"))))


def number_text(value: Column) -> Column:
    """Digits in groups of three, and up to three decimals; null if there is no finite number."""
    finite = ~F.coalesce(F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf")), F.lit(True))
    return F.when(finite, F.call_function("format_number", F.round(value, 3), F.lit("#,##0.###")))


def _property(name: str, kind: T.DataType, article: bool) -> Column | None:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        items = F.filter(F.transform(value, lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(items) > 0, F.array_join(items, ", "))
    if isinstance(kind, T.NumericType):
        text = number_text(value)
        return F.when(text.isNotNull(), money_text(value.cast("double"), F.lit("EUR"))) if name == "amount" else text
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return date_text(value)
    if not isinstance(kind, T.StringType):
        return None
    text = F.nullif(value, F.lit(""))
    if article and name == "text":
        return F.when(present(value).isNotNull(), F.concat(number_text(F.length(value)), F.lit(" characters")))
    if name == "evidence_status":
        return evidence_label(text)
    return F.coalesce(date_text(text.try_cast("timestamp")), text) if name.endswith("_at") else text


def property_rows(nodes: DataFrame, key: str = "id", article: bool = False) -> DataFrame:
    """(key, place, property, value): what is shown of each node's columns; place is the column's number in their order.

    Nodes show the columns of SHOWN that they have; articles all but the hidden
    ones, the rest of them by name. What is null, empty or of another kind than
    texts, numbers, dates and lists of texts doesn't show.
    """
    kinds = {f.name: f.dataType for f in nodes.schema}
    names = [n for n in (ARTICLE_FIRST if article else SHOWN) if n in kinds]
    if article:
        names += sorted(set(kinds) - set(names) - set(ARTICLE_HIDDEN))
    values = [(n, _property(n, kinds[n], article)) for n in names]
    rows = [F.struct(F.lit(k).alias("place"), F.lit(n).alias("property"), v.alias("value")) for k, (n, v) in enumerate(values) if v is not None]
    listed = F.array(*rows).cast("array<struct<place: int, property: string, value: string>>")
    return nodes.select(F.col(f"`{key}`").alias(key), F.explode(F.filter(listed, lambda x: x["value"].isNotNull())).alias("shown")).select(F.col(f"`{key}`"), "shown.*")


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def reason_label(reason: Column) -> Column:
    return F.coalesce(_mapped(reason, REASON_LABELS), F.replace(reason, F.lit("_"), F.lit(" ")))


def _mapped(value: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(list(labels.items())):
        out = F.when(value == k, v).otherwise(out)
    return out


def decision_label(decision: Column) -> Column:
    return F.when(decision == "accepted", "Accepted").when(decision == "rejected", "Rejected").when(decision == "unreviewed", "Reset to unreviewed").otherwise("Reviewed")


def event_label(event: Column) -> Column:
    return F.when(event == "not_reproduced", "Not reproduced").when(event == "direction_changed", "Direction changed").otherwise("Asserted")


def evidence_label(status: Column) -> Column:
    return F.when(status == "stated", "Stated").when(status == "attributed", "Attributed").when(status == "unsure", "Unsure - not written to graph").otherwise(status)


def direction_title(direction: Column, relationship: Column, own: Column, other: Column) -> Column:
    link = F.when(direction == "undirected", "<->").otherwise("->")
    first, last = F.when(direction == "incoming", other).otherwise(own), F.when(direction == "incoming", own).otherwise(other)
    return F.concat_ws(" ", first, link, relationship, link, last)


def synopsis(label: Column, name: Column, links: Column, families: Column) -> Column:
    n = links.cast("string")
    return (
        F.when(label == "Startup", F.concat(name, F.lit(" appears in "), n, F.lit(" graph links.")))
        .when(label == "Investor", F.concat(name, F.lit(" has "), n, F.lit(" links across "), families.cast("string"), F.lit(" relationship families.")))
        .when(label == "Company", F.concat(name, F.lit(" appears as a company node with "), n, F.lit(" nearby links.")))
        .otherwise(F.concat(name, F.lit(" connects to "), n, F.lit(" nearby graph signals.")))
    )


def trace_url(base: Column, experiment: Column, trace: Column) -> Column:
    return F.when(present(trace).isNotNull(), F.concat(F.rtrim(base, F.lit("/")), F.lit("/#/experiments/"), F.url_encode(F.coalesce(experiment, F.lit("1"))), F.lit("/traces/"), F.url_encode(trace)))


def prompt_tags(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(F.slice(tags, 1, PROMPT_TAGS), ", ")).otherwise("none")


def prompt_text(text: Column) -> Column:
    return F.substring(text, 1, PROMPT_CHARS)


def group_text(name: str, names: Column, most: int = 5) -> Column:
    """name=[a, b, +n more], or null for an empty list."""
    rest = F.size(names) - most
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{name}=["), F.array_join(F.slice(names, 1, most), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(""), F.lit("]")))


def distinct_traces(references: Column) -> Column:
    """Trace references (key, priority, at, title) once per key, the highest priority and then the first, newest first, then by title."""
    keys = F.array_distinct(F.transform(references, lambda r: r["key"]))
    best = F.transform(keys, lambda k: F.get(F.array_sort(F.filter(references, lambda r: r["key"] == k), lambda a, b: b["priority"].cast("int") - a["priority"].cast("int")), F.lit(0)))
    return F.array_sort(best, lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0))
