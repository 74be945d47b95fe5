"""Fixed values of the evidence graph: labels, relation types, states, rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the data model.
ENTITY_TYPES = ("Startup", "Investor", "Person", "Topic", "Company")
LABELS = (*ENTITY_TYPES, "Article", "Source")
DOMAIN_RELATIONS = ("INVESTED_IN", "FOUNDED_BY", "EMPLOYED_BY", "PARTNERED_WITH", "MERGED_WITH", "HAS_TOPIC", "ACQUIRED")
FEED_RELATIONS = ("HAS_TOPIC", "FROM_SOURCE", "MENTIONS")
RELATIONS = (*DOMAIN_RELATIONS, "FROM_SOURCE", "MENTIONS")
DIRECTIONAL_RELATIONS = ("INVESTED_IN", "FOUNDED_BY", "EMPLOYED_BY", "ACQUIRED")
ADMITTED = ("stated", "attributed")
EVIDENCE = ("unsure", "attributed", "stated")
SUPPORTED, UNSUPPORTED = "supported", "unsupported_by_latest_source_processing"
REVIEW = ("unreviewed", "needs_review", "accepted", "rejected")
SAME_ARTICLE_REASONS = ("not_reproduced_same_article", "direction_changed_same_article")
CONFLICT_REASONS = ("inverse_direction", "competing_transaction_type")
#: Which ends a claim may have: relation to (source labels, target labels); others have any.
DIRECTION_RULES = {
    "INVESTED_IN": (("Investor", "Company", "Person"), ("Startup",)),
    "FOUNDED_BY": (("Startup",), ("Person",)),
    "EMPLOYED_BY": (("Person",), ("Startup", "Company")),
    "ACQUIRED": (("Startup", "Company"), ("Startup", "Company")),
    "HAS_TOPIC": (("Startup", "Investor", "Person", "Company"), ("Topic",)),
}


def evidence_rank(status: Column) -> Column:
    return F.when(status == "stated", 2).when(status == "attributed", 1).otherwise(0)


def admitted(status: Column) -> Column:
    """The evidence gate: only stated and attributed facts pass."""
    return F.coalesce(status.isin(*ADMITTED), F.lit(False))


def live(lifecycle: Column, review: Column) -> Column:
    """A claim that can be in conflict: supported, not rejected."""
    return (F.coalesce(lifecycle, F.lit(SUPPORTED)) == SUPPORTED) & (F.coalesce(review, F.lit("unreviewed")) != "rejected")


def insightful(lifecycle: Column, review: Column) -> Column:
    """A claim that insights count: supported, unreviewed or accepted."""
    return (F.coalesce(lifecycle, F.lit(SUPPORTED)) == SUPPORTED) & F.coalesce(review, F.lit("unreviewed")).isin("unreviewed", "accepted")


def valid_direction(relation: Column, source: Column, target: Column) -> Column:
    """Whether the labels of a claim's ends suit its relation; pairs and mergers have no direction."""
    out = F.when(relation.isin("PARTNERED_WITH", "MERGED_WITH"), True)
    for name, (sources, targets) in DIRECTION_RULES.items():
        out = out.when(relation == name, source.isin(*sources) & target.isin(*targets))
    return F.coalesce(out.otherwise(False), F.lit(False))


def checked_label(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"unknown label {label!r}; known are {', '.join(LABELS)}")
    return label


def within(value: int, least: int, most: int, name: str) -> int:
    """A parameter inside its bounds, or a ValueError."""
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}, not {value}")
    return value
