"""Names: display form, matching key, tokens, slug, variants.

A form is a list of steps, data that two readers share: one makes a Python
function of it, the other a column expression. Unicode normalisation and full
case folding exist in Python only, so key and slug of names in general are Arrow
functions; their column expressions hold for names in ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies and patterns that decide which names are equal.
LEGAL_SUFFIXES = ("ag", "gmbh", "holding", "holdings", "inc", "limited", "llc", "ltd", "se", "ug")
TITLES = ("dipl", "dr", "frau", "herr", "hr", "mba", "mr", "mrs", "ms", "prof", "sir")
ROLES = ("ceo", "cfo", "chairman", "chairwoman", "cmo", "co-founder", "cofounder", "coo", "cpo", "cto", "director", "founder", "partner", "president")
STOP_WORDS = ("a", "and", "at", "by", "for", "in", "of", "the", "to")
NOISE_PREFIXES = ("geldgeber", "investor", "jungunternehmen", "scaleup", "startup", "vc")
ARTIFACTS = r"<[^>]+>|[\[\]]|\s*[|•·]\s*"
EDGE_MARKS = " -–—:.,;()[]"


class Step(NamedTuple):
    """A pattern and what replaces each match; or marks that go at both ends; or a change that has no pattern.

    In patterns, WORD stands for the characters of words, which Python and Java name differently.
    """

    pattern: str = ""
    by: str = " "
    ends: str = ""
    change: str = ""


SPACES = Step(r"\s+")
TRIM = Step(ends=" ")
MARKUP = Step(ARTIFACTS)
PLACE = Step(r"^[WORD&.+#‘’-]+(?:\s+[WORD&.+#‘’-]+){0,4}[-\s]+based\s+", "")
NOISE = Step(rf"^(?:{'|'.join(NOISE_PREFIXES)})\s+", "")
FORMS = {
    "display": (MARKUP, SPACES, Step(ends=EDGE_MARKS), PLACE, TRIM, NOISE, TRIM),
    "key": (Step(change="compose"), MARKUP, Step("&", " and "), Step(change="fold"), SPACES, TRIM, PLACE, NOISE, Step(r"[^WORD\s+#.-]"), Step(r"\bstartups?\b"), SPACES, Step(ends=" .-")),
    "slug": (Step(change="compose"), Step(change="fold"), Step(r"[^WORD\s]"), Step(change="ascii"), Step(r"[^a-z0-9]+", "-"), Step(ends="-")),
}
#: Words that a key leaves out, by entity type; and marks that its words don't end in.
LEFT_OUT = {"Person": (*TITLES, *ROLES), "Startup": LEGAL_SUFFIXES, "Investor": LEGAL_SUFFIXES}
WORD_ENDS = {"Person": "."}
CHANGES = {"compose": partial(unicodedata.normalize, "NFKC"), "fold": str.casefold, "ascii": lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()}
JAVA_WORD, PYTHON_WORD = r"\p{L}\p{M}\p{N}_", r"\w"


def _function(step: Step) -> Callable[[str], str]:
    if step.change:
        return CHANGES[step.change]
    if step.ends:
        return lambda text: text.strip(step.ends)
    return partial(re.compile(step.pattern.replace("WORD", PYTHON_WORD), re.I).sub, step.by)


def _column(step: Step, text: Column) -> Column:
    if step.change:
        return F.lower(text) if step.change == "fold" else text
    if step.ends:
        return F.btrim(text, F.lit(step.ends))
    return F.regexp_replace(text, "(?iu)" + step.pattern.replace("WORD", JAVA_WORD), step.by)


FUNCTIONS = {form: tuple(map(_function, steps)) for form, steps in FORMS.items()}


def _through(form: str, raw: str | None) -> str:
    text = raw or ""
    for function in FUNCTIONS[form]:
        text = function(text)
    return text


def _column_through(form: str, text: Column) -> Column:
    for step in FORMS[form]:
        text = _column(step, text)
    return text


def display(raw: str | None) -> str:
    """A readable name: no markup, bullets, marks at the ends, "Berlin-based", "startup"."""
    return _through("display", raw)


def key(raw: str | None, entity_type: str) -> str:
    """The form that names of an entity type are compared by."""
    ends, without = WORD_ENDS.get(entity_type, ""), LEFT_OUT.get(entity_type, ())
    cut = (word.rstrip(ends) if ends else word for word in _through("key", raw).split())
    return " ".join(word for word in cut if word not in without)


def tokens(normal: str) -> frozenset[str]:
    """The words of a key that carry meaning."""
    return frozenset(t for t in normal.split() if len(t) > 1 and t not in STOP_WORDS)


def slug(raw: str | None) -> str:
    """A name as part of an id."""
    return _through("slug", raw) or "unknown"


def _mapped(names: pd.Series, f) -> pd.Series:
    memo = {n: f(n) for n in names.dropna().unique()}
    return names.map(memo)


def key_column(name: Column, entity_type: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(names: pd.Series, kinds: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for n, k in zip(names, kinds, strict=True):
            if n is None:
                out.append(None)
                continue
            if (n, k) not in memo:
                memo[n, k] = key(n, k)
            out.append(memo[n, k])
        return pd.Series(out, dtype=object)

    return run(name, entity_type)


def slug_column(name: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(names: pd.Series) -> pd.Series:
        return _mapped(names, slug)

    return run(name)


def display_column(name: Column) -> Column:
    return _column_through("display", name)


def tokens_column(normal: Column) -> Column:
    """The meaningful words of a key, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normal, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))))


def variants_column(name: Column) -> Column:
    """Ways that a name may be written: lower case, hyphens as spaces, single spaces."""
    low = F.lower(display_column(name))
    loose = F.replace(low, F.lit("-"), F.lit(" "))
    return F.array_distinct(F.array(low, loose, F.trim(F.regexp_replace(loose, r"\s+", " "))))


def slim_key_column(name: Column, entity_type: str) -> Column:
    """key() for names in ASCII, without Python."""
    found = F.split(_column_through("key", name), " ")
    if entity_type in WORD_ENDS:
        found = F.transform(found, lambda t: F.rtrim(t, F.lit(WORD_ENDS[entity_type])))
    if entity_type in LEFT_OUT:
        found = F.filter(found, lambda t: ~t.isin(*LEFT_OUT[entity_type]))
    return F.array_join(found, " ")


def slim_slug_column(name: Column) -> Column:
    """slug() for names in ASCII, without Python."""
    made = _column_through("slug", name)
    return F.when(F.coalesce(made, F.lit("")) == "", "unknown").otherwise(made)
