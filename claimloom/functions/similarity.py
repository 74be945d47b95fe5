"""Similarities of names and vectors.

Levenshtein and token overlap are JVM expressions. Jaro-Winkler and the token
ratios have no Spark function; they run as Arrow functions on the few pairs that
blocking leaves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    taken = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    base = jaro(a, b)
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return base + common * weight * (1 - base) if base > 0.7 else base


def indel_ratio(a: str, b: str) -> float:
    """1 - insertions and deletions over both lengths: twice the longest common subsequence over them."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the common words and of the common words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    one, two = (" ".join([common, *sorted(r)]).strip() for r in (x - y, y - x))
    if common and (not x - y or not y - x):
        return 1.0
    return max(indel_ratio(one, two), indel_ratio(common, one) if common else 0.0, indel_ratio(common, two) if common else 0.0)


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler)(a, b)


def token_sort_column(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio)(a, b)


def token_set_column(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio)(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def index_score(raw_cosine: Column) -> Column:
    """The scale that vector indexes report cosine on: (1 + cos) / 2."""
    return (1 + raw_cosine) / 2
