"""The functions as SQL functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import normalize, similarity
from claimloom.operators.extract import COMPLETE, SEPARATOR


def _text(f):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    return run


def _pair(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


@F.pandas_udf(T.StringType())
def norm_key(names: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else normalize.key(n, k) for n, k in zip(names, kinds, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_set(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else sorted(normalize.tokens(k)))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("canonical_url", "title", "summary", "author", "published")] + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))
def parse_article_html(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
    from claimloom.sources.acquire import article

    return pd.DataFrame([article(u, p) for u, p in zip(urls, pages, strict=True)], columns=["canonical_url", "title", "summary", "author", "published", "tags", "text"])


class ParseExtraction:
    """Table function: (pos, kind, parts) for the rows of a text before the completion marker."""

    def eval(self, text: str):
        for pos, line in enumerate((text or "").splitlines()):
            line = line.strip()
            if COMPLETE in line:
                return
            parts = [p.strip() for p in line.split(SEPARATOR, 6)]
            if len(parts) >= 4 and parts[0].lower() in ("entity", "relation"):
                yield pos, parts[0].lower(), parts[1:]


def register(spark: SparkSession) -> None:
    """norm_key, norm_display, norm_slug, token_set, jaro_winkler, token_sort_ratio, token_set_ratio, cosine, parse_article_html; table function parse_extraction."""
    spark.udf.register("norm_key", norm_key)
    spark.udf.register("norm_display", _text(normalize.display))
    spark.udf.register("norm_slug", _text(normalize.slug))
    spark.udf.register("token_set", token_set)
    for name in ("jaro_winkler", "token_sort_ratio", "token_set_ratio"):
        spark.udf.register(name, _pair(getattr(similarity, name)))
    spark.udf.register("parse_article_html", parse_article_html)
    spark.udtf.register("parse_extraction", F.udtf(ParseExtraction, returnType="pos int, kind string, parts array<string>"))
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0d, (t, x) -> t + x)"
    ab, aa, bb = dot.format("a", "b"), dot.format("a", "a"), dot.format("b", "b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN {aa} > 0 AND {bb} > 0 THEN {ab} / (sqrt({aa}) * sqrt({bb})) END")
