from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import normalize as n
from claimloom.functions import similarity as s


def test_display():
    assert n.display("<b>Berlin-based Startup Acme</b> | ") == "Acme"
    assert n.display(" - [Foo Bar].") == "Foo Bar"
    assert n.display(None) == ""


def test_key_by_type():
    assert n.key("Acme GmbH & Co", "Startup") == "acme and co"
    assert n.key("Dr. Anna Meyer, CEO", "Person") == "anna meyer"
    assert n.key("Acme GmbH", "Company") == "acme gmbh"
    assert n.key("STRASSE", "Topic") == n.key("straße", "Topic")
    assert n.key("Startup", "Startup") == ""


def test_slug():
    assert n.slug("Müller & Söhne") == "muller-sohne"
    assert n.slug("???") == "unknown"


def test_columns_agree_with_python(spark):
    names = ["Acme GmbH & Co", "Munich-based Foo Labs", "startup Bar", "", None, "<i>Baz</i> | Qux", "vc One Two", "a  b", "Holding Inc"]
    df = spark.createDataFrame([(x,) for x in names], "name string")
    rows = df.select("name", n.display_column(F.col("name")).alias("d"), n.key_column(F.col("name"), F.lit("Startup")).alias("k"), n.slim_key_column(F.col("name"), "Startup").alias("e"), n.slug_column(F.col("name")).alias("s"), n.tokens_column(n.slim_key_column(F.col("name"), "Startup")).alias("t")).collect()
    for r in rows:
        if r.name is None:
            assert r.k is None and r.d is None
            continue
        assert r.d == n.display(r.name)
        assert r.k == r.e == n.key(r.name, "Startup")
        assert r.s == n.slug(r.name)
        assert set(r.t) == n.tokens(r.k)


def test_columns_agree_with_python_on_many_names(spark):
    import random

    rng = random.Random(3)
    parts = ["Acme", "startup", "Startups", "Berlin-based", "New York based", "vc", "GmbH", "Dr.", "CEO", "<b>", "</i>", "[x]", " | ", "&", "-", "a.b", "c++", "#1", "  ", "holding", "the", "."]
    names = sorted({rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(600)})
    df = spark.createDataFrame([(x,) for x in names], "name string")
    kinds = ("Startup", "Person", "Company")
    rows = df.select("name", n.display_column(F.col("name")).alias("d"), n.slim_slug_column(F.col("name")).alias("s"), *[n.slim_key_column(F.col("name"), k).alias(k) for k in kinds]).collect()
    for r in rows:
        assert (r.d, r.s) == (n.display(r.name), n.slug(r.name)), r.name
        assert [r[k] for k in kinds] == [n.key(r.name, k) for k in kinds], r.name


words = st.lists(st.text("abcde", min_size=1, max_size=5), min_size=1, max_size=4).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(words, words)
def test_similarities_are_symmetric_shares(a, b):
    for f in (s.jaro_winkler, s.token_sort_ratio, s.token_set_ratio, s.indel_ratio):
        assert 0 <= f(a, b) <= 1
        assert abs(f(a, b) - f(b, a)) < 1e-9 or f is s.jaro_winkler
        assert f(a, a) == 1


def test_token_set_ratio_of_a_subset_is_one():
    assert s.token_set_ratio("acme labs", "acme") == 1.0
    assert s.token_set_ratio("", "acme") == 0.0
