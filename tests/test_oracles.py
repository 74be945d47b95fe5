"""Every query with SQL gives the rows that DuckDB gives over the same tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spark_entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v) or v is pd.NA:
            return None
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted((tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in spark_entry.oracle_sql() if not n.startswith("op")))
def test_equal_to_sql(spark, duck, name):
    ours, theirs = spark_entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(spark_entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
