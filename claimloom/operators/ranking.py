"""Ranks, first rows and running places that don't put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.components import durable


def ranked_within(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with place (1, 2, ...) and total within each group of keys.

    Rows are ranged by the whole order, so a group is spread over as many
    partitions as it fills; a partition's rows are numbered there, and the
    counts of earlier partitions (one row per partition and group) are added.
    """
    columns = df.columns
    by = [F.asc(k) for k in keys] + order
    # kept, so that both uses see the very same partitions
    ranged = durable(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("total"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return own.join(counts, same).select(*columns, (F.col("_n") + F.col("_before")).alias("place"), "total")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each group by the columns of order: one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(picked).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def ordered_distinct(df: DataFrame, text: str, position: str) -> DataFrame:
    """Rows whose text, trimmed and in lower case, comes first at that position."""
    return first_per(df.withColumn("_key", F.lower(F.trim(F.col(text)))), ["_key"], [position]).drop("_key")


def few_per(df: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """(key, name): the least n distinct values of each key, joined by |.

    Pairs are made distinct over (key, value), and each task passes on no more
    than n of a key, so a key that holds a third of all rows costs no more.
    """
    pairs = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    return pairs.withColumn("_place", place).where(F.col("_place") <= n).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), "|").alias(name))


def page(df: DataFrame, order: list[Column], number: int, size: int = 6) -> DataFrame:
    """The rows of a page, counted from 1, in an order that must tell all rows apart."""
    if number < 1 or size < 1:
        raise ValueError(f"there is no page {number} of {size} rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """DataFrames of one row each as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
