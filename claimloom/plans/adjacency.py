"""Neighbours of nodes as a table, made once, of which a walk reads the buckets of its frontier.

A row has a node and up to PACKED of its neighbours; a hub has as many
rows as it takes, spread over tasks by ranges of its neighbours. Rows stand in folders by a hash of
the node and are sorted by it, so that a frontier of few nodes reads the row
groups of these nodes in their folders.

Where ids are whole numbers, a row has a node and one neighbour: columns of
numbers are packed by the file, and need no lists that Python makes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.components import Steps, durable

BUCKETS = 64
PACKED = 1000
#: A frontier of no more nodes than this is sent to the tasks and names its buckets; a larger one is joined.
FEW = 10_000


def bucket_of(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, slot, neighbours) of rows (bucket, node, other) that come sorted; a row that repeats is one."""
    last, part = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED):
            rows = batch.slice(at, PACKED)
            node, other = rows.column("node"), rows.column("other")
            first = last != (node[0].as_py(), other[0].as_py())
            last = (node[-1].as_py(), other[-1].as_py())
            turned = pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)
            new = np.append(first, turned | pc.not_equal(other[1:], other[:-1]).to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(np.append(True, turned))
            held = np.add.reduceat(new.astype(np.int32), starts)
            starts, lengths = starts[held > 0], held[held > 0]
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            index = pa.array(starts)
            lists = pa.ListArray.from_arrays(offsets, other.filter(pa.array(new)))
            slots = pa.array(np.full(len(starts), part, np.int32))
            part += 1
            yield pa.RecordBatch.from_arrays([rows.column("bucket").take(index), node.take(index), slots, lists], names=["bucket", "node", "slot", "neighbours"])


def packed(links: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, node, slot, neighbours) of links (src_id, dst_id), repeated or not, seen from both ends.

    The ways are ranged and sorted once by (bucket, node, other), so that repeats
    stand together, a hub is spread over the ranges that it fills, and rows of a
    node follow each other; slot tells apart those of one task.
    """
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    ways = links.select(F.explode(F.array(way("src_id", "dst_id"), way("dst_id", "src_id"))).alias("w")).select("w.*").where("node is not null and other is not null")
    order = ["bucket", "node", "other"]
    ranged = ways.select(bucket_of(F.col("node"), buckets).alias("bucket"), "node", "other").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(packed_runs, "bucket int, node string, slot int, neighbours array<string>")


def numbered(links: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, node, neighbour) of links (src_id, dst_id) whose ids are whole numbers, seen from both ends; a link that repeats is a row each time.

    Rows are dealt by slices of buckets, as many as shuffles have partitions;
    adaptive execution spreads a slice that a hub fills over tasks. One number is
    sorted by, and nothing is sampled.
    """
    slices = buckets * max(1, -(-int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    ways = links.where("src_id is not null and dst_id is not null").select(F.explode(F.array(way("src_id", "dst_id"), way("dst_id", "src_id"))).alias("w")).select("w.*")
    dealt = ways.select(bucket_of(F.col("node"), slices).alias("slice"), "node", "neighbour").hint("rebalance", "slice").sortWithinPartitions("node")
    return dealt.select(F.pmod("slice", F.lit(buckets)).alias("bucket"), "node", "neighbour")


def write_adjacency(links: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    rows = numbered(links, buckets) if dict(links.dtypes)["src_id"] == "bigint" else packed(links, buckets)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def neighbours_of(rows: DataFrame, frontier: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id) of the neighbours of frontier (id), from rows of a table of `buckets`."""
    listed = frontier.limit(FEW + 1).collect()
    if len(listed) <= FEW:
        ids = frontier.sparkSession.createDataFrame(listed, frontier.schema)
        named = sorted(r.b for r in ids.select(bucket_of(F.col("id"), buckets).alias("b")).distinct().collect())
        low, high = min(r.id for r in listed), max(r.id for r in listed)  # goes to the row groups
        rows = rows.where(F.col("bucket").isin(named) & F.col("node").between(low, high))
        frontier = F.broadcast(ids)
    found = F.col("neighbour") if "neighbour" in rows.columns else F.explode("neighbours")
    return rows.join(frontier, F.col("node") == F.col("id"), "left_semi").select(found.alias("id")).distinct()


def walk(spark: SparkSession, folder: str, start: DataFrame, depth: int, buckets: int = BUCKETS) -> DataFrame:
    """(id, hops) of all nodes within depth of start (id), start at 0."""
    rows = spark.read.parquet(folder)
    with Steps(spark) as steps:
        frontier = steps.table(start.select("id").where("id is not null").distinct())
        seen = frontier.withColumn("hops", F.lit(0))
        for k in range(1, depth + 1):
            if frontier.isEmpty():
                break
            old = seen.select(F.col("id").alias("old"))
            frontier = steps.table(neighbours_of(rows, frontier, buckets).join(old, F.col("id") == F.col("old"), "left_anti"))
            seen = seen.unionByName(frontier.withColumn("hops", F.lit(k)))
        return durable(seen)
