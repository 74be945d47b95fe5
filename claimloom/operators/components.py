"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which a cluster shares.

    A local session without one gets a folder of its own; on a cluster there is
    no folder to choose, so that is an error. Set spark.cleaner.referenceTracking.cleanCheckpoints
    to have Spark delete what is no longer in use.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="claimloom-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df kept in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which stays there: columns packed, where a checkpoint has whole rows."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of the steps of an iteration, in a folder of their own below the shared one, gone after the with block.

    For joins of what joins have made, over and over: a checkpoint keeps the
    estimate of its size, which every join multiplies, until planning takes longer
    than the work; a table is as large as its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the least node of the component. Loops are left out.

    Rounds go on until none changes an edge. The least neighbours are kept before
    they are joined, so that the join has shuffles of its own, which may be split
    where a node has very many edges.
    """
    state = durable(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = state.unionByName(state.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        best = durable(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m")))
        large = durable(both.where("lo > hi").join(best, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        best = durable(large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), "m"))
        small = large.join(best, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        state = durable(small.unionByName(best.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct())
    pairs = state.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
