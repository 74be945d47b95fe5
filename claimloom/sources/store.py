"""Tables of a graph in versions, and files about a run.

A write makes a new folder of rows and then a new pointer, a small table of the
folders that are the version; the newest whole pointer counts. So a table that is
being read is never overwritten, a write that fails leaves the old version in
place, and an append writes the new rows alone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of a table from which an append writes it as one again.
MOST_PARTS = 100


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.root}/{name}/versions")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in system.listStatus(folder)] if system.exists(folder) else []
        return [int(x.getName()) for x in found if system.exists(path(x, "_SUCCESS"))]

    def version(self, name: str) -> int | None:
        return max(self._pointers(name), default=None)

    def parts(self, name: str) -> list[int]:
        """The folders that are the newest version."""
        number = self.version(name)
        return [] if number is None else sorted(r.part for r in self.spark.read.parquet(f"{self.root}/{name}/versions/{number}").collect())

    def _add(self, name: str, df: DataFrame, before: list[int], partition_by: tuple[str, ...] = ()) -> int:
        number = (self.version(name) or 0) + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/data/{number}")
        self.spark.createDataFrame([(x,) for x in [*before, number]], "part long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/versions/{number}")
        return number

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        return self._add(name, df, [], partition_by)

    def append(self, name: str, df: DataFrame) -> int:
        """Adds rows of the same columns. From MOST_PARTS folders on, the table is written as one again."""
        before = self.parts(name)
        if len(before) >= MOST_PARTS:
            return self.write(name, self.read(name).unionByName(df))
        return self._add(name, df, before)

    def read(self, name: str) -> DataFrame:
        found = self.parts(name)
        if not found:
            raise LookupError(f"no table {name}")
        return self.spark.read.parquet(*[f"{self.root}/{name}/data/{x}" for x in found])

    def clear(self) -> int:
        """Empties nodes and edges; returns how many nodes there were."""
        nodes, edges = self.read("nodes"), self.read("edges")
        n = nodes.count()
        self.write("nodes", nodes.limit(0))
        self.write("edges", edges.limit(0))
        return n


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """(id, n) of ids that stand for more than one node; a sound graph has none."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def repeated_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_id", "rel_type", "dst_id").agg(F.count("*").alias("n")).where("n > 1")


def run_summary(run_id: str, source: str, metrics: dict[str, float], failures: list[dict]) -> str:
    """A run in Markdown: metrics, and up to five failures."""
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) and 0 < abs(v) < 0.01 else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"# Ingestion summary of {source}", "", f"- run: {run_id}", "", "## Metrics", "", *([f"- {k}: {shown(v)}" for k, v in metrics.items()] or ["no metrics"])]
    if failures:
        lines += ["", "## Sample failures", "", *[f"- {f.get('stage') or '?'}: {f.get('article_url') or f.get('url') or '(unknown)'}: {(f.get('error') or '')[:200]}" for f in failures[:5]]]
    return "\n".join(lines) + "\n"


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, sort_keys=True), path)
