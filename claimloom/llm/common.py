"""What several operators share: words, held-out folds, batches, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from claimloom.functions.batches import small_batches
from claimloom.operators.components import durable

__all__ = ["durable", "fold", "in_fold", "kept_rows", "labelled_sample", "mapped", "raw", "sigmoid", "slices", "small_batches", "table", "within_bytes", "words"]

#: Bytes of texts of a training sample of either label, at most.
SAMPLE_BYTES = 64 << 20
#: Characters between words: a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"


def raw(text) -> bytes:
    """UTF-8 of a text; a null one is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def words(text) -> list[bytes]:
    """The words of a text. bytes.split() parts at just the six characters of SPACES."""
    return raw(text).split()


def slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about so many bytes of strings together, so that their words fit in memory."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mapped(df: DataFrame, carried: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """What a function makes of the rows of df, beside columns that it doesn't see.

    make: gives, once per task, a function from a frame of the columns that
    aren't carried to a frame with a row for each of its rows, or with a column
    `at`, the number of the row that each came from.
    carried: columns that go along as they are. Ids do: pandas would make
    floating-point numbers of whole ones beside a null.
    schema: the columns of the result, carried and made.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    seen = [c for c in df.columns if c not in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in (x for b in batches for x in slices(b)):
            made = function(batch.select(seen).to_pandas())
            at = pa.array(made["at"].to_numpy(np.int64)) if "at" in made else None
            columns = []
            for field in arrow:
                if field.name in carried:
                    column = batch.column(field.name)
                    columns.append(column if at is None else column.take(at))
                else:
                    columns.append(pa.Array.from_pandas(made[field.name], type=field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, columns: list[str], decide: Callable[[], Callable[[pd.DataFrame], list]]) -> DataFrame:
    """The rows of df for which a test is true, with all their columns as they are.

    decide: makes, once per task, the test of a batch of the named columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = decide()
        for batch in batches:
            mask: list = []
            for part in slices(batch.select(columns)):
                mask += test(part.to_pandas())
            yield batch.filter(pa.array(mask, pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has fold null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def in_fold(doc_id: Column, n: int, k: int) -> Column:
    return F.coalesce(fold(doc_id, n) == k, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within_bytes(found: DataFrame, group: str, most_bytes: int) -> list[Row]:
    """Rows of found (group, place, body), in order of place, as long as the bodies of a group have most_bytes bytes together; larger ones are passed over."""
    left: dict = {}
    taken, longest = set(), 0
    for r in sorted(found.select("place", F.octet_length("body").alias("n"), F.col(group).alias("key")).collect(), key=lambda r: r.place):
        if r.n <= left.setdefault(r.key, most_bytes):
            left[r.key] -= r.n
            longest = max(longest, r.n)
            taken.add(r.place)
    return [r for r in found.where(F.octet_length("body") <= longest).toLocalIterator() if r.place in taken]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, left_out: tuple[int, int], per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """At most per_class (text, label) of either label outside fold left_out = (n, k), and how many of each label there are.

    The rows with the smallest hash of their id are taken, so the sample is the
    same on every run, as long as all texts taken of a label have most_bytes
    bytes together; a text that would exceed them is passed over. Rows with a
    null id or a label other than 0 and 1 are passed over; an id with several
    labels or texts counts once, with the larger of each.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold(F.col("id"), *left_out))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("id"))
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    ids = [(r.id, r.y, k) for k, r in enumerate(parts[0].unionByName(parts[1]).select("id", "y").collect())]
    if not ids:
        return [], (0, 0)
    chosen = documents.sparkSession.createDataFrame(ids, "id long, y int, place int")
    found = durable(
        documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("body"))
        .join(F.broadcast(chosen), F.col("doc") == F.col("id"))
        .groupBy("id", "y", "place")
        .agg(F.coalesce(F.max("body"), F.lit("")).alias("body"))
    )
    rows = sorted((r.id, r.body, r.y) for r in within_bytes(found, "y", most_bytes))
    return [(body, y) for _, body, y in rows], (counts.get(0, 0), counts.get(1, 0))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))
