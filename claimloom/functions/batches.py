"""How rows are dealt: batches that Python functions get, partitions of shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch that holds whole texts; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows and about BATCH_BYTES bytes.

    With Spark's 10,000 rows, a batch of whole texts is tens of megabytes in each
    Python worker and again, several times over, beside the executor's heap. The
    plan reads these settings when it runs, so they stay lowered; a session that
    has lower ones keeps them.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df in partitions of about so many rows by a key, for work that makes much of each row of a small file.

    Shuffles that follow get as many partitions at least, so that a task's share
    stays what it is when the table grows; adaptive execution joins small ones again.
    """
    name, conf = "spark.sql.shuffle.partitions", df.sparkSession.conf
    parts = max(1, -(-df.count() // rows))
    if parts > int(conf.get(name)):
        conf.set(name, str(parts))
    return df.repartition(parts, key)
