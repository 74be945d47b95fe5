"""A corpus made ready for training: rules, classifier, near-duplicates, leaks, packing.

Each stage takes what its predecessor kept and returns the columns of
documents; the last returns packed pieces. A row without an id is a document like
any other; rows of one id are told apart by their texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import bytecnn, decontaminate, fertility, ngramjoin, packing
from claimloom.llm.common import table
from claimloom.operators.components import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.passing(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.5 or more; labels are learned from the whole documents table."""
    return bytecnn.passing(docs, table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the least id, then the least hash of its text."""
    return ngramjoin.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", best_fit_packing),
]
#: Tokenisers, trained classifiers and MinHash can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder that the next one reads.

    A table is deleted as soon as the next one is written; the last one stays, for the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            used = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            used.getFileSystem(spark._jsc.hadoopConfiguration()).delete(used, True)
    return docs
