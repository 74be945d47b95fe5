"""Search by a table of words: a word's entities are found without a look at the others.

The index is two tables in a folder. postings: word, id and the fields that have
the word (bits of FIELDS), sorted by word within folders by the first two letters,
so that a term reads the row groups of its range in one folder. shown: what
is shown of each entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.batches import dealt

#: Letters that a folder is named by; what begins with others is in one folder.
HEAD = r"^[a-z0-9]{1,2}"
#: Rows of a file of postings, at most.
ROWS = 5_000_000
#: Entities whose words a task finds.
NODES_A_TASK = 25_000
FIELDS = ("own_name", "canonical_name", "aliases", "description")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def head_of(word: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(word, HEAD, 0), F.lit("")), F.lit("_"))


def postings(nodes: DataFrame) -> DataFrame:
    """(head, word, id, fields) of nodes (id, FIELDS, aliases being an array)."""
    texts = {"own_name": F.col("own_name"), "canonical_name": F.col("canonical_name"), "aliases": F.concat_ws(" ", "aliases"), "description": F.col("description")}
    said = F.array(*[F.struct(F.lit(1 << i).alias("bit"), words_of(texts[f]).alias("words")) for i, f in enumerate(FIELDS)])
    rows = nodes.select("id", F.explode(said).alias("s")).select("id", "s.bit", F.explode("s.words").alias("word"))
    return rows.groupBy("word", "id").agg(F.bit_or("bit").alias("fields")).select(head_of(F.col("word")).alias("head"), "word", "id", "fields")


def write_index(nodes: DataFrame, folder: str) -> None:
    """nodes: id, name, type, aliases, description, canonical_name, own_name."""
    nodes.write.mode("overwrite").parquet(f"{folder}/shown")
    # in ranges of the words, so that one that a third of all entities have is spread over several files
    ranged = postings(dealt(nodes, "id", NODES_A_TASK)).repartitionByRange("head", "word", "id").sortWithinPartitions("head", "word", "id")
    ranged.write.mode("overwrite").option("maxRecordsPerFile", ROWS).partitionBy("head").parquet(f"{folder}/postings")


def beginning_with(rows: DataFrame, term: str) -> DataFrame:
    """The postings whose words begin with a term; only the folders and row groups that can have them are read."""
    ascii_ = [c for c in term[:2] if c.isascii() and c.isalnum()]
    if not ascii_:
        return rows.where((F.col("head") == "_") & F.col("word").startswith(term))
    here = F.col("head") == term[:2] if len(ascii_) == len(term[:2]) == 2 else F.col("head").startswith(term[0])
    return rows.where(here & F.col("word").startswith(term))


def found_by_terms(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(id, score): entities of which every term begins a word; score: over the terms, the number of fields with such a word."""
    rows = spark.read.parquet(f"{folder}/postings")
    wanted = list(terms)
    parts = [beginning_with(rows, t).select("id", "fields", F.lit(i).alias("term")) for i, t in enumerate(wanted)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    each = both.groupBy("id", "term").agg(F.bit_or("fields").alias("fields"))
    return each.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.bit_count("fields")).cast("double").alias("score")).where(F.col("n") == len(wanted)).select("id", "score")
