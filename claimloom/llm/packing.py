"""Operator 6, best-fit packing of tokenised documents under several capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths). Pieces go in longest first; each goes to the open
sequence that is best by `fit` among those where every capacity still holds it:

- "norm": the least weighted norm of what would be left,
- "dot": the largest weighted dot product of the piece and what is left.

Lengths are whole numbers up to the capacity, so a piece is known by its length
alone: the driver packs the histogram of lengths (at most `capacity` numbers,
whatever the input), in runs of equal sequences, and the result is a list of
ranges "pieces of this length with ranks a to b go to sequences from s on, at
offset o". Ranks come from counts per (length, hash bucket); a length of n pieces
has √n buckets, so no task ever holds all pieces of a length, however common it
is, nor more bucket counts than pieces. Texts aren't shuffled.

Edge cases: null and empty texts are the end id alone. Repeated rows and rows
with a null id are packed each. A document longer than the capacity is cut into
full pieces, the first piece taking the remainder.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import durable, mapped, small_batches

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"
NAMES = [x.split()[0] for x in PIECES.split(", ")][1:]


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Little-endian 32-bit ids of texts, as the tokenizers library gives them.

    A byte-level BPE vocabulary whose ids follow the order of its merges is run
    by the faster tiktoken engine, with the ranks read from the same file; any
    other file, and a text that the engine can't take (its pattern's stack ends
    in a run of a million blanks), by tokenizers itself.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, pre = spec["model"]["vocab"], spec["model"].get("merges") or [], spec["pre_tokenizer"] or {}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        first = len(vocab.keys() - added.keys()) - len(merges)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        ordered = all(vocab.get("".join(m)) == first + n for n, m in enumerate(pairs))
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.engine, self.tokenizer, self.file = None, None, tokenizer_file
        if plain and ordered and spec["model"]["type"] == "BPE" and first == 256:
            to_byte = byte_alphabet()
            ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in vocab.items() if token not in added}
            self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        if self.engine:
            try:
                return self.engine.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:
                pass
        if not self.tokenizer:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, ids) of each piece."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b - a, ids[4 * a : 4 * b]


def tokenise(documents: DataFrame, tokenizer_file: str, capacity: int, with_ids: bool) -> DataFrame:
    schema, names = (PIECES + ", ids binary", [*NAMES, "ids"]) if with_ids else (PIECES, NAMES)
    end = np.array([END_ID], "<u4").tobytes()

    def make():
        encoder = Encoder(tokenizer_file)

        def cut_up(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for k, text in enumerate(batch["text"]):
                ids = encoder.encode(text if isinstance(text, str) else "") + end
                for piece, (start, length, part) in enumerate(cut(ids, capacity)):
                    crc = zlib.crc32(part)
                    rows.append((k, piece, start, length, crc, crc ^ k * 2654435761 % (1 << 32), *([part] if with_ids else [])))
            return pd.DataFrame(rows, columns=["at", *names])

        return cut_up

    return mapped(small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), ["doc_id"], make, schema)


def plan(histogram: dict[int, int], capacity: int, documents: int, attention: int, fit: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, first rank, end rank, first sequence, offset), and the number of sequences.

    Open sequences of equal content form one group. By the norm, a sequence that
    took a piece is better still for the next of that length, so it's filled
    before another is looked at, and a length splits off at most two more groups.
    By the dot product it's worse than before, so each sequence of the best group
    takes one piece and the next best group is looked for.
    """
    if fit not in ("norm", "dot"):
        raise ValueError(f"fit is norm or dot, not {fit}")
    full = np.array([capacity, documents, attention], float)
    scale = np.array(weights)
    groups: list[list] = []  # [how many, contents as (length, times) runs, tokens, documents, attention left]

    def most(left: tuple, size: int) -> int:
        return int(min(left[0] // size, left[1], left[2] // (size * size)))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        need = np.array([size, 1, size * size], float) / full
        while n:
            fitting = [g for g in groups if most(g[2:], size)]
            if not fitting:
                break
            left = np.array([g[2:] for g in fitting], float) / full
            if fit == "dot":
                best = fitting[int(np.argmax(left @ (scale * need)))]
            else:
                best = fitting[int(np.argmin((((left - need) ** 2) * scale).sum(1)))]
            each = most(best[2:], size) if fit == "norm" else 1
            for times, take in ((each, min(best[0], n // each)), (n % each if n // each < best[0] else 0, 1)):
                if not times or not take or not n:
                    continue
                best[0] -= take
                groups.append([take, [*best[1], (size, times)], best[2] - times * size, best[3] - times, best[4] - times * size * size])
                n -= times * take
            groups = [g for g in groups if g[0]]
        if n:
            # no open sequence takes a piece: what a new one takes, it takes before another is opened
            each = most((capacity, documents, attention), size)
            if not each:
                raise ValueError(f"a piece of {size} tokens fits no sequence")
            for times, take in ((each, n // each), (n % each, 1)):
                if times and take:
                    groups.append([take, [(size, times)], capacity - times * size, documents - times, attention - times * size * size])
    ranks = dict.fromkeys(histogram, 0)
    ranges, sequence = [], 0
    for many, contents, *_ in groups:
        offset = 0
        for size, times in contents:
            for _ in range(times):
                ranges.append((size, ranks[size], ranks[size] + many, sequence, offset))
                ranks[size] += many
                offset += size
        sequence += many
    return ranges, sequence


def pack(documents: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None, fit: str = "norm", with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Without limits of their own, documents (as many as tokens) and attention
    cost (capacity squared) bind only where tokens do.
    """
    import public_tokenizers

    tokenizer_file = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    max_documents, max_attention = max_documents or capacity, max_attention or capacity * capacity
    # kept, so that ranks are counted and given over the very same rows
    cutup = durable(tokenise(documents, tokenizer_file, capacity, with_ids))
    histogram = {r.length: r["count"] for r in cutup.groupBy("length").count().collect()}  # at most capacity rows
    ranges, _ = plan(histogram, capacity, max_documents, max_attention, fit)
    spark = cutup.sparkSession
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)
    buckets = spark.createDataFrame([(k, 1 + math.isqrt(n)) for k, n in sorted(histogram.items())], "size int, buckets int")
    dealt = cutup.join(F.broadcast(buckets), F.col("length") == F.col("size")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "spread"), F.col("buckets")).cast("int")).drop("size", "buckets")
    before = F.sum("n").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(F.col("length").alias("of"), F.col("bucket").alias("part")).agg(F.count("*").alias("n")).select("of", "part", F.coalesce(before, F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(counts, (F.col("length") == F.col("of")) & (F.col("bucket") == F.col("part")))
    kept = [c for c in cutup.columns if c != "spread"]

    def make():
        table = sent.value
        starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

        def placed(batch: pd.DataFrame) -> pd.DataFrame:
            length, rank = batch["of"].to_numpy(), batch["rank"].to_numpy()
            row = np.empty(len(batch), np.int64)
            for size in np.unique(length):
                mine = length == size
                lo, hi = starts[size], starts[size + 1]
                row[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], "right") - 1
            return pd.DataFrame({"sequence_id": table[row, 3] + rank - table[row, 1], "offset": table[row, 4]})

        return placed

    schema = ", ".join(f"{n} {t}" for n, t in cutup.dtypes if n != "spread") + ", sequence_id long, offset long"
    return mapped(ranked.select(*kept, "of", (F.col("within") + F.col("earlier")).alias("rank")), kept, make, schema)
