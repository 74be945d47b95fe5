"""Operator 7, n-gram Jaccard join by MinHash banding.

Documents whose sets of five-word shingles have Jaccard similarity of THRESHOLD
or more are linked. Documents with equal sets form one class first, and each
class takes part once. A class has BANDS x ROWS MinHash values; classes that
agree on a whole band meet in a bucket. Bands and rows follow from the target
recall: BANDS is the least number for which 1 - (1 - t^ROWS)^BANDS reaches it.

Buckets with the same members are one bucket. A large bucket is cut into blocks
by hash, and a task gets two blocks of it: it compares them on their full sets
by matrix products and gives back, per class, how many documents it is linked
to, and a spanning forest of the links. Pairs are counted in the first band that
they share, and are never rows of a table; no link is left out. Groups of links
are then closed by alternating large-star and small-star steps.

Edge cases: fewer than five words: one shingle of all words. Null, empty and
blank texts have no shingles: each is a class by itself, with no link. Repeated
rows are copies of each other, as are rows with one text and several ids or
none; null ids are greater than all others, so copy_of and class_id are null
only where no row of the set or the group has an id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import SPACES, durable, mapped, small_batches, words
from claimloom.operators.components import components

N = 5
THRESHOLD = 0.8
ROWS = 5
RECALL = 0.9999
#: Classes and shingles of a bucket that one block holds.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 2_000_000
#: Distinct words of which a task keeps hashes.
MEMO = 200_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Shingler:
    def __init__(self, n: int, rows: int, bands: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n, self.rows, self.bands = n, rows, bands
        self.factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = (rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)[:, None]
        self.mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.memo: dict[bytes, int] = {}

    @staticmethod
    def scramble(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def shingles(self, text) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        import xxhash

        found = words(text)
        if not found:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = self.scramble(total + h[k : len(h) - n + 1 + k] * self.factors[k]) if k == n - 1 else total + h[k : len(h) - n + 1 + k] * self.factors[k]
        return np.unique(total + np.uint64(n < self.n))

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band, as signed."""
        low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        least = np.full(self.rows * self.bands, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            np.minimum(least, (low[None, at : at + 1024] * self.a + self.b).min(1), out=least)
        mixed = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(1) + self.salt
        return self.scramble(mixed).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what all links connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common; a product over some thousand shingles at a time."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1  # shingles of one set alone are in no intersection
    group, owner = group[often], owner[often]
    out = np.zeros((m, m), np.float32)
    if not len(group):
        return out
    group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    step = 8192
    edges = np.searchsorted(group, np.arange(0, group[-1] + step + 1, step))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if hi > lo:
            part = np.zeros((m, step), np.float32)
            part[owner[lo:hi], group[lo:hi] - k * step] = 1
            out += part @ part.T
    return out


def compare(sets: list[np.ndarray], bands: np.ndarray, copies: np.ndarray, side: np.ndarray | None, band: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked documents of each class within this task's pairs, and a forest of the links.

    side: which of two blocks each class is in, where pairs across them count;
    none for one block with itself.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float32)
    both = np.zeros((1, 1), np.float32)
    if m == 2:
        both = np.zeros((2, 2), np.float32)
        both[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        both = shared(sets)
    linked = np.triu(both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-3, 1)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    left, right = np.nonzero(linked)
    exact = both[left, right].astype(np.float64) / (sizes[left].astype(np.float64) + sizes[right] - both[left, right])
    keep = (exact >= threshold) & ~(bands[left, :band] == bands[right, :band]).any(1)
    left, right = left[keep], right[keep]
    count = np.bincount(left, weights=copies[right], minlength=m) + np.bincount(right, weights=copies[left], minlength=m)
    return count.astype(np.int64), forest(m, left, right)


def linked(documents: DataFrame, n: int, threshold: float, rows: int, recall: float) -> DataFrame:
    """A row per row of documents: doc_id, text_hash, n_shingles, copy_of, class_id, n_links, group (a digest; null without shingles)."""
    bands = bands_for(threshold, rows, recall)
    texts = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash"), F.col("text").alias("text"))

    def make():
        own = Shingler(n, rows, bands)

        def sign(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for text in batch["text"]:
                s = own.shingles(text)
                out.append((len(s), set_digest(s) if len(s) else None, own.band_keys(s) if len(s) else None))
            return pd.DataFrame(out, columns=["n_shingles", "digest", "keys"])

        return sign

    signed = durable(mapped(texts, ["doc_id", "text_hash"], make, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>"))
    # of the rows of a class, the one with the least id has its text read again
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    classes = durable(signed.where("digest is not null").groupBy("digest").agg(one, F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")))
    keyed = classes.select("digest", F.xxhash64("digest").alias("member"), F.col("n_shingles").alias("size"), F.posexplode("keys").alias("band", "key"))
    buckets = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.col("member").cast("decimal(38,0)")).alias("s"), F.bit_xor("member").alias("x"), F.min("member").alias("least"), F.first("band").alias("band"), F.sum("size").alias("load"))
        .where("n > 1")
        .groupBy("n", "s", "x", "least")
        .agg(F.min(F.struct("band", "key")).alias("at"), F.first("load").alias("load"))
        .select(F.col("at.key").alias("bucket"), F.col("at.band").alias("bucket_band"), F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("load") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int")
    members = durable(
        keyed.join(buckets, F.col("key") == F.col("bucket"))
        .select("digest", "bucket", "bucket_band", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("digest", "bucket", "bucket_band", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    wanted = members.select(F.col("digest").alias("met")).distinct()
    heads = classes.join(wanted, F.col("digest") == F.col("met")).select("digest", "copies", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))

    def make_reader():
        own = Shingler(n, rows, bands)

        def full(batch: pd.DataFrame) -> pd.DataFrame:
            sets = [own.shingles(text) for text in batch["text"]]
            return pd.DataFrame({"shingles": [s.tobytes() for s in sets], "keys": [own.band_keys(s).tobytes() for s in sets]})

        return full

    # rows that repeat in id and text are one
    read = texts.join(heads, (F.col("text_hash") == F.col("one_hash")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("digest", "copies", "text").dropDuplicates(["digest"])
    sets = mapped(read, ["digest", "copies"], make_reader, "digest binary, copies long, shingles binary, keys binary").withColumnRenamed("digest", "head")
    tasks = members.join(sets, F.col("digest") == F.col("head")).select("bucket", "bucket_band", "lo", "hi", "own", "digest", "copies", "shingles", "keys")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group = None, []

        def done() -> pd.DataFrame:
            _, lo, hi = at
            side = np.array([g.own != lo for g in group]) if lo != hi else None
            sets, keys = [np.frombuffer(g.shingles, np.uint64) for g in group], np.stack([np.frombuffer(g.keys, np.int64) for g in group])
            count, links = compare(sets, keys, np.array([g.copies for g in group]), side, group[0].bucket_band, threshold)
            some = np.flatnonzero(count).tolist()
            return pd.DataFrame([(group[i].digest, None, int(count[i])) for i in some] + [(group[i].digest, group[j].digest, None) for i, j in links], columns=["a", "b", "links"]).astype({"links": "Int64"})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.bucket, row.lo, row.hi) != at:
                    if len(group) > 1:
                        yield done()
                    at, group = (row.bucket, row.lo, row.hi), []
                group.append(row)
        if len(group) > 1:
            yield done()

    dealt = tasks.repartition(F.col("bucket"), F.col("lo"), F.col("hi")).sortWithinPartitions("bucket", "lo", "hi", "digest")
    found = durable(dealt.mapInPandas(pairs, "a binary, b binary, links long"))
    counted = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = classes.select(F.col("digest").alias("own"), F.col("one.doc_id").alias("copy_of"), "copies")
    joined = named.join(roots.withColumnRenamed("node", "at"), F.col("own") == F.col("at"), "left").withColumn("root", F.coalesce("root", "own"))
    least = durable(joined.groupBy("root").agg(F.min("copy_of").alias("class_id")).withColumnRenamed("root", "top"))
    joined = joined.join(least, F.col("root") == F.col("top")).join(counted, F.col("own") == F.col("a"), "left")
    # kept, so that the last join is one of two tables, which may be split where a text has very many copies
    final = durable(joined.select("own", "copy_of", "class_id", F.col("root").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    without = F.col("digest").isNull()
    return (
        signed.drop("keys")
        .join(final, F.col("digest") == F.col("own"), "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(without, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
            F.when(without, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "group",
        )
    )


def jaccard_join(documents: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row per row of documents (doc_id, text): doc_id, n_shingles, copy_of, class_id, n_links.

    copy_of: the least id with an equal set; class_id: the least id of those it
    is linked to directly or through others; n_links: other documents with
    similarity of the threshold or more, equal sets included.
    """
    return linked(documents, n, threshold, rows, recall).drop("text_hash", "group")


def one_of_each(documents: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """Of each group of linked rows of documents one, with all its columns: that of the least id, then the least hash of its text.

    Of rows that repeat in id and text, the one whose columns are least as JSON
    stays. Rows without words are in no group, and stay.
    """
    rowwise = durable(linked(documents, n, threshold, rows, recall).where("group is not null").groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("times")))
    best = rowwise.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "times")).alias("best"))
    best = durable(best.select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"), F.col("best.times").alias("times")))
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.col("text")).alias("row_hash"), (F.coalesce(F.length(F.translate(F.col("text"), SPACES, "")), F.lit(0)) == 0).alias("blank"))
    same = (F.col("row_hash") == F.col("best_hash")) & F.col("row_id").eqNullSafe(F.col("best_id"))
    once = whole.join(best.where("times = 1"), same, "left").where("blank or times is not null").select("row.*")
    repeated = best.where("times > 1")
    if repeated.isEmpty():
        return once
    chosen = whole.join(repeated, same).groupBy("row_id", "row_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(chosen.select("row.*"))
