"""Operator 4, LM scoring by a Brown class-based bigram model.

Words of the training documents are counted by a grouped aggregation over all of
them. Each is assigned a class, in two steps:

- The most frequent words (their number grows with the vocabulary, see grown()),
  and all others pooled by their ending (last letter, and whether punctuation
  follows it), are units that exchange clustering assigns to the classes: a unit
  moves to the class that raises the likelihood of the class bigrams most, until
  few move. The number of classes grows with the vocabulary, too.
- Each other word, however rare, takes the class that raises that likelihood
  most given its own left and right neighbours' classes, aggregated by word key,
  and PRIOR occurrences' worth of those of its pool.

Pools are left for words that training never saw, and as neighbours' classes
while the other words are being assigned. The end of a text is a class of its
own and also stands before the first word.

    P(word | before) = P(class | class before) * P(word | class)

Class transitions are counted anew from all words' final classes and smoothed
towards class frequencies. A word's share of its class is by counts, those of
the words of the second step less DISCOUNT; what a pool's words are discounted
belongs to words of that pool that training never saw, in the pool's class.

The HEAD most frequent words travel to the tasks (a bounded table). All other
words of a document are joined by place with their count and class by the word's
64-bit xxhash, which stands for the word in counting too (of a billion words,
two collide in one corpus out of forty); so no task holds the vocabulary; what
is shuffled follows the input. Texts are split once and kept as word numbers.

Edge cases: null and empty texts are one end token. No training row: every c is
0, N and V are 0. Repeated rows are documents of their own, and those with a null
id, which are never held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import durable, in_fold, mapped, raw, small_batches

HELD_OUT = (10, 0)
#: Least classes, and least and most words of the exchange; the most bounds its pair table on the driver, at (words + POOLS)^2.
CLASSES = 48
#: Most classes: a place packs a class in twelve bits, and the driver holds (classes)^2 counts. Reached at 60 billion distinct words.
MOST_CLASSES = 4000
CLUSTERED = 1500
MOST_CLUSTERED = 2500
HEAD = 200_000
#: Longest word, in bytes, in the head table: 64 bytes a word bound it.
HEAD_BYTES = 48
SLICES = 1024
DISCOUNT = 0.6
PRIOR = 1.0
#: Neighbours of words that a task gathers before it hands them on.
GATHER = 2_000_000
#: Words that training has more often than this have their neighbours added up in SALTS tasks first.
SALTED_FROM, SALTS = 1_000_000, 64
#: Distinct words that a task counts before it hands them on.
FLUSH = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PUNCTUATION = frozenset(b".,;:!?)]}\"'")
POOLS = 768
#: How often a class is a word's left (at below the number of classes) or right neighbour; more than 255 times in several entries.
ENTRY = np.dtype([("at", "<u2"), ("n", "u1")])


def tokens(text) -> list[bytes]:
    return raw(text).translate(LOWER).split()


def pool(word: bytes) -> int:
    """The number of a word's pool: by what ends it, in 3 x 256 kinds."""
    last = word[-1]
    if last not in PUNCTUATION:
        return last
    at = len(word) - 1
    while at >= 0 and word[at] in PUNCTUATION:
        at -= 1
    return (256 if last == 46 else 512) + (word[at] if at >= 0 else 0)


def grown(types: int) -> tuple[int, int]:
    """Classes, and words of the exchange, for a vocabulary of so many words."""
    return min(MOST_CLASSES, max(CLASSES, round(types ** (1 / 3)))), min(MOST_CLUSTERED, max(CLUSTERED, round(2 * types**0.5)))


def exchange(before: np.ndarray, after: np.ndarray, n: np.ndarray, units: int, classes: int, rounds: int = 6, fixed: int = 0) -> np.ndarray:
    """A class for each unit, from bigram counts (before, after, n) of units.

    Unit `fixed` has class 0 to itself. The others begin dealt by frequency.
    """
    total = np.bincount(before, weights=n, minlength=units) + np.bincount(after, weights=n, minlength=units)
    order = [u for u in np.argsort(-total, kind="stable").tolist() if u != fixed and total[u]]
    own = np.zeros(units, np.int64)
    k = max(2, classes)
    for i, u in enumerate(order):
        own[u] = 1 + i % (k - 1)
    self_loop = np.zeros(units)
    same = before == after
    np.add.at(self_loop, before[same], n[same])
    rows, columns = np.lexsort((after, before)), np.lexsort((before, after))
    row_at, column_at = np.searchsorted(before[rows], np.arange(units + 1)), np.searchsorted(after[columns], np.arange(units + 1))
    table = np.zeros((k, k))
    np.add.at(table, (own[before], own[after]), n)

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(rounds):
        moved = 0
        for u in order:
            r, c = rows[row_at[u] : row_at[u + 1]], columns[column_at[u] : column_at[u + 1]]
            r, c = r[after[r] != u], c[before[c] != u]
            right = np.bincount(own[after[r]], weights=n[r], minlength=k)
            left = np.bincount(own[before[c]], weights=n[c], minlength=k)
            loop, a = self_loop[u], own[u]
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= loop
            sums_out, sums_in = table.sum(1) + left, table.sum(0) + right  # as the unit's neighbours stay, wherever it goes
            grown_rows = h(table + right[None, :]).sum(1) - h(table).sum(1)
            grown_columns = h(table + left[:, None]).sum(0) - h(table).sum(0)
            d = table.diagonal()
            corner = h(d + right + left + loop) - h(d + right) - h(d + left) + h(d)
            gain = grown_rows + grown_columns + corner
            gain -= h(sums_out + right.sum() + loop) - h(sums_out)
            gain -= h(sums_in + left.sum() + loop) - h(sums_in)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            own[u] = b
            table[b, :] += right
            table[:, b] += left
            table[b, b] += loop
        if moved < 0.01 * units:
            break
    return own


def word_counts(training: DataFrame) -> DataFrame:
    """(word binary, key, pool, c) over all words of training (text), without ends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def out(seen: Counter) -> Iterator[pd.DataFrame]:
            got = list(seen)
            for at in range(0, len(got), 50_000):
                part = got[at : at + 50_000]
                yield pd.DataFrame({"word": part, "key": np.fromiter(map(xxhash.xxh64_intdigest, part), np.uint64, len(part)).view(np.int64), "pool": np.fromiter(map(pool, part), np.int32, len(part)), "n": np.fromiter(map(seen.__getitem__, part), np.int64, len(part))})

        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield from out(seen)
                    seen = Counter()
        yield from out(seen)

    return training.mapInPandas(count, "word binary, key long, pool int, n long").groupBy("key").agg(F.first("word").alias("word"), F.first("pool").alias("pool"), F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The frequent words, most frequent first: `most` or a little fewer.

    The cut is found by steps of a sixteenth of an octave of counts, a few
    hundred numbers, and within the last step by slices of the words' hashes, so
    that no task sends more than its share of the words to the driver.
    """
    short = counts.where(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("c") * 16).cast("int")).withColumn("slice", F.pmod(F.col("key"), F.lit(SLICES)).cast("int"))
    sizes = sorted(((r.step, r["count"]) for r in short.groupBy("step").count().collect()), reverse=True)
    total, whole, last, slices = 0, 1 << 30, -1, 0
    for step, n in sizes:
        if total + n > most:
            last = step
            for at, n in sorted((r.slice, r["count"]) for r in short.where(F.col("step") == step).groupBy("slice").count().collect()):
                if total + n > most:
                    break
                total, slices = total + n, at + 1
            break
        total, whole = total + n, step
    got = short.where((F.col("step") >= whole) | ((F.col("step") == last) & (F.col("slice") < slices))).select("word", "c", "pool").toArrow()
    head = pd.DataFrame({"word": pd.Series(got.column("word").to_pylist(), dtype=object), "c": got.column("c").to_numpy(), "pool": got.column("pool").to_numpy()})
    return head.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def stretches(batch: pd.DataFrame, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The rows of a batch of coded texts, about a million words at a time."""
    ends = batch["n_tokens"].cumsum().to_numpy()
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.iloc[at:to]
        at = to


def flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the batch's texts in a row, from the end before the first; and the keys of those below 0."""
    codes = b"".join(pa.decompress(x, 4 * n, "zstd", asbytes=True) for x, n in zip(batch["codes"], batch["n_tokens"].tolist(), strict=True))
    return np.concatenate(([0], np.frombuffer(codes, np.int32))), np.frombuffer(b"".join(batch["keys"]), np.int64)


def affinity(table: np.ndarray) -> np.ndarray:
    """What a left neighbour of each class, then a right one, adds to the log-likelihood of a word's being in each class."""
    mass, out = table.sum(0), table.sum(1)
    share = (mass + 0.5) / (mass.sum() + 0.5 * len(table))
    chance = np.log((table + 2.0 * share[None, :]) / (out[:, None] + 2.0))
    got = np.concatenate((chance - np.log(share)[None, :], (chance - np.log(share)[None, :]).T))
    got[:, mass == 0] = -1e6
    got[:, 0] = -1e9  # the end's own
    return got


def score_lm(documents: DataFrame, held_out: tuple[int, int] = HELD_OUT, classes: int | None = None, clustered: int | None = None, head_words: int = HEAD, salted_from: int = SALTED_FROM) -> DataFrame:
    """A row per row of documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    import xxhash

    spark = documents.sparkSession
    doc_id = F.col("doc_id").cast("long")
    chosen = small_batches(documents).select(doc_id.alias("doc_id"), in_fold(doc_id, *held_out).alias("held_out"), F.col("text").alias("text"))
    training = chosen.where("not held_out").select("text")
    counts = durable(word_counts(training))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n_all, v_all = totals.n + ends, totals.v + (1 if ends else 0)
    head = frequent(counts, head_words)
    k, most = grown(totals.v)
    if classes is not None and classes > MOST_CLASSES:
        raise ValueError(f"at most {MOST_CLASSES} classes, not {classes}")
    k, clustered = max(2, k if classes is None else classes), min(most if clustered is None else clustered, len(head))
    shift, units = 1 + clustered, 1 + clustered + POOLS
    # training words that the exchange doesn't assign, by pool
    types = np.zeros(POOLS)
    for r in counts.groupBy("pool").count().collect():
        types[r.pool] = r["count"]
    np.subtract.at(types, head["pool"][:clustered].to_numpy(np.int64), 1)
    # codes: 0 the end, from 1 the head words, below 0 other words' pools; by code from -POOLS on
    head_c = np.concatenate(([ends], head["c"].to_numpy(np.int64)))
    head_pool = np.concatenate(([0], head["pool"].to_numpy(np.int64)))
    head_key = np.concatenate(([0], np.fromiter(map(xxhash.xxh64_intdigest, head["word"]), np.uint64, len(head)).view(np.int64)))
    unit_of = np.concatenate((units - 1 - np.arange(POOLS), np.arange(shift), shift + head_pool[shift:]))
    sent_words = spark.sparkContext.broadcast({w: 1 + i for i, w in enumerate(head["word"])})
    del head

    def make_encoder():
        import xxhash

        known = sent_words.value
        memo: dict[bytes, int] = {}
        code_of, key_of = np.zeros(0, np.int32), np.zeros(0, np.int64)
        number = TaskContext.get().partitionId() << 40

        def encode(batch: pd.DataFrame) -> pd.DataFrame:
            nonlocal memo, code_of, key_of, number
            if len(memo) > FLUSH:
                memo, code_of, key_of = {}, code_of[:0], key_of[:0]
            split = [tokens(t) for t in batch["text"]]
            codes, keys = [], []
            for found in split:
                for w in set(found).difference(memo):
                    memo[w] = len(memo)
                    c = known.get(w)
                    codes.append(c or -1 - pool(w))
                    keys.append(0 if c else xxhash.xxh64_intdigest(w))
            code_of = np.concatenate((code_of, np.array(codes, np.int32)))
            key_of = np.concatenate((key_of, np.array(keys, np.uint64).view(np.int64)))
            out = []
            for i, found in enumerate(split):
                ids = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
                c = code_of[ids]
                out.append((number + i, len(ids) + 1, pa.compress(c.tobytes() + bytes(4), "zstd", asbytes=True), key_of[ids[c < 0]].tobytes()))
            number += len(out)
            return pd.DataFrame(out, columns=["row", "n_tokens", "codes", "keys"])

        return encode

    coded = durable(mapped(chosen, ["doc_id", "held_out"], make_encoder, "row long, n_tokens long, codes binary, keys binary, doc_id long, held_out boolean"))
    learned = coded.where("not held_out")

    def merged(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair, of = np.unique(pair, return_inverse=True)
        return pair, np.bincount(of, weights=n, minlength=len(pair)).astype(np.int64)

    def pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in (x for b in batches for x in stretches(b)):
            u = unit_of[flat(batch)[0] + POOLS]
            seen.append(u[:-1] * units + u[1:])
            size += len(u)
            if size > GATHER:
                some = np.unique(np.concatenate(seen), return_counts=True)
                total, seen, size = merged(*map(np.concatenate, zip(total, some, strict=True))), [], 0
        if seen:
            some = np.unique(np.concatenate(seen), return_counts=True)
            total = merged(*map(np.concatenate, zip(total, some, strict=True)))
        yield pd.DataFrame({"pair": total[0], "n": total[1]})

    # at most units x units rows, whatever the input
    pairs = learned.mapInPandas(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    code, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy().astype(np.float64)
    order = np.argsort(code)
    before, after, n = (code[order] // units).astype(np.int32), (code[order] % units).astype(np.int32), n[order]
    del pairs, code, order
    own = exchange(before, after, n, units, k)
    table = np.zeros((k, k))
    np.add.at(table, (own[before], own[after]), n)
    gain = affinity(table)
    around = np.zeros((POOLS, 2 * k))  # the classes left and right of each pool's words
    at = after >= shift
    np.add.at(around, (after[at] - shift, own[before[at]]), n[at])
    at = before >= shift
    np.add.at(around, (before[at] - shift, k + own[after[at]]), n[at])
    prior = PRIOR * (around / np.maximum(around[:, :k].sum(1, keepdims=True), 1.0)) @ gain
    del before, after, n, at
    class_of_unit = own.astype(np.int64)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, code, salt, around): how often each class stands beside a word that the exchange didn't assign. salt: 0, or of very frequent words, so that their rows go to many tasks first."""
        own_salt = 1 + TaskContext.get().partitionId() % SALTS

        def out(parts: list) -> Iterator[pa.RecordBatch]:
            code, key, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, word = np.unique(key, return_index=True, return_inverse=True)
            pair, n = np.unique(np.concatenate((word * (2 * k) + left, word * (2 * k) + k + right)), return_counts=True)
            times = (n + 254) // 255
            pair, n = np.repeat(pair, times), np.repeat(n, times) - 255 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            what = np.zeros(len(pair), ENTRY)
            what["at"], what["n"] = pair % (2 * k), np.minimum(n, 255)
            start = np.searchsorted(pair, np.arange(len(u) + 1) * (2 * k))
            code = code[first].astype(np.int32)
            salt = np.where(head_c[np.maximum(code, 0)] * (code > 0) > salted_from, own_salt, 0).astype(np.int32)
            for a in range(0, len(u), 50_000):
                b = min(len(u), a + 50_000)
                offsets = ((start[a : b + 1] - start[a]) * ENTRY.itemsize).astype(np.int32)
                data = what[start[a] : start[b]].tobytes()
                around = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(u[a:b]), pa.array(code[a:b]), pa.array(salt[a:b]), around], names=["key", "code", "salt", "around"])

        parts, size = [], 0
        for batch in (x for b in batches for x in stretches(b.to_pandas())):
            code, cold = flat(batch)
            c = class_of_unit[unit_of[code + POOLS]]
            key = head_key[np.maximum(code, 0)]
            key[code < 0] = cold
            at = np.flatnonzero((code < 0) | (code >= shift))
            parts.append((code[at], key[at], c[at - 1], c[at + 1]))
            size += len(at)
            if size > GATHER:
                yield from out(parts)
                parts, size = [], 0
        if parts:
            yield from out(parts)

    def summed(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, codes, salts, their classes' sums) of rows sorted by key and salt, some at a time: what is held is a batch, and the sums of the word that goes on in the next.

        packed: rows are of ENTRY, else of sums.
        """
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, code, salt = (batch.column(c).to_numpy() for c in ("key", "code", "salt"))
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            first = np.flatnonzero(new)
            rows = batch.column("around").to_pylist()
            if packed:
                what = np.frombuffer(b"".join(rows), ENTRY)
                word = np.repeat(np.cumsum(new) - 1, [len(x) // ENTRY.itemsize for x in rows])
                sums = np.bincount(word * (2 * k) + what["at"], weights=what["n"], minlength=len(first) * 2 * k).reshape(-1, 2 * k)
            else:
                sums = np.add.reduceat(np.frombuffer(b"".join(rows), np.float64).reshape(-1, 2 * k), first)
            key, code, salt = key[first], code[first], salt[first]
            if held is not None:
                if (held[0][0], held[2][0]) == (key[0], salt[0]):
                    sums[0] += held[3][0]
                else:
                    yield held
            if len(key) > 1:
                yield key[:-1], code[:-1], salt[:-1], sums[:-1]
            held = key[-1:], code[-1:], salt[-1:], sums[-1:].copy()
        if held is not None:
            yield held

    def assign(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
        """(key, code, c, class) of each word, or the sums of one that has more in other tasks."""
        for key, code, salt, sums in summed(batches, packed):
            best = (sums @ gain + prior[np.where(code < 0, -1 - code, head_pool[np.maximum(code, 0)])]).argmax(1)
            around = pa.array([x.tobytes() if s else None for x, s in zip(sums, salt.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(code), pa.array(sums[:, :k].sum(1).astype(np.int64)), pa.array(best.astype(np.int32)), around], names=["key", "code", "c", "class", "around"])

    # no row and no task gathers a word's neighbours: rows of a word come one after another and are added up;
    # those of very frequent words in SALTS tasks first, each of which hands on one row of sums
    kinds = "key long, code int, c long, class int, around binary"
    found = learned.mapInArrow(neighbours, "key long, code int, salt int, around binary")
    assigned = durable(found.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lambda b: assign(b, True), kinds))
    if (head_c[shift:] > salted_from).any():
        sums = assigned.where("around is not null").select("key", "code", F.lit(0).alias("salt"), "around")
        again = sums.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: assign(b, False), kinds)
        assigned = durable(assigned.where("around is null").unionByName(again))
    assigned = assigned.drop("around")
    # the final classes of codes, and what they weigh
    pool_class = class_of_unit[shift:]
    class_of = np.concatenate((np.full(POOLS, -1), class_of_unit[:shift], np.zeros(len(head_c) - shift, np.int64)))
    others = assigned.where("code > 0").select("code", "class").toArrow()
    class_of[POOLS + others.column("code").to_numpy()] = others.column("class").to_numpy()
    weight = np.bincount(class_of_unit[:shift], weights=head_c[:shift], minlength=k)
    for r in assigned.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        weight[r["class"]] += r.n - DISCOUNT * r.v
    # a pool that training never saw is still possible: half a token to each
    unseen = DISCOUNT * types + 0.5
    weight += np.bincount(pool_class, weights=unseen, minlength=k)
    log_weight = np.log10(np.maximum(weight, 1e-9))
    unseen = np.log10(unseen) - log_weight[pool_class]
    base_bottom = n_all + 0.1 * (v_all + 1)
    base_of = np.concatenate((np.zeros(POOLS), np.log10((head_c + 0.1) / base_bottom)))
    taken = np.concatenate((np.zeros(shift), np.full(len(head_c) - shift, DISCOUNT)))
    emit_of = np.concatenate((np.zeros(POOLS), np.log10(np.maximum(head_c - taken, 1e-9)) - log_weight[class_of[POOLS:]]))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per place of a word that is not in the head table: its text (twice the row, and 1 if held out), key, and packed place, pool and classes beside it, 0 for such a word, else from 1."""
        for batch in (x for b in batches for x in stretches(b)):
            code, key = flat(batch)
            at = np.flatnonzero(code < 0)
            c = class_of[code + POOLS]
            text = np.searchsorted(batch["n_tokens"].cumsum().to_numpy(), at, "left")
            place = at.astype(np.int64) << 34 | (-1 - code[at]).astype(np.int64) << 24 | (c[at - 1] + 1) << 12 | (c[at + 1] + 1)
            whole = 2 * batch["row"].to_numpy() + batch["held_out"].to_numpy(np.int64)
            out = pd.DataFrame({"of": whole[text], "key": key, "place": place})
            for a in range(0, len(out), 100_000):
                yield out[a : a + 100_000]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class pairs with such words, and what the words themselves give, per text."""
        for batch in batches:
            n = batch.num_rows
            text = np.repeat(np.arange(n), batch.column("place").value_lengths().to_numpy())
            place, own, c = (batch.column(x).flatten().to_numpy() for x in ("place", "class", "c"))
            order = np.lexsort((place, text))
            place, own, c = place[order], own[order], c[order]
            kind, left, right = place >> 24 & 1023, (place >> 12 & 4095) - 1, (place & 4095) - 1
            own = np.where(c > 0, own, pool_class[kind])
            left = np.where(left >= 0, left, np.roll(own, 1))
            to_right = right >= 0
            pair = np.concatenate((left * k + own, (own * k + right)[to_right])).astype(np.int32)
            of = np.concatenate((text, text[to_right]))
            order = np.argsort(of, kind="stable")
            pair, start = pair[order], np.searchsorted(of[order], np.arange(n + 1))
            emit = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, 0.1)) - log_weight[own], unseen[kind])
            by_text = [np.bincount(text, weights=x, minlength=n) for x in (np.log10((c + 0.1) / base_bottom), emit, c > 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("of"), pa.array([pair[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary()), pa.array(by_text[0]), pa.array(by_text[1]), pa.array(by_text[2].astype(np.int64))],
                names=["of", "pairs", "cold_base", "cold_emit", "cold_known"],
            )

    known = assigned.select(F.col("key").alias("k"), "c", "class")
    lists = [F.collect_list(x).alias(x) for x in ("place", "class", "c")]
    found = (
        coded.mapInPandas(places, "of long, key long, place long")
        .join(known, F.col("key") == F.col("k"), "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .withColumn("class", F.coalesce("class", F.lit(-1)))
        .groupBy("of")
        .agg(*lists)
    )
    resolved = durable(found.mapInArrow(resolve, "of long, pairs binary, cold_base double, cold_emit double, cold_known long"))

    def head_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(k * k, np.int64)
        for batch in (x for b in batches for x in stretches(b)):
            c = class_of[flat(batch)[0] + POOLS]
            both = (c[:-1] >= 0) & (c[1:] >= 0)
            seen += np.bincount((c[:-1] * k + c[1:])[both], minlength=k * k)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"pair": some, "n": seen[some]})

    def cold_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pair, n = np.unique(np.frombuffer(b"".join(batch["pairs"]), np.int32), return_counts=True)
            yield pd.DataFrame({"pair": pair.astype(np.int64), "n": n.astype(np.int64)})

    found = learned.mapInPandas(head_pairs, "pair long, n long").unionByName(resolved.where("of % 2 = 0").select("pairs").mapInPandas(cold_pairs, "pair long, n long"))
    table = np.zeros(k * k)
    sums = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most k x k rows
    table[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    table = table.reshape(k, k)
    mass = table.sum(0)
    share = (mass + 0.5) / (mass.sum() + 0.5 * k)
    step = np.log10((table + 2.0 * share[None, :]) / (table.sum(1, keepdims=True) + 2.0))
    steps = step.ravel()

    def part(batch: pd.DataFrame) -> pd.DataFrame:
        """What the head words give, per text."""
        sums = []
        for some in stretches(batch):
            code = flat(some)[0]
            c = class_of[code + POOLS]
            text = np.repeat(np.arange(len(some)), some["n_tokens"])
            both = (c[:-1] >= 0) & (c[1:] >= 0)
            code = code[1:]
            model = emit_of[code + POOLS] + np.where(both, steps[np.where(both, c[:-1] * k + c[1:], 0)], 0.0)
            known = code > 0 if not ends else code >= 0
            sums.append([np.bincount(text, weights=x, minlength=len(some)) for x in (known, base_of[code + POOLS], model)])
        known, base, model = map(np.concatenate, zip(*sums, strict=True))
        return pd.DataFrame({"n_known": known.astype(np.int64), "base": base, "model": model})

    def cold_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = [e + steps[np.frombuffer(p, np.int32)].sum() for p, e in zip(batch["pairs"], batch["cold_emit"], strict=True)]
            yield pd.DataFrame({"at": batch["of"] // 2, "cold_base": batch["cold_base"], "cold_known": batch["cold_known"], "cold_model": model})

    plain = coded.select("doc_id", "row", "held_out", F.col("n_tokens").alias("tokens"), "n_tokens", "codes", "keys")
    parts = mapped(plain, ["row", "doc_id", "held_out", "tokens"], lambda: part, "row long, doc_id long, held_out boolean, tokens long, n_known long, base double, model double")
    cold = resolved.mapInPandas(cold_part, "at long, cold_base double, cold_known long, cold_model double")
    score = F.col("model") + F.coalesce("cold_model", F.lit(0.0))
    return parts.join(cold, F.col("row") == F.col("at"), "left").select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("tokens")).alias("perplexity"),
    )
