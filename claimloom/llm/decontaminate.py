"""Operator 5, benchmark decontamination: pigeonhole edit matching.

A test item of n characters may appear in a document with up to k = RATE * n
edits. Cut it into k + 1 pieces: at least one of them is then left whole. So an
Aho-Corasick automaton finds the exact pieces, and around each hit Myers' bit-
parallel algorithm finds the least edit distance between the whole item and any
stretch of the text. Texts are compared lower-cased, with white space collapsed.

Items shorter than SHORT characters have a budget of 0 and match whole words only,
since with edits, or within words, they would be found in ordinary text.

Items go in blocks of BLOCK_CHARS characters, each a pass over the documents, so
the automaton's size doesn't follow the benchmark's; a filter over several blocks
keeps what each pass leaves, so that one automaton is in memory at a time.

Edge cases: null and empty texts match nothing, nor do items that are null or
blank, or whose item_id is null. Items with equal text each get their rows.
Repeated documents each get theirs, those with a null id too. Of several matches
of an item in a document, the one with the least distance, then the leftmost
end, is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import durable, kept_rows, mapped, small_batches

RATE = 0.08
SHORT = 40
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance long, budget long, start long, end long"


def normalise(text) -> str:
    return " ".join(text.lower().split()) if isinstance(text, str) else ""


def budget_of(item: str, rate: float, short: int) -> int:
    return int(rate * len(item)) if len(item) >= short else 0


def apart(text: str, start: int, end: int) -> bool:
    """Does a stretch begin and end where words do?"""
    inside = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not inside and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces and their places."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return out


def myers(peq: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the item to a stretch of text, and the first end of such a stretch."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    get = peq.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | ~(xh | up)) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = (mh | ~(xv | ph)) & full
        down = ph & xv
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, short: int = SHORT):
        import ahocorasick

        same: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            same[text].append(item_id)
        self.items = [(text, ids, budget_of(text, rate, short)) for text, ids in same.items()]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (text, _, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                found[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.some, self.short = bool(found), short
        self.peq: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def match(self, text: str, first: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, start, end) for each item within its budget; just one item's, if the first is enough."""
        if not self.some or not text:
            return []
        places: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.automaton.iter(text):
            for n, at in where:
                places[n].add(last + 1 - size - at)
        out = []
        for n, starts in places.items():
            item, ids, budget = self.items[n]
            length = len(item)
            if not budget:  # the one piece is the item itself
                whole = [start for start in sorted(starts) if length >= self.short or apart(text, start, start + length)]
                if whole:
                    out += [(item_id, 0, 0, whole[0], whole[0] + length) for item_id in ids]
                    if first:
                        break
                continue
            best = None
            reach = -1
            for start in sorted(starts):
                if start + budget <= reach:  # lies in the stretch just read
                    continue
                lo, hi = max(0, start - budget), start + length + budget
                # starts of hits close by share one stretch
                for other in range(start + 1, start + budget + 1):
                    if other in starts:
                        hi = max(hi, other + length + budget)
                        reach = other + budget
                if n not in self.peq:
                    self.peq[n] = (masks(item), masks(item[::-1]))
                distance, end = myers(self.peq[n][0], length, text[lo:hi])
                if distance <= budget and (best is None or (distance, lo + end) < best[:2]):
                    best = (distance, lo + end)
            if best:
                distance, end = best
                _, back = myers(self.peq[n][1], length, text[max(0, end - length - budget) : end][::-1])
                out += [(item_id, distance, budget, end - back, end) for item_id in ids]
                if first:
                    break
        return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, some at a time: the driver holds one block."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null").dropDuplicates().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = normalise(row.text)
        if not text:
            continue
        if size + len(text) > block_chars and items:
            yield items
            items, size = [], 0
        items.append((row.item_id, text))
        size += len(text)
    yield items


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, short: int = SHORT) -> DataFrame:
    """A row per document (doc_id, text) and test item (item_id, text) that it holds within the error budget."""
    chosen = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for items in blocks(benchmark, block_chars):

        def make(items=items):
            matcher = Matcher(items, rate, short)

            def matched(batch: pd.DataFrame) -> pd.DataFrame:
                rows = [(k, *m) for k, text in enumerate(batch["text"]) for m in matcher.match(normalise(text))]
                return pd.DataFrame(rows, columns=["at", "item_id", "distance", "budget", "start", "end"], dtype=np.int64)

            return matched

        part = mapped(chosen, ["doc_id"], make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, short: int = SHORT) -> DataFrame:
    """The rows of documents that hold no test item, with all their columns; nothing is shuffled."""
    passes = 0
    for items in blocks(benchmark, block_chars):

        def decide(items=items):
            matcher = Matcher(items, rate, short)
            return lambda batch: [not matcher.match(normalise(text), first=True) for text in batch["text"]]

        documents = kept_rows(durable(documents) if passes else documents, ["text"], decide)
        passes += 1
    return documents
