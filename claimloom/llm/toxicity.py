"""Operator 3, toxicity: a linear classifier on character n-grams scaled by naive Bayes.

Features are the character n-grams (2 to 6 code points, hashed) of a document's
distinct lower-cased words with a space on either side, present or absent. Each
feature is scaled by its naive Bayes log-count ratio between the two labels, and
a logistic regression is fitted on the scaled features.

The fit reads a bounded sample of labelled texts (PER_CLASS of either label, by
hash of the id); the intercept is then set back to the odds that all labelled
rows outside the held-out fold show.

Edge cases: null or empty text: no feature, the intercept's score. No labelled
row, or rows of one label only: the share of label 1 (0.0 if none) for all. Null
ids are scored and never held out; repeated rows each get their row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import in_fold, labelled_sample, mapped, sigmoid, small_batches

#: Bound of the training sample: so many texts of either label at most.
PER_CLASS = 2000
BITS = 20
BLOCK = 250
SIZES = (2, 3, 4, 5, 6)
HELD_OUT = (4, 2)
THRESHOLD = 0.3
MULTIPLIER = np.uint32(0x9E3779B1)


def features(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams."""
    found = set(text.lower().split())
    if not found:
        return np.zeros(0, np.int32)
    code = np.frombuffer((" " + " ".join(found) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.concatenate(([0], np.cumsum(code == 32)))
    rolled, out = code * MULTIPLIER, []
    for n in range(2, SIZES[-1] + 1):
        if len(code) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n - 1 :] * MULTIPLIER
        if n in SIZES:
            within = space[n - 1 : len(code)] - space[1 : len(code) - n + 2] if n > 2 else np.zeros(len(code) - 1, np.int64)
            key = rolled[within == 0]
            key = (key ^ (key >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append((key >> np.uint32(32 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


def fit(rows: list[tuple[str, int]], counts: tuple[int, int], rounds: int = 80, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and the intercept."""
    weights = np.zeros(1 << BITS, np.float32)
    total = sum(counts)
    share = counts[1] / total if total else 0.0
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return weights, math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    docs = [features(text) for text, _ in rows]
    sizes = np.array([len(x) for x in docs])
    flat = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    positive = np.bincount(flat, weights=y[owner], minlength=1 << BITS)
    everywhere = np.bincount(flat, minlength=1 << BITS)
    p, q = positive + 1.0, everywhere - positive + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    enough = everywhere >= 3
    used = np.flatnonzero(enough)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    scale = ratio[used].astype(np.float32)
    at = place[flat]
    at, owner = at[at >= 0], owner[at >= 0]
    norm = np.float32(1.0 / np.sqrt(max(1.0, np.mean(np.bincount(owner, weights=scale[at] ** 2, minlength=len(y))))))
    scale *= norm
    cuts = np.searchsorted(owner, np.arange(0, len(y) + BLOCK, BLOCK))  # in blocks of documents, for memory
    w = np.zeros(len(used) + 1, np.float64)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        slope = np.zeros_like(w)
        reach = (w[:-1] * scale).astype(np.float32)
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            mine, label = owner[lo:hi] - k * BLOCK, y[k * BLOCK : (k + 1) * BLOCK]
            error = (sigmoid(np.bincount(mine, weights=reach[at[lo:hi]], minlength=len(label)) + w[-1]) - label) / len(y)
            slope[:-1] += np.bincount(at[lo:hi], weights=error[mine], minlength=len(used))
            slope[-1] += error.sum()
        slope[:-1] = slope[:-1] * scale + ridge * w[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights[used] = w[:-1] * scale
    drawn = y.mean()
    prior = math.log(share / (1 - share)) - math.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    return weights, float(w[-1] + prior)


def score_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of documents (doc_id, text): doc_id, held_out, score, predicted."""
    weights, intercept = fit(*labelled_sample(documents, labels, "toxic", held_out, per_class))
    model = documents.sparkSession.sparkContext.broadcast(weights)  # 4 MB whatever the input

    def make():
        w = model.value

        def scored(batch: pd.DataFrame) -> pd.DataFrame:
            z = [intercept + float(w[features(t)].sum()) if isinstance(t, str) else intercept for t in batch["text"]]
            score = sigmoid(np.array(z, np.float64))
            return pd.DataFrame({"score": score, "predicted": (score >= threshold).astype(np.int32)})

        return scored

    doc_id = F.col("doc_id").cast("long")
    chosen = small_batches(documents).select(doc_id.alias("doc_id"), in_fold(doc_id, *held_out).alias("held_out"), F.col("text").alias("text"))
    return mapped(chosen, ["doc_id", "held_out"], make, "doc_id long, held_out boolean, score double, predicted int")
