"""Operator 10, quality classifier: a convolutional network on bytes, in numpy.

Filters of WIDTH bytes read one-hot bytes at every position. A document is cut
into overlapping chunks (CHUNK windows, every half chunk) that cover all of it;
each filter's largest response in a chunk goes through a small hidden layer to
the chunk's log-odds, and a document's log-odds are those of its chunks,
averaged by length and calibrated. Scoring reads a table of responses to byte
pairs, so a window costs three lookups.

The fit reads a bounded sample of labelled texts (PER_CLASS of either label, by
hash of the id) and chunks drawn from all over each; the intercept is then set
back to the odds that all labelled rows outside the held-out fold show.

Edge cases: null, empty and very short texts are padded with zero bytes to one
window. No labelled row, or rows of one label only: the share of label 1 (0.5
if none) for all. Very long texts are read in pieces of SPAN windows, which changes
no chunk. Null ids are scored and never held out; repeated rows each get their row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import in_fold, kept_rows, labelled_sample, mapped, raw, sigmoid, small_batches

#: Bound of the training sample: so many texts of either label at most.
PER_CLASS = 1500
HELD_OUT = (3, 1)
THRESHOLD = 0.5
WIDTH, FILTERS, HIDDEN = 6, 16, 16
HALF = 192
CHUNK = 2 * HALF
#: Windows that are read at a time: whole halves, so that chunks lie alike in texts of any length.
SPAN = HALF * 1366


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.conv = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.hidden = rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32)
        self.shift = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.last = np.zeros(1, np.float32)
        self.slope, self.offset = 1.0, 0.0

    def arrays(self) -> tuple:
        """The network as plain arrays and numbers, which any process can read without this class."""
        return (*self.params(), self.slope, self.offset)

    @classmethod
    def of(cls, arrays: tuple) -> Net:
        net = cls.__new__(cls)
        net.conv, net.hidden, net.shift, net.out, net.last, net.slope, net.offset = arrays
        return net

    def params(self) -> list[np.ndarray]:
        return [self.conv, self.hidden, self.shift, self.out, self.last]

    def pairs(self) -> np.ndarray:
        """Responses to byte pairs at offsets 0, 2 and 4: (3, 65536, FILTERS)."""
        return np.stack([(self.conv[k][:, None, :] + self.conv[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.tanh(pooled) @ self.hidden + self.shift, 0) @ self.out + self.last[0]


def windows(code: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each filter's response at every position of the bytes."""
    two = (code[:-1].astype(np.int32) << 8) | code[1:]
    n = len(code) - WIDTH + 1
    got = pairs[0][two[:n]]
    for k in range(2, WIDTH, 2):
        got += pairs[k // 2][two[k : k + n]]
    return got


def pooled_chunks(text: bytes, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest responses in each chunk, and the chunks' lengths."""
    if len(text) < WIDTH:
        text = text + bytes(WIDTH - len(text))
    parts, n_windows = [], len(text) - WIDTH + 1
    for at in range(0, n_windows, SPAN):
        code = np.frombuffer(text[at : at + SPAN + WIDTH - 1], np.uint8)
        got = windows(code, pairs)
        parts.append(np.maximum.reduceat(got, np.arange(0, len(got), HALF), axis=0))
    halves = np.concatenate(parts)
    sizes = np.full(len(halves), HALF)
    sizes[-1] = n_windows - HALF * (len(halves) - 1)
    if len(halves) == 1:
        return halves, sizes
    return np.maximum(halves[:-1], halves[1:]), sizes[:-1] + sizes[1:]


def log_odds(net: Net, pairs: np.ndarray, text: bytes) -> float:
    pooled, sizes = pooled_chunks(text, pairs)
    return float(np.average(net.head(pooled), weights=sizes))


def fit(rows: list[tuple[str, int]], counts: tuple[int, int], steps: int = 900, batch: int = 192, seed: int = 7) -> Net:
    net = Net(seed)
    total = sum(counts)
    share = counts[1] / total if total else 0.5
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.offset = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return net
    rng = np.random.default_rng(seed)
    texts = [raw(text) for text, _ in rows]
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    length = CHUNK + WIDTH - 1
    mean, square = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        label = np.arange(batch) % 2
        code = np.zeros((batch, length), np.uint8)
        valid = np.ones(batch, np.int64)
        for i in range(batch):
            text = texts[rng.choice(sides[label[i]])]
            at = int(rng.integers(0, max(1, len(text) - length + 1)))
            part = np.frombuffer(text[at : at + length], np.uint8)
            code[i, : len(part)] = part
            valid[i] = max(1, len(part) - WIDTH + 1)
        got = net.conv[0][code[:, :CHUNK]]
        for k in range(1, WIDTH):
            got += net.conv[k][code[:, k : k + CHUNK]]
        got[np.arange(CHUNK)[None, :] >= valid[:, None]] = -1e9
        where = got.argmax(1)
        pooled = np.take_along_axis(got, where[:, None, :], 1)[:, 0, :]
        squashed = np.tanh(pooled)
        before = squashed @ net.hidden + net.shift
        active = np.maximum(before, 0)
        error = ((sigmoid(active @ net.out + net.last[0]) - label) / batch).astype(np.float32)
        d_active = error[:, None] * net.out * (before > 0)
        d_pooled = (d_active @ net.hidden.T) * (1 - squashed * squashed)
        d_conv = np.zeros_like(net.conv)
        columns = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            np.add.at(d_conv[k], (np.take_along_axis(code, where + k, 1), columns), d_pooled)
        slopes = [d_conv + 1e-5 * net.conv, squashed.T @ d_active + 1e-5 * net.hidden, d_active.sum(0), active.T @ error, error.sum(keepdims=True)]
        rate = 0.02 * (1 - step / (steps + 1))
        for p, g, m, s in zip(net.params(), slopes, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    pairs = net.pairs()
    z = np.array([log_odds(net, pairs, t) for t in texts])
    a, b = 1.0, 0.0
    for _ in range(300):  # calibration of the documents' log-odds
        miss = sigmoid(a * z + b) - y
        a -= 0.05 * float(np.mean(miss * z)) / (1 + float(np.var(z)))
        b -= 0.5 * float(np.mean(miss))
    drawn = float(y.mean())
    prior = math.log(share / (1 - share)) - math.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    net.slope, net.offset = max(a, 1e-3), b + prior
    return net


def score_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """A row per row of documents (doc_id, text): doc_id, held_out, score, predicted.

    learn_from: the documents whose labelled texts are learned, if not these.
    """
    model = trained(documents if learn_from is None else learn_from, labels, per_class, held_out)

    def make():
        own = Net.of(model.value)
        pairs = own.pairs()

        def scored(batch: pd.DataFrame) -> pd.DataFrame:
            score = scores(own, pairs, batch["text"])
            return pd.DataFrame({"score": score, "predicted": (score >= threshold).astype(np.int32)})

        return scored

    doc_id = F.col("doc_id").cast("long")
    chosen = small_batches(documents).select(doc_id.alias("doc_id"), in_fold(doc_id, *held_out).alias("held_out"), F.col("text").alias("text"))
    return mapped(chosen, ["doc_id", "held_out"], make, "doc_id long, held_out boolean, score double, predicted int")


def trained(documents: DataFrame, labels: DataFrame, per_class: int, held_out: tuple[int, int]):
    """The fitted network's arrays, broadcast: under 0.2 MB whatever the input. A broadcast Net would need this package on executors."""
    return documents.sparkSession.sparkContext.broadcast(fit(*labelled_sample(documents, labels, "quality", held_out, per_class)).arrays())


def scores(net: Net, pairs: np.ndarray, texts) -> np.ndarray:
    return sigmoid(net.slope * np.array([log_odds(net, pairs, raw(t)) for t in texts], np.float64) + net.offset)


def passing(documents: DataFrame, labels: DataFrame, learn_from: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that score the threshold or more, with all their columns; they aren't shuffled."""
    model = trained(learn_from, labels, per_class, held_out)

    def decide():
        own = Net.of(model.value)
        pairs = own.pairs()
        return lambda batch: (scores(own, pairs, batch["text"]) >= threshold).tolist()

    return kept_rows(documents, ["text"], decide)
