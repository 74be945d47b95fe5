"""Operator 2, quality rules: how well public vocabularies cover a text.

A vocabulary that was made on ordinary prose spends few tokens on prose and many
on shouting, symbol noise and garbled bytes. Per document this measures, for a
sentencepiece vocabulary with byte fallback and a byte-level one of many languages,

- chars_per_token: code points in words over tokens of words (fertility),
- byte_share: tokens that are fallback bytes over all tokens,
- entropy: bits per token of the document's own token distribution,
- multi_chars_per_token: fertility by the second vocabulary, each word after a space,

and rejects a document outside the band of its language, or, where the language
is unknown, of its main script. Entropy is held to its band only where a text
has enough tokens to show one.

Words are independent in such vocabularies (pieces never cross white space), so
each distinct word is tokenised once per task and the rest is counting.

Edge cases: null or empty text: no words, base_failed, rates 0. Repeated rows
each get their row, null ids too. Unknown or null languages use the band of the
script.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import SPACES, kept_rows, mapped, raw, small_batches

SYMBOLS = "#*$%&|<>"
#: Rejection bands by language, else script: (least, most chars per token), most byte share, least entropy in bits, least chars per token of the second vocabulary.
#: Languages: least rates are set on labelled texts of sf0.1 outside the classifier's held-out fold, to lose about 1 % of clean ones at most.
#: Scripts: a fifth to a quarter below (bytes: half above) what sentences of their languages give; see test_script_bands.
BANDS = {
    "en": ((2.00, 6.5), 0.02, 5.50, 2.10),
    "de": ((2.06, 6.5), 0.02, 5.60, 2.17),
    "fr": ((1.66, 6.5), 0.02, 5.50, 1.925),
    "es": ((1.78, 6.5), 0.02, 5.60, 1.955),
    "latin": ((1.05, 7.0), 0.08, 4.5, 1.55),
    "cyrillic": ((1.65, 3.5), 0.02, 5.0, 1.70),
    "greek": ((0.70, 1.5), 0.05, 4.0, 1.40),
    "han": ((0.70, 1.4), 0.45, 5.0, 0.62),
    "kana": ((0.70, 1.4), 0.40, 4.5, 0.80),
    "hangul": ((0.50, 1.2), 0.40, 4.5, 0.80),
    "arabic": ((0.70, 1.6), 0.05, 4.0, 1.20),
    "hebrew": ((0.65, 1.4), 0.05, 4.0, 1.20),
    "devanagari": ((0.55, 1.3), 0.25, 4.0, 0.60),
    "thai": ((0.75, 1.6), 0.10, 4.0, 0.85),
    "other": ((0.20, 9.0), 0.95, 4.0, 0.20),
}
#: Where the code points of scripts begin; those between belong to no script here.
SCRIPTS = {
    "latin": ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x1E00, 0x1F00)),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "cyrillic": ((0x400, 0x530),),
    "hebrew": ((0x590, 0x600),),
    "arabic": ((0x600, 0x780), (0xFB50, 0xFE00)),
    "devanagari": ((0x900, 0x980),),
    "thai": ((0xE00, 0xE80),),
    "kana": ((0x3040, 0x3100), (0x31F0, 0x3200)),
    "han": ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x32000)),
    "hangul": ((0x1100, 0x1200), (0xAC00, 0xD7B0)),
    "other": ((0x530, 0x590), (0x780, 0x900), (0x980, 0xE00), (0xE80, 0x1100), (0x1200, 0x1E00), (0xA000, 0xAC00), (0x10000, 0x1D000)),
}
#: Tokens from which the entropy band holds.
ENTROPY_FROM = 150
#: Distinct words that a task keeps tokens of; with more, it starts afresh after the batch.
MEMO = 200_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double, multi_chars_per_token double, band string, reason string"
)


def repeated_words(ids: np.ndarray) -> int:
    """Positions covered by three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    top = int(ids.max()) + 1
    if top < 1 << 21:
        key = (ids[:-2].astype(np.int64) << 42) | (ids[1:-1].astype(np.int64) << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-2].astype(np.int64) << 32 | ids[1:-1], return_inverse=True)
        key = pair.astype(np.int64) << 32 | ids[2:]
    order = np.argsort(key, kind="stable")
    got = key[order]
    same = got[1:] == got[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


class Pieces:
    """Token ids of words, in flat arrays by word number; a word is tokenised when first met."""

    def __init__(self, model_file: str, rank_file: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.size = size
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.second = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.int32)
        self.multi = np.zeros(0, np.int32)

    def ids(self, found: list[bytes]) -> np.ndarray:
        get = self.number.setdefault
        return np.fromiter((get(w, len(self.number)) for w in found), np.int64, len(found))

    def learn(self) -> None:
        """Tokenise the words that have a number but no tokens yet."""
        done = len(self.start) - 1
        if done == len(self.number):
            return
        fresh = [w.decode("utf-8", "replace") for w in list(self.number)[done:]]
        tokens = self.model.encode(fresh, num_threads=1)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        fallback = np.concatenate(([0], np.cumsum(self.is_byte[flat])))
        self.bytes = np.concatenate((self.bytes, fallback[ends] - fallback[ends - sizes]))
        self.start = np.concatenate((self.start, self.start[-1] + ends))
        self.flat = np.concatenate((self.flat, flat))
        self.multi = np.concatenate((self.multi, np.fromiter((len(self.second.encode_ordinary(" " + w)) for w in fresh), np.int32, len(fresh))))

    def measure(self, ids: np.ndarray) -> tuple[int, int, float, int]:
        """Tokens, fallback bytes, entropy in bits, and tokens of the second vocabulary."""
        if not len(ids):
            return 0, 0, 0.0, 0
        u, times = np.unique(ids, return_counts=True)
        sizes = self.start[u + 1] - self.start[u]
        total = int((sizes * times).sum())
        if not total:
            return 0, 0, 0.0, 0
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.start[u], sizes)
        p = np.bincount(self.flat[at], weights=np.repeat(times, sizes))
        p = p[p > 0] / total
        return total, int((self.bytes[u] * times).sum()), float(-(p * np.log2(p)).sum()), int((self.multi[u] * times).sum())


def script(text: str) -> str:
    """The script of most letters; kana already where a tenth of Han letters as many kana stand beside them. Latin if there are none."""
    if text.isascii():
        return "latin"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(OF_RANGE[np.searchsorted(EDGES, code, "right")], minlength=len(SCRIPTS) + 1)[:-1]
    found = dict(zip(SCRIPTS, n.tolist(), strict=True))
    if found["kana"] * 10 > found["han"]:
        found["kana"] += found["han"]
    return max(found, key=found.get)


def ranges() -> tuple[np.ndarray, np.ndarray]:
    """Borders between ranges of code points, and the number of the script that each range belongs to; the last number is none."""
    spans = sorted((a, b, k) for k, parts in enumerate(SCRIPTS.values()) for a, b in parts)
    edges, of = [], [len(SCRIPTS)]
    for a, b, k in spans:
        if edges and edges[-1] == a:
            of[-1] = k
        else:
            edges.append(a)
            of.append(k)
        edges.append(b)
        of.append(len(SCRIPTS))
    return np.array(edges, np.uint32), np.array(of)


EDGES, OF_RANGE = ranges()


def base(text: str, found: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int]:
    n_space = sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x and x.strip(SPACES)]
    return len(text) - n_space, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)


def verdict(measured: tuple[int, int, float, int], word_chars: int, band: str, bands: dict) -> tuple[float, float, str | None]:
    total, fallback, entropy, multi = measured
    rate, share = (word_chars / total, fallback / total) if total else (0.0, 0.0)
    (least, most), most_bytes, least_bits, least_multi = bands[band]
    if not total:
        return rate, share, "no tokens"
    if rate < least:
        return rate, share, "many tokens"
    if rate > most:
        return rate, share, "few tokens"
    if share > most_bytes:
        return rate, share, "bytes"
    if total >= ENTROPY_FROM and entropy < least_bits:
        return rate, share, "low entropy"
    if word_chars < least_multi * multi:
        return rate, share, "many tokens of the second"
    return rate, share, None


def judged(pieces: Pieces, texts, langs, bands: dict) -> list[tuple]:
    """SCHEMA's columns after doc_id, for some texts."""
    if len(pieces.number) > MEMO:
        pieces.reset()
    texts = [t if isinstance(t, str) else "" for t in texts]
    split = [raw(t).split() for t in texts]
    numbered = [pieces.ids(w) for w in split]
    pieces.learn()
    rows = []
    for lang, text, found, ids in zip(langs, texts, split, numbered, strict=True):
        chars, symbols, dup, repeat = base(text, found, ids)
        n = len(found)
        failed = n < 50 or 100 * repeat > 50 * n
        measured = pieces.measure(ids)
        band = lang if lang in bands else script(text)
        rate, share, reason = verdict(measured, chars, band, bands)
        reason = "base" if failed else reason
        rows.append((n, chars, symbols, dup, repeat, failed, reason is None, measured[0], rate, share, measured[2], chars / measured[3] if measured[3] else 0.0, band, reason))
    return rows


def quality_rules(documents: DataFrame, model_file: str | None = None, bands: dict | None = None, rank_file: str | None = None) -> DataFrame:
    """A row per row of documents (doc_id, text, lang): the base counts, the measures, kept and reason."""
    import public_tokenizers

    model_file, rank_file = model_file or public_tokenizers.path("piece_bpe_32k.model"), rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bands = bands or BANDS

    def make():
        pieces = Pieces(model_file, rank_file)
        return lambda batch: pd.DataFrame(judged(pieces, batch["text"], batch["lang"], bands), columns=NAMES[1:])

    chosen = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    return mapped(chosen, ["doc_id"], make, SCHEMA)


def passing(documents: DataFrame, model_file: str | None = None, bands: dict | None = None, rank_file: str | None = None) -> DataFrame:
    """The rows of documents that quality_rules() keeps, with all their columns; nothing is shuffled."""
    import public_tokenizers

    model_file, rank_file = model_file or public_tokenizers.path("piece_bpe_32k.model"), rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bands = bands or BANDS

    def decide():
        pieces = Pieces(model_file, rank_file)
        return lambda batch: [row[KEPT] for row in judged(pieces, batch["text"], batch["lang"], bands)]

    return kept_rows(documents, ["lang", "text"], decide)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KEPT = NAMES.index("kept") - 1
