"""Fill-in-middle: a text is cut at two of its unit ends and its parts are put in another order.

Units are lines or words. Seeds come from a hash of the id, so a document is cut
alike on every run and in any partitioning.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import small_batches

#: What ends a unit: patterns that match all of a text.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+"}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """The offset after each unit; before the first there is 0."""
    return array("q", [0]) + array("q", (m.end() for m in pattern.finditer(text)))


def seeds(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def restored(output: str, form: str) -> str:
    """The text that an output was made of. The marks are found in it alone, for texts with marks stay plain."""
    if form == "plain":
        return output
    head, tail = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, _, rest = output[len(head) :].partition(tail)
    second, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return prefix + middle + suffix


def cut(pattern: regex.Pattern, seed: int, rate: int, spm: int, doc_id: str, text: str) -> tuple:
    """A row of SHAPE, but for what is restored."""
    ends = unit_ends(pattern, text)
    n = len(ends) - 1
    h = seeds(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    prefix, middle, suffix = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < spm:
        return n, "spm", lo, hi - lo, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", lo, hi - lo, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(documents: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """documents (doc_id, text) with n (units), form (plain, psm, spm), prefix_chars, middle_chars, output and the text restored from it.

    rate: of 100 documents, how many are transformed; spm: of 100 of these, how
    many have the suffix first. A null text is empty, and an empty one is plain
    with no units; so is one that holds a mark. A null id is seeded as an empty
    one. Rows are independent: repeated ones come out alike. Of further columns
    all stay but those of the names above, which are replaced. Texts are whole,
    however long: what is held besides one is 8 bytes a unit.
    """
    expression = UNITS[unit]

    @F.pandas_udf(SHAPE)
    def parts(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(expression)
        rows = [cut(pattern, seed, rate, spm, i, t) for i, t in zip(ids, texts)]
        frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        frame["prefix_chars"], frame["middle_chars"] = frame["prefix_chars"].astype("Int64"), frame["middle_chars"].astype("Int64")
        frame["restored"] = [restored(o, f) for o, f in zip(frame["output"], frame["form"])]
        return frame

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    found = small_batches(documents).withColumn("_fim", parts(text("doc_id"), text("text")))
    return found.select(*[c for c in documents.columns if c.lower() not in made], *[F.col("_fim")[c].alias(c) for c in made])
