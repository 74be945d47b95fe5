"""Operator 8, language ID: fusing a page's evidence by Bayes' rule.

Evidence, as log-likelihoods per language, added up:

- Text: a naive Bayes model of character trigrams, fitted on a bounded sample
  of documents whose language is known (PER_LANGUAGE of each, by hash of the
  id, of SAMPLE_BYTES bytes together at most), on the page's whole visible text,
  tempered: trigrams depend on each other, so each counts as TEMPER of one. The
  model has MODEL_CELLS numbers at most: with very many languages, trigrams are
  hashed to fewer places.
- Declared: the page's lang attribute (or content-language), anywhere in it, with the
  reliability that the pages themselves show: how often a declared value goes
  with each language by the text, from a grouped count.
- Address: a prior for the host, smoothed hierarchically: a host's counts
  towards its domain's, those towards the address suffix's (com, de, ...),
  those towards all pages' (each by STRENGTH pages). Counts are sums of text
  posteriors by grouped aggregation.

A page's own share is taken out of all these counts, so that a page isn't
evidence for itself; a page without text has no share.

Edge cases: null or empty html: no text and no declared evidence, the host
decides. Null urls have the empty host, which takes the prior of all pages.
Without documents of known language there is no language: lang null. Repeated
pages each get their row, those with a null id too.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.markup import attributes, scan
from claimloom.llm.common import durable, mapped, small_batches, within_bytes
from claimloom.llm.htmltext import render
from claimloom.llm.urlfilter import host_and_path

#: Bounds of the training sample.
PER_LANGUAGE = 300
SAMPLE_BYTES = 8 << 20
BITS, MODEL_CELLS = 16, 1 << 24
#: Rows (a language and an id) of the sample that may be broadcast.
MOST_SENT = 500_000
TEMPER = 0.05
STRENGTH = 5.0
MARKED = re.compile(r"<(?:html|meta)\b", re.I)
#: Second-level labels that belong to the suffix, as in co.uk.
SECOND_LEVEL = frozenset("ac co com edu gov net org".split())


def trigrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed trigrams of the lower-cased letters, other runs being one space."""
    code = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    key = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA6B) + code[2:]
    key = (key ^ (key >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return (key >> np.uint32(32 - bits)).astype(np.int64)


def fit(rows: list[tuple[str, str]], languages: list[str], bits: int) -> np.ndarray:
    """Log-probability of each hashed trigram in each language."""
    count = np.full((1 << bits, len(languages)), 0.05, np.float32)
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, text in rows:
        count[:, place[lang]] += np.bincount(trigrams(text, bits), minlength=1 << bits)
    return np.log(count / count.sum(0, dtype=np.float64)).astype(np.float32)


def language_sample(documents: DataFrame, per_language: int, most_bytes: int) -> tuple[list[str], list[tuple[str, str]]]:
    """All languages, and (language, text) of the rows with the least hashes of their ids."""
    known = documents.select(F.col("lang").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body")).where("lang is not null and id is not null and text is not null")
    sizes = known.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return [], []
    spark = documents.sparkSession
    # a row a language, then per_language rows of each: sent to all tasks as long as these are few, by count
    sent = F.broadcast if len(sizes) * per_language <= MOST_SENT else lambda df: df
    # hashes below a bound of the language's own leave about twice the rows wanted, however many it has
    bounds = spark.createDataFrame([(r.lang, min(1.0, (2 * per_language + 50) / r["count"])) for r in sizes], "tongue string, bound double")
    place = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    near = known.join(sent(bounds), F.col("lang") == F.col("tongue")).where(place < F.col("bound")).select("lang", "id", place.alias("h")).distinct()
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= per_language)
    chosen = first.select(F.col("lang").alias("tongue"), F.col("id").alias("pick"))
    found = durable(known.join(sent(chosen), (F.col("lang") == F.col("tongue")) & (F.col("id") == F.col("pick"))).groupBy("lang", "id").agg(F.max("body").alias("body")))
    found = found.withColumn("place", F.struct(F.xxhash64("id"), "id", "lang"))
    return sorted(r.lang for r in sizes), sorted((r.lang, r.body) for r in within_bytes(found, "lang", most_bytes))


def levels(host: str) -> tuple[str, str]:
    """Suffix and domain of a host."""
    labels = [x for x in host.rsplit("@", 1)[-1].split(":")[0].split(".") if x]
    if not labels or labels[-1].isdigit():
        return "", host
    n = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else 1
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


def declared(page: str) -> str:
    """The language that the page's html tag declares, else its first content-language; comments and scripts declare nothing."""
    value, seen = "", False
    for kind, name, rest in scan(page) if MARKED.search(page) else ():
        if kind != "start" or name not in ("html", "meta"):
            continue
        attrs = attributes(rest)
        if name == "html" and not seen:
            seen = True
            if attrs.get("lang"):
                value = attrs["lang"]
                break
        elif name == "meta" and not value and attrs.get("http-equiv", attrs.get("name", "")).strip().lower() == "content-language":
            value = attrs.get("content", "")
    return re.split(r"[-_,\s]", value.strip().lower())[0]


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + F.exp(x - top))
    return F.transform(a, lambda x: F.exp(x - top) / total)


def shares(n: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(n)]


def identify(pages: DataFrame, documents: DataFrame, per_language: int = PER_LANGUAGE, temper: float = TEMPER, strength: float = STRENGTH, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """A row per row of pages (page_id, url, html): page_id, host, declared, text_lang, lang, probability."""
    spark = pages.sparkSession
    languages, rows = language_sample(documents, per_language, sample_bytes)
    n = len(languages)
    chosen = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    if not n:
        return chosen.select("page_id", F.lit("").alias("host"), F.lit("").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    bits = max(1, min(BITS, (MODEL_CELLS // n).bit_length() - 1))
    model = spark.sparkContext.broadcast(fit(rows, languages, bits))  # at most MODEL_CELLS numbers

    def make():
        weights = model.value

        def read(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for url, page in zip(batch["url"], batch["html"], strict=True):
                page = page if isinstance(page, str) else ""
                host = host_and_path(url)[0]
                grams = trigrams(render(page)[0], bits)
                ll = (weights[grams].sum(0, dtype=np.float64) * temper).tolist() if len(grams) > 2 else [0.0] * n
                out.append((host, *levels(host), declared(page), ll))
            return pd.DataFrame(out, columns=["host", "suffix", "domain", "declared", "ll"])

        return read

    zero = F.transform(F.col("ll"), lambda x: x * 0.0)
    p = F.when(F.array_max("ll") > F.array_min("ll"), softmax(F.col("ll"))).otherwise(zero) if n > 1 else F.when(F.col("ll")[0] != 0, F.array(F.lit(1.0))).otherwise(zero)
    seen = durable(mapped(chosen, ["page_id"], make, "page_id long, host string, suffix string, domain string, declared string, ll array<double>").withColumn("p", p))

    def counted(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*shares(n)).select(*keys, F.array(*[F.col(f"p{i}") for i in range(n)]).alias("p"))

    # the hosts' sums first, all others are sums of those
    host = durable(counted(seen, "suffix", "domain", "host"))
    domain = counted(host, "suffix", "domain")
    suffix = counted(domain, "suffix")
    everything = suffix.agg(*shares(n)).first()
    whole = F.array(*[F.lit(float(everything[i] or 0.0)) for i in range(n)])
    s = suffix.select(F.col("suffix").alias("s_suffix"), F.col("p").alias("s_p"))
    d = domain.join(s, F.col("suffix") == F.col("s_suffix")).select(F.col("suffix").alias("d_suffix"), F.col("domain").alias("d_domain"), F.col("p").alias("d_p"), "s_p")
    h = host.join(d, (F.col("suffix") == F.col("d_suffix")) & (F.col("domain") == F.col("d_domain"))).select(F.col("host").alias("h_host"), F.col("p").alias("h_p"), "d_p", "s_p")
    # how declared values go with languages; values are folded to the languages, none and other, so there are few
    folded = F.when(F.col("declared").isin(*languages) | (F.col("declared") == ""), F.col("declared")).otherwise("?")
    said = {r.value: [r[f"p{i}"] for i in range(n)] for r in seen.withColumn("value", folded).groupBy("value").agg(*shares(n)).collect()}
    told = spark.createDataFrame([(v, [float(x) for x in xs]) for v, xs in said.items()], "v string, times array<double>")
    mass = F.array(*[F.lit(float(sum(xs[i] for xs in said.values()))) for i in range(n)])

    def without(counts: Column) -> Column:
        """Counts less the page's own share."""
        return F.zip_with(counts, F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
        return F.zip_with(counts, above, lambda x, y: (x + F.lit(strength) * y) / (total + F.lit(strength)))

    says = F.zip_with(without(F.col("times")), without(mass), lambda x, y: F.log((x + 0.5) / (y + 0.5 * (n + 2))))
    joined = (
        seen.join(h, F.col("host") == F.col("h_host"), "left")
        .withColumn("value", folded)
        .join(F.broadcast(told), F.col("value") == F.col("v"), "left")  # a row a language
        .withColumn("prior", smoothed(without(whole), F.array(*[F.lit(1.0 / n)] * n)))
        .withColumn("prior", smoothed(without(F.col("s_p")), F.col("prior")))
        .withColumn("prior", smoothed(without(F.col("d_p")), F.col("prior")))
        .withColumn("prior", smoothed(without(F.col("h_p")), F.col("prior")))
        .withColumn("posterior", softmax(added(added(F.col("ll"), F.coalesce(says, zero)), F.coalesce(F.transform("prior", lambda x: F.log(x + 1e-6)), zero))))
    )
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_max("posterior")
    text_lang = F.when(F.array_max("ll") > F.array_min("ll"), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")))
    return joined.select("page_id", "host", "declared", text_lang.alias("text_lang"), F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"), best.alias("probability"))
