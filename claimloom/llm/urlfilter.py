"""Operator 9, URL filters: rules in a sorted array of 64-bit xxhash digests.

A rule is a host and a path prefix ("example.net/es/"): it fits the host and all
its subdomains where the url's path starts with the prefix; the longest rule
wins. All rules stand in one file: the digests of their strings, sorted, then
the strings themselves, one after the other. It's written to the cluster's shared
folder; each executor fetches it once, and tasks map it into memory, probe a
whole batch by vectorised binary search and compare the stored string of each
digest found, so a digest that two strings share decides nothing.

For a url the strings to probe are its host's suffixes at label borders, as far
as the longest host of a rule reaches, each followed by the path's prefixes of
those lengths that some rule has: the work grows with these two, not with the
number of rules or the length of the url.

The block list is a parameter: strings, or a table of them (column rule, "host/"
or "host/path"), which goes through the driver once, at about 17 bytes and its
string a rule; null rules and those without "/" after a host are left out.

Edge cases: null urls and urls without "://" have empty host and path, fit no
rule, and are allowed. Equal rules: the first one counts. Null ids and repeated
pages each get their row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import mapped, small_batches
from claimloom.operators.components import shared_folder

#: Rules that are reported by name: (host with path, verdict).
BASE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: The block list behind them: hosts known for spam, with all their subdomains.
BLOCK_LIST = tuple(f"{name}.example.{end}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
MAGIC = b"digests2"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

SCHEMA = "page_id long, host string, path string, rule string, verdict string, listed string"


def digests(strings: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))


def array_parts(rules: list[tuple[str, str, bool]], digest=digests) -> Iterator[bytes]:
    """The file's parts, for rules (string, verdict, named): counts, lengths of paths, digests, ends of strings, flags, strings."""
    unique: dict[bytes, int] = {}
    for text, verdict, named in rules:
        unique.setdefault(text.encode(), (verdict == "block") + 2 * named)
    strings = list(unique)
    keys = digest(strings) if strings else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [strings[i] for i in order]
    hosts = [s.index(b"/") for s in strings]
    lengths = sorted({len(s) - n for s, n in zip(strings, hosts, strict=True)})
    yield MAGIC + struct.pack("<qqq", len(strings), len(lengths), max(hosts, default=0)) + np.array(lengths, "<i8").tobytes()
    yield keys[order].astype("<u8").tobytes()
    yield np.cumsum([len(s) for s in strings], dtype="<i8").tobytes()
    yield bytes(unique[s] for s in strings)
    yield b"".join(strings)


def write_shared(spark: SparkSession, parts: Iterator[bytes], step: int = 1 << 20) -> str:
    """Writes a file to the shared folder, through Spark's file systems, and has executors fetch it; gives its name there."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for part in parts:
        for at in range(0, len(part), step):
            out.write(bytearray(part[at : at + step]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class DigestArray:
    """A mapped file of array_parts()."""

    def __init__(self, file: str, digest=digests):
        self.digest = digest
        whole = np.memmap(file, np.uint8, "r")
        if bytes(whole[:8]) != MAGIC:
            raise ValueError(f"{file} is no digest array")
        n, k, self.longest = struct.unpack("<qqq", bytes(whole[8:32]))
        at = 32
        self.lengths = whole[at : at + 8 * k].view("<i8").tolist()
        at += 8 * k
        self.keys = whole[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = whole[at : at + 8 * n].view("<i8")
        at += 8 * n
        self.flags = whole[at : at + n]
        self.strings = whole[at + n :]

    def string(self, i: int) -> bytes:
        return bytes(self.strings[(self.ends[i - 1] if i else 0) : self.ends[i]])

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The place of each string, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        keys = self.digest(strings)
        first = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] == keys))
        for i in hits:  # few: stored strings are compared, over all places of an equal digest
            at = int(first[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:
                if self.string(at) == strings[i]:
                    out[i] = at
                    break
                at += 1
        return out


def host_and_path(url) -> tuple[str, str]:
    if not isinstance(url, str):
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:cut].encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return host, path[:end]


def probes(host: str, path: str, lengths: list[int], longest: int) -> list[bytes]:
    """Strings that a fitting rule could be, the longest first; no rule's host is longer than `longest` bytes."""
    raw_host, raw_path = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
    suffixes = [raw_host] if 0 < len(raw_host) <= longest else []
    at = max(0, len(raw_host) - longest - 1)
    while (at := raw_host.find(b".", at) + 1) > 0:
        suffixes.append(raw_host[at:])
    heads = [raw_path[:n] for n in lengths if n <= len(raw_path)]
    return sorted((s + h for s in suffixes if s for h in heads), key=len, reverse=True)


def judge(array: DigestArray, urls: list) -> list[tuple[str, str, str | None, str, str | None]]:
    """host, path, named rule, verdict and listed string of each url; each distinct string is probed once."""
    parts = [host_and_path(u) for u in urls]
    asked: dict[bytes, int] = {}
    lists = [probes(h, p, array.lengths, array.longest) for h, p in parts]
    for strings in lists:
        for s in strings:
            asked.setdefault(s, len(asked))
    places = array.find(list(asked))
    out = []
    for (host, path), strings in zip(parts, lists, strict=True):
        rule = listed = None
        verdict = "allow"
        hits = [int(places[asked[s]]) for s in strings]
        named = next((i for i in hits if i >= 0 and array.flags[i] & 2), None)
        own = next((i for i in hits if i >= 0 and not array.flags[i] & 2), None)
        if own is not None:
            listed, verdict = array.string(own).decode(), "block" if array.flags[own] & 1 else "allow"
        if named is not None:
            rule, verdict = array.string(named).decode(), "block" if array.flags[named] & 1 else "allow"
        out.append((host, path, rule, verdict, listed))
    return out


def filter_urls(pages: DataFrame, base_rules=BASE_RULES, block_list: DataFrame | Iterable[str] = BLOCK_LIST) -> DataFrame:
    """A row per row of pages (page_id, url): host, path, rule, verdict, listed. A named rule decides before the block list."""
    if isinstance(block_list, DataFrame):
        block_list = block_list.select(F.col("rule").cast("string").alias("rule")).where(F.instr("rule", "/") > 1).distinct().toArrow().column("rule").to_pylist()
    name = write_shared(pages.sparkSession, array_parts([(r, v, True) for r, v in base_rules] + [(r, "block", False) for r in block_list]))

    def make():
        array = DigestArray(SparkFiles.get(name))
        return lambda batch: pd.DataFrame(judge(array, list(batch["url"])), columns=["host", "path", "rule", "verdict", "listed"])

    return mapped(small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url")), ["page_id"], make, SCHEMA)
