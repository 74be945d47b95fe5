"""Suffix-array dedup: passages that an earlier document has already are cut out.

Every byte goes that is covered by a string of `length` bytes which also starts
in a document with a smaller id; strings are judged on the whole input, and
matches never cross documents.

Windows of `length` bytes are sent to where equal ones meet, and there the
suffixes of all that was sent are sorted in two stages: only those smaller than
their successors are sorted directly, the others are put in place by scans of
the buckets of first bytes; adjacent common prefixes of `length` bytes or more
are the repeats.

1. A window's anchor is the least hash of its 20-byte grams; consecutive windows
   of one anchor make a segment (17 windows in 66 bytes, on average). Each batch of
   documents sends the 6-byte hashes of its anchors to their parts, once each.
2. A part answers with two bits for each: is the anchor known elsewhere, and are
   its segments so many that one part shouldn't have them all.
3. Segments of anchors that are known elsewhere go to the anchor's part, equal
   ones of a batch once with their least id. Those of very common anchors go
   window by window, each to the part of its own hash.
4. A part sorts the suffixes that start windows and answers with a bit a window:
   is there an earlier document than the batch's own least.
5. Batches read the answers and cut.

Steps 1, 3 and 5 read one shuffle of the documents. No step depends on how often
a passage is repeated but by one copy a batch. Hashes only bring windows
together: equality is always that of bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import small_batches

LENGTH = 50
#: Bytes of a gram that can be an anchor, of a batch and its slices, and of input for each part that windows meet in: what a task holds at once.
GRAM, BATCH, PART = 20, 4 << 20, 4 << 20
#: Of less input than would make work for all tasks, batches and parts are smaller, but not below this.
LEAST_BATCH, LEAST_PART = 256 << 10, 1 << 20
#: Distinct segments of an anchor, for each slice of the input on average, beyond which they go window by window.
COMMON = 4
MESSAGE = "b int, u int, part int, body binary"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x *= _ODD2
    x ^= x >> np.uint64(29)
    return x


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the bytes [i, i + size) for every i where they are there, put together from powers of two."""
    have, have_n, span, step = None, 0, _TABLE[data], 1
    while True:
        if size & step:
            if have is None:
                have, have_n = span, step
            else:
                n = len(span) - have_n
                have, have_n = have[:n] * np.uint64(pow(int(_ODD), step, 1 << 64)) + span[have_n:], have_n + step
        if have_n == size:
            return _mix(have)
        n = len(span) - step
        span, step = span[:n] * np.uint64(pow(int(_ODD), step, 1 << 64)) + span[step:], step * 2


def _least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Slice:
    """Some documents of a batch, or a piece of a long one: bytes, and the segments of its windows.

    document: of each segment, the number of its document. start: in the bytes of
    the slice. n: its windows. key: of its anchor, in order of parts.
    """

    def __init__(self, pieces: list[tuple[int, int, memoryview]], length: int):
        """pieces: number of a document, where the piece starts there, its bytes with the length - 1 that follow."""
        self.length, self.pieces = length, pieces
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(length), np.uint8)
        gram = min(GRAM, length)
        n, width = len(self.data) - length + 1, length - gram + 1
        self.gram, self.grams, least = gram, np.empty(n + width - 1, np.uint64), np.empty(n, np.uint64)
        for lo in range(0, n, 1 << 16):  # what is worked on stays in the processor's cache
            hi = min(n, lo + (1 << 16))
            part = gram_hashes(self.data[lo : hi + length - 1], gram)
            self.grams[lo : lo + len(part)] = part
            least[lo:hi] = _least_within(part, width)
        windows = np.maximum(sizes - length + 1, 0)
        edge = np.zeros(n + 1, np.int8)
        full = windows > 0
        edge[self.at[full]] += 1
        np.add.at(edge, (self.at + windows)[full], -1)
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        new[self.at[full]] = True
        new |= ~inside
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        first, size = first[inside[first]], size[inside[first]]
        pieces_of = np.ceil(size / width).astype(np.int64)  # windows that repeat an anchor's bytes make longer runs
        order = np.repeat(np.arange(len(first)), pieces_of)
        nth = np.arange(len(order)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
        self.start = first[order] + nth * width
        self.n = np.minimum(width, size[order] - nth * width)
        self.key = _mix(least[self.start])
        self.piece = np.searchsorted(self.at, self.start, "right") - 1
        self.document = np.array([p[0] for p in pieces], np.int64)[self.piece]

    def content(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of all bytes of segments."""
        size = n + self.length - 1
        out = size.astype(np.uint64)
        for k in range(math.ceil((2 * self.length - self.gram) / self.gram)):  # as many grams as the longest segment needs
            out = _mix(out * _ODD2 + self.grams[start + np.minimum(k * self.gram, size - self.gram)])
        return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def slices_of(texts: list[memoryview | None], length: int):
    """Slices of documents in the order given; None is passed over."""
    pieces, size = [], 0
    for k, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BATCH):
            piece = text[at : at + BATCH + length - 1]
            if pieces and size + len(piece) > BATCH + length:
                yield Slice(pieces, length)
                pieces, size = [], 0
            pieces.append((k, at, piece))
            size += len(piece)
    if pieces:
        yield Slice(pieces, length)


def _documents(table: pa.Table) -> tuple[pa.Table, list[memoryview | None], np.ndarray]:
    """A batch in a fixed order: its rows, their bytes (None without an id), their ids."""
    table = table.take(pc.sort_indices(table, [("id", "ascending"), ("mark", "ascending")])).combine_chunks()
    texts = [memoryview(x.as_buffer()) if known else None for x, known in zip(table.column("body"), table.column("id").is_valid().to_pylist())]
    return table, texts, table.column("id").fill_null(0).to_numpy()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _rows(b: list, u: list, part: list, body: list) -> pa.Table:
    return pa.table([pa.array(b, pa.int32()), pa.array(u, pa.int32()), pa.array(part, pa.int32()), body if isinstance(body, pa.Array) else pa.array(body, pa.binary())], ["b", "u", "part", "body"])


def _anchors(s: Slice, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a slice in order; the number of each segment's; how many different segments each has; is it in several documents."""
    content = s.content(s.start, s.n)
    order = np.lexsort((content, s.key))
    key, content, doc = s.key[order], content[order], ids[s.document[order]]
    first = _runs(key)
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    other = np.zeros(len(key), np.int64)
    other[_runs(key, content)] = 1
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return key[first], number, np.add.reduceat(other, first) if len(first) else other, several


def announce(table: pa.Table, parts: int, length: int) -> pa.Table:
    """Step 1: a row for each slice and part, with 7 bytes an anchor."""
    batch = table.column("b")[0].as_py()
    _, texts, ids = _documents(table)
    out = []
    for u, s in enumerate(slices_of(texts, length)):
        key, _, kinds, several = _anchors(s, ids)
        part = part_of(key, parts)
        first = _runs(part)
        body = np.empty((len(key), 7), np.uint8)
        body[:, :6] = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        body[:, 6] = np.minimum(kinds, 127) * 2 + several
        ends = np.append(first, len(key)).astype(np.int32) * 7
        bodies = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
        out.append(_rows([batch] * len(first), [u] * len(first), part[first], bodies))
    return pa.concat_tables(out) if out else _rows([], [], [], [])


def recognise(table: pa.Table, common: int) -> pa.Table:
    """Step 2: for each row of a part, the bits of anchors that are known elsewhere, then of those that are very common."""
    bodies = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 7) for x in table.column("body")]
    ends = np.cumsum([len(x) for x in bodies])
    body = np.concatenate(bodies)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :6] = body[:, :6]
    key, said = wide.view("<u8")[:, 0], body[:, 6].astype(np.int64)
    order = np.argsort(key)
    first = _runs(key[order])
    size = np.diff(np.append(first, len(key)))
    known = (size > 1) | (np.maximum.reduceat(said[order] & 1, first) > 0)
    many = np.add.reduceat(said[order] >> 1, first) >= common
    flags = np.empty((2, len(key)), bool)
    flags[:, order] = np.repeat(np.array([known, many & known]), size, axis=1)
    bits = [np.packbits(flags[:, end - len(x) : end], axis=1).tobytes() for x, end in zip(bodies, ends)]
    return _rows(table.column("b").to_pylist(), table.column("u").to_pylist(), table.column("part").to_pylist(), bits)


def _flags(bits: dict[int, bytes], part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What step 2 said of a slice's keys, of which `part` are the parts."""
    first = _runs(part)
    known, many = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for at, n in zip(first, np.diff(np.append(first, len(part)))):
        both = np.frombuffer(bits[int(part[at])], np.uint8).reshape(2, -1)
        known.append(np.unpackbits(both[0], count=n).astype(bool))
        many.append(np.unpackbits(both[1], count=n).astype(bool))
    return np.concatenate(known), np.concatenate(many)


class Asked:
    """The segments of a slice that are asked for, in order of parts and contents; equal ones make a group."""

    def __init__(self, s: Slice, ids: np.ndarray, bits: dict[int, bytes], parts: int):
        key, number, _, _ = _anchors(s, ids)
        known, many = _flags(bits, part_of(key, parts))
        whole, single = np.flatnonzero((known & ~many)[number]), np.flatnonzero((known & many)[number])
        each = s.n[single]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        start = np.concatenate([s.start[whole], np.repeat(s.start[single], each) + nth])
        n = np.concatenate([s.n[whole], np.ones(len(nth), np.int64)])
        document = np.concatenate([s.document[whole], np.repeat(s.document[single], each)])
        content = s.content(start, n)
        part = np.concatenate([part_of(s.key[whole], parts), part_of(content[len(whole) :], parts)])
        order = np.lexsort((content, part))
        self.start, self.n, self.document, content, self.part = start[order], n[order], document[order], content[order], part[order]
        new = np.ones(len(order), bool)
        alike = np.flatnonzero((content[1:] == content[:-1]) & (self.part[1:] == self.part[:-1]) & (self.n[1:] == self.n[:-1]))
        for some in np.array_split(alike, len(alike) // 100_000 + 1):  # equal hashes, and now equal bytes
            size = self.n[some] + s.length - 1
            same = np.ones(len(some), bool)
            for k in range(int(size.max(initial=0))):
                here = np.minimum(k, size - 1)
                same &= s.data[self.start[some] + here] == s.data[self.start[some + 1] + here]
            new[some[same] + 1] = False
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(ids[self.document], self.first) if len(self.first) else np.zeros(0, np.int64)


def _said(table: pa.Table) -> dict[int, dict[int, bytes]]:
    """Bodies by slice and part."""
    out: dict[int, dict[int, bytes]] = {}
    for u, part, body in zip(*(table.column(c).to_pylist() for c in ("u", "part", "body"))):
        out.setdefault(u, {})[part] = body
    return out


def ask(table: pa.Table, answers: pa.Table, parts: int, length: int) -> pa.Table:
    """Step 3: rows of segments for parts; and step 2's answers once more, in parts below 0, that the batch gets back with step 4's."""
    if not table.num_rows:
        return _rows([], [], [], [])
    batch = table.column("b")[0].as_py()
    _, texts, ids = _documents(table)
    bits = _said(answers)
    out = ([], [], [], [])
    for u, s in enumerate(slices_of(texts, length)):
        a = Asked(s, ids, bits.get(u, {}), parts)
        part = a.part[a.first]
        firsts = _runs(part)
        for lo, hi in zip(firsts, np.append(firsts[1:], len(part))):
            at = a.first[lo:hi]
            size = a.n[at] + length - 1
            index = np.arange(size.sum()) + np.repeat(a.start[at] - (np.cumsum(size) - size), size)
            body = np.array([hi - lo], "<i8").tobytes() + a.least[lo:hi].astype("<i8").tobytes() + a.n[at].astype(np.uint8).tobytes() + s.data[index].tobytes()
            for column, x in zip(out, (batch, u, int(part[lo]), body)):
                column.append(x)
        for p, body in bits.get(u, {}).items():
            if np.frombuffer(body, np.uint8).any():
                for column, x in zip(out, (batch, u, -1 - p, body)):
                    column.append(x)
    return _rows(*out)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do; data has 8 bytes more than places."""
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


def _smaller(data: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix: is it smaller than its successor, or equal to it in the first depth bytes?"""
    n = len(data)
    first = np.flatnonzero(np.append(True, data[1:] != data[:-1]))
    size = np.diff(np.append(first, n))
    after = data[np.minimum(first + size, n - 1)]
    rises = after > data[first]
    left = np.repeat(first + size, size) - np.arange(n)  # equal bytes from here on
    return np.repeat(rises, size) | (left > depth)


def directly_sorted(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at` in order of their first depth bytes; only groups that aren't all equal in the next 8 bytes are sorted on."""
    order = at[np.argsort(words[at], kind="stable")]
    word = words[order]
    new = np.append(True, word[1:] != word[:-1]) if len(order) else np.zeros(0, bool)
    for k in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        some = order[where]
        word = words[some + k] if depth - k >= 8 else words[some + k] >> np.uint64(8 * (8 - (depth - k)))
        first = np.flatnonzero(new[where])
        size = np.diff(np.append(first, len(where)))
        mixed = np.repeat(np.minimum.reduceat(word, first) != np.maximum.reduceat(word, first), size)
        if not mixed.any():
            continue
        where, some, word = where[mixed], some[mixed], word[mixed]
        group = np.repeat(np.arange(len(first)), size)[mixed]
        by = np.lexsort((word, group))
        order[where], word = some[by], word[by]
        new[where] |= np.append(True, (word[1:] != word[:-1]) | (group[1:] != group[:-1]))
    return order


def two_stage(data: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes of data in order of their first depth bytes, and the words of data.

    data: ends with at least depth + 9 zero bytes.
    wanted: true at the places whose suffixes are wanted.

    Directly sorted are those smaller than their successors. Each of the others
    stands one place before a suffix that is smaller than itself, so scanning the
    buckets of first bytes upward meets that one first, and puts it at the end of
    what its own bucket has so far. That takes suffixes that aren't wanted but
    follow a wanted one, up to the next that is sorted directly.
    """
    small = _smaller(data, depth)
    n = len(data) - depth - 9
    falls = np.flatnonzero(wanted[:n] & ~small[:n])
    stops = np.flatnonzero(small)
    edge = np.zeros(len(data) + 1, np.int32)
    last = falls[~wanted[falls + 1]] if len(falls) else falls
    np.add.at(edge, last, 1)
    np.add.at(edge, stops[np.searchsorted(stops, last)] + 1, -1)
    taken = wanted | (np.cumsum(edge[:-1]) > 0)
    taken[n + 1 :] = False
    words = _words(data)
    direct = directly_sorted(words, np.flatnonzero(taken & small), depth)
    induced = taken & ~small
    firsts = np.searchsorted(data[direct], np.arange(257))
    fallen: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        newest = np.concatenate(fallen[c]) if fallen[c] else None
        done = [] if newest is None else [newest]
        while newest is not None and len(newest):  # runs of this byte, one byte longer each time
            newest = newest[newest > 0] - 1
            newest = newest[induced[newest] & (data[newest] == c)]
            done.append(newest)
        done.append(direct[firsts[c] : firsts[c + 1]])
        bucket = np.concatenate(done)
        fallen[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (data[before] > c)]
        if len(before):
            byte = data[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            first = _runs(byte)
            for lo, hi in zip(first, np.append(first[1:], len(byte))):
                fallen[byte[lo]].append(before[lo:hi])
    order = np.concatenate(out)
    return order[wanted[order]], words


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of its first depth bytes each suffix in order shares with the one before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for k in range(0, depth, 8):
        differ = words[order[left] + k] ^ words[order[left - 1] + k]
        ends = differ != 0
        some, x = left[ends], differ[ends]
        out[some] = k
        for shift in range(8, 64, 8):
            out[some] += x < np.uint64(1 << (64 - shift))
        left = left[~ends]
    out[left] = depth
    return np.minimum(out, depth)


def repeated(data: np.ndarray, start: np.ndarray, n: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For the windows of segments, one after another: is an equal one in a segment with a smaller id?"""
    place = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    data = np.concatenate([data, np.zeros(length + 9, np.uint8)])
    wanted = np.zeros(len(data), bool)
    wanted[place] = True
    order, words = two_stage(data, wanted, length)
    ids = np.zeros(len(data), np.int64)
    ids[place] = np.repeat(least, n)
    mine = ids[order]
    first = np.flatnonzero(common_prefixes(words, order, length) < length)
    earlier = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(order)))) < mine
    out = np.zeros(len(data), bool)
    out[order] = earlier
    return out[place]


def answer(table: pa.Table, length: int) -> pa.Table:
    """Step 4: for each row of a part, a bit a window; rows of parts below 0 as they are."""
    if table.column("part")[0].as_py() < 0:
        return table.select(["b", "u", "part", "body"])
    least, n, data = [], [], []
    for x in table.column("body"):
        raw = memoryview(x.as_buffer())
        k = int(np.frombuffer(raw[:8], "<i8")[0])
        least.append(np.frombuffer(raw[8 : 8 + 8 * k], "<i8"))
        n.append(np.frombuffer(raw[8 + 8 * k : 8 + 9 * k], np.uint8).astype(np.int64))
        data.append(np.frombuffer(raw[8 + 9 * k :], np.uint8))
    windows = np.cumsum([x.sum() for x in n])
    size = np.concatenate(n)
    start = np.cumsum(size + length - 1) - (size + length - 1)
    bits = repeated(np.concatenate(data), start, size, np.concatenate(least), length)
    return _rows(table.column("b").to_pylist(), table.column("u").to_pylist(), table.column("part").to_pylist(), [np.packbits(x).tobytes() for x in np.split(bits, windows[:-1])])


def cut(table: pa.Table, answers: pa.Table, parts: int, length: int) -> pa.Table:
    """Step 5: id, n_bytes, spans and kept bytes of each document."""
    table, texts, ids = _documents(table)
    said = _said(answers)
    spans: list[list[np.ndarray]] = [[] for _ in texts]
    for u, s in enumerate(slices_of(texts, length)):
        mine = said.get(u, {})
        bits = {-1 - p: body for p, body in mine.items() if p < 0}
        if not bits:
            continue
        key, _, _, _ = _anchors(s, ids)
        part = part_of(key, parts)
        first = _runs(part)
        for at, n in zip(first, np.diff(np.append(first, len(part)))):  # parts that knew none of a slice's anchors said nothing
            bits.setdefault(int(part[at]), bytes(2 * -(-int(n) // 8)))
        a = Asked(s, ids, bits, parts)
        if not len(a.first):
            continue
        n = a.n[a.first]  # of groups
        part = a.part[a.first]
        firsts = _runs(part)
        earlier = np.concatenate([np.unpackbits(np.frombuffer(mine[int(part[lo])], np.uint8), count=int(n[lo:hi].sum())) for lo, hi in zip(firsts, np.append(firsts[1:], len(part)))]).astype(bool)
        offset = np.cumsum(n) - n
        nth = np.arange(a.n.sum()) - np.repeat(np.cumsum(a.n) - a.n, a.n)
        gone = earlier[np.repeat(offset[a.group], a.n) + nth] | np.repeat(ids[a.document] > a.least[a.group], a.n)
        edge = np.zeros(len(s.data) + 1, np.int32)
        at = (np.repeat(a.start, a.n) + nth)[gone]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        covered = np.cumsum(edge) > 0
        for (k, where, piece), lo in zip(s.pieces, s.at):
            flips = np.flatnonzero(np.diff(np.concatenate([[False], covered[lo : lo + len(piece)], [False]])))
            if len(flips):
                spans[k].append(flips.reshape(-1, 2) + where)
    starts, kept = [], []
    for k, found in enumerate(spans):
        body = table.column("body")[k].as_buffer()
        if not found:
            starts.append([])
            kept.append(body.to_pybytes())
            continue
        merged: list[list[int]] = []
        for lo, hi in np.concatenate(found).tolist():  # pieces of a long document overlap, and are in order
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        view, at, left = memoryview(body), 0, []
        for lo, hi in merged:
            left.append(view[at:lo])
            at = hi
        starts.append([{"start": lo, "end": hi} for lo, hi in merged])
        kept.append(b"".join([*left, view[at:]]))
    sizes = pc.binary_length(table.column("body")).cast(pa.int64())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([table.column("id"), sizes, pa.array(starts, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans of start and end, kept bytes) of each row of documents (doc_id, text).

    Null and empty texts have no bytes. A document without an id has no earlier
    and no later ones: it keeps all, and nothing is cut because of it. Rows of one
    id don't count as earlier than each other, whether or not their texts are
    equal. A row's batch is a hash of its id and text: rows that repeat both are in
    one batch. Lengths from 8 to 130 bytes.
    """
    if not 8 <= length <= 130:
        raise ValueError("length must be from 8 to 130")
    spark = documents.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches, parts = (max(1, -(-total // most), min(at_once, -(-total // least))) for most, least in ((BATCH, LEAST_BATCH), (PART, LEAST_PART)))
    common = COMMON * batches
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("id"), body.alias("body"))
    docs = docs.withColumn("mark", F.xxhash64("body", "id")).withColumn("b", F.pmod("mark", F.lit(batches)).cast("int")).repartition(at_once, "b")
    known = docs.groupBy("b").applyInArrow(lambda t: announce(t, parts, length), MESSAGE).groupBy("part").applyInArrow(lambda t: recognise(t, common), MESSAGE)
    asked = docs.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(lambda t, a: ask(t, a, parts, length), MESSAGE)
    found = asked.groupBy("part").applyInArrow(lambda t: answer(t, length), MESSAGE)
    out = docs.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(lambda t, a: cut(t, a, parts, length), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", "doc_id")
