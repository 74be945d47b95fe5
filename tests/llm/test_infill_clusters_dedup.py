"""Fill-in-middle, centroid clusters and suffix-array dedup against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import hamerly, infill, queries, suffixdedup

# fill-in-middle


def plain_infill(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab\n<PS>é\U0001f600", max_size=40), st.text(max_size=40)), st.integers(-5, 10**6))
def test_infill_is_cut_and_put_together_again(text, doc_id):
    pattern = infill.regex.compile(infill.UNITS["line"])
    got = infill.cut(pattern, 7, 100, 50, str(doc_id), text)
    assert got == plain_infill(doc_id, text)
    assert infill.restored(got[-1], got[1]) == text
    for unit in infill.UNITS.values():
        ends = infill.unit_ends(infill.regex.compile(unit), text)
        assert list(ends) == sorted(set(ends)) and ends[-1] == len(text)


def test_infill_rows(spark):
    big = 1 << 60
    rows = [(big + 1, "a\nb\n", "x"), (None, "one\ntwo", "y"), (3, None, "z"), (3, "", None), (4, "has <S> in it\n", "z"), (5, "line\n" * 50_000, "z"), (5, "line\n" * 50_000, "z"), (6, "\n\n\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = infill.transform(docs).collect()
    want = sorted((repr((i, *plain_infill(i, t), t or "")) for i, t, _ in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in got) == want
    assert infill.transform(docs.limit(0)).count() == 0
    assert {r.form for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    some = infill.transform(docs, unit="word", rate=40, spm=100)
    assert {r.form for r in some.collect()} <= {"plain", "spm"} and all(r.restored == (r.text or "") for r in some.collect())


# centroid clusters


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-hamerly.MOST, min(hamerly.MOST, x)) for x in v]) for i, v in kept]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        of = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(kept, of) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [far(v, c[o]) for (_, v), o in zip(kept, of)]
    inertia = [sum(x for x, o in zip(d, of) if o == j) for j in range(len(c))]
    return sorted(repr((i, o, x, inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest())) for (i, _), o, x in zip(kept, of, d))


def clustered(spark, rows):
    found = hamerly.report(*hamerly.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")))
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in found.collect())


def test_clusters_with_ties_repeats_and_vectors_left_out(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -0.5, 1 / 3]) for _ in range(64)], "x") for i in range(150)]
    rows += [((1 << 60) + 1, rows[0][1], None), (None, rows[1][1], "n"), (7, rows[7][1], "again"), (7, rows[8][1], "another")]
    rows += [(900, None, "x"), (901, [1.0] * 63, "x"), (902, [1.0] * 63 + [None], "x"), (903, [float("nan")] + [0.0] * 63, "x"), (904, [float("inf")] + [0.0] * 63, "x"), (905, [1e300] + [-1e300] + [0.0] * 62, "x")]
    rows += [(1000 + i, [0.25] * 64, "same") for i in range(80)]
    assert clustered(spark, rows) == plain_clusters([r[:2] for r in rows])


def test_few_vectors_and_none(spark):
    few = [(i, [float(i)] * 64, "x") for i in range(5)]
    assert clustered(spark, few) == plain_clusters([r[:2] for r in few])
    assert clustered(spark, few[:1]) == plain_clusters([r[:2] for r in few[:1]])
    assert clustered(spark, [(1, [1.0], "x")]) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 4))
def test_bounds_hold_and_never_change_a_result(seed, k, d):
    """Random moves of centroids: clusters are those of a full scan, bounds are true, and a vector that isn't scanned had no nearer centroid."""
    rng = np.random.default_rng(seed)
    v, c = rng.integers(-20, 20, (60, d)), rng.integers(-20, 20, (k, d))
    cluster, upper, lower = hamerly.assigned(v, c)
    for _ in range(5):
        new = c + rng.integers(-3, 4, c.shape) * rng.integers(0, 2, (k, 1))
        cluster, upper, lower, scanned = hamerly.reassigned(v, cluster, upper, lower, c, new)
        c = new
        exact = hamerly.distances(v, c)
        assert (cluster == exact.argmin(axis=1)).all()
        own = np.sqrt(exact[np.arange(60), cluster].astype(float))
        assert (upper >= own).all()
        if k > 1:
            others = np.sqrt(np.where(np.arange(k) == cluster[:, None], np.inf, exact.astype(float)).min(axis=1))
            assert (lower <= others + 1e-12).all()


def test_bounds_spare_scans(spark):
    """Of vectors in clear groups, few are scanned again after the first round."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(64)[i % 16] * 50 + rng.normal(0, 0.1, 64)).tolist()) for i in range(400)]
    found, _ = hamerly.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=6)
    assert found.where("scanned").count() < 100


# suffix-array dedup


def plain_dedup(docs, length=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        if i is not None:
            for at in range(len(b) - length + 1):
                w = b[at : at + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for at in range(len(b) - length + 1):
                if first[b[at : at + length]] < i:
                    gone[at : at + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append(repr((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def deduped(spark, tmp_path, docs):
    folder = tmp_path / f"d{random.random()}"
    spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, b int, kept string").write.parquet(f"{folder}/documents.parquet")
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in queries.op13_suffix_dedup(spark, str(folder)).collect())


def text_of(rng, n, letters="abcdefgh "):
    return "".join(rng.choice(letters) for _ in range(n))


def test_dedup_of_planted_passages(spark, tmp_path):
    rng = random.Random(11)
    passages = [text_of(rng, n) for n in (49, 50, 51, 80, 400)]
    docs = []
    for i in range(120):
        parts = [text_of(rng, rng.randint(0, 120)) for _ in range(3)]
        docs.append(((i * 37) % 120 - 10, parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages) + parts[2]))
    docs += [(500, docs[0][1]), (501, docs[0][1]), (502, docs[1][1][5:]), (None, docs[2][1]), (None, None), (503, None), (504, ""), (505, "é" * 60), (506, "xé" + "é" * 30), (507, "a" * 3000), (508, "b" + "a" * 200), (509, "ab" * 500), (510, "ba" * 100)]
    docs += [(500, docs[0][1]), (509, "something else " * 9), ((1 << 60) + 1, passages[4]), (1 << 60, passages[4])]
    assert deduped(spark, tmp_path, docs) == plain_dedup(docs)


def test_dedup_of_few_letters(spark, tmp_path):
    """Low entropy: long runs, periods, anchors that repeat within a document."""
    rng = random.Random(2)
    docs = [(i, text_of(rng, rng.randint(0, 400), rng.choice(["a", "ab", "aab", "\x00a"]))) for i in range(80)]
    assert deduped(spark, tmp_path, docs) == plain_dedup(docs)


def test_dedup_of_a_very_common_line(spark, tmp_path, monkeypatch):
    """Anchors beyond COMMON go window by window, with the same result; so do pieces of long documents."""
    rng = random.Random(4)
    line = text_of(rng, 70)
    docs = [(i, text_of(rng, 60) + line + text_of(rng, 60)) for i in range(150)] + [(900, line * 40), (901, text_of(rng, 9000) + line + text_of(rng, 3000))]
    want = plain_dedup(docs)
    monkeypatch.setattr(suffixdedup, "COMMON", 0)
    monkeypatch.setattr(suffixdedup, "BATCH", 1000)
    assert deduped(spark, tmp_path, docs) == want


def test_dedup_of_no_rows(spark, tmp_path):
    assert deduped(spark, tmp_path, []) == []


@pytest.mark.parametrize("length", [8, 20, 33, 130])
def test_dedup_of_other_lengths(spark, length):
    rng = random.Random(length)
    docs = [(i, text_of(rng, rng.randint(0, 500), "ab" if length > 20 else "abcdef")) for i in range(40)]
    docs += [(100 + i, docs[i][1][: length + i]) for i in range(20)]
    got = suffixdedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length)
    assert sorted(repr((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())) for r in got.collect()) == plain_dedup(docs, length)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.sampled_from([b"", b"a", b"ab"]), st.sampled_from([8, 13, 50]), st.integers(0, 10**6))
def test_two_stage_order_and_prefixes(some, letters, depth, seed):
    data = bytes(letters[x % len(letters)] for x in some) if letters else some
    rng = np.random.default_rng(seed)
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(depth + 9, np.uint8)])
    wanted = np.zeros(len(padded), bool)
    wanted[: len(data)] = rng.random(len(data)) < rng.choice([0.1, 0.5, 1.0])
    order, words = suffixdedup.two_stage(padded, wanted, depth)
    assert sorted(order) == list(np.flatnonzero(wanted))
    keys = [padded[i : i + depth].tobytes() for i in order]
    assert keys == sorted(keys)
    shared = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(keys, keys[1:])]
    assert suffixdedup.common_prefixes(words, order, depth)[1:].tolist() == shared
