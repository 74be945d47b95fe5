"""The claim fold against a plain state machine, on random histories."""

import random

from claimloom.model import DIRECTIONAL_RELATIONS
from claimloom.operators import conflicts, lifecycle

SAME = {"not_reproduced_same_article", "direction_changed_same_article"}


def brute(emitted, reviews):
    """emitted: {(run, url): set of (src, rel, dst)}; reviews: [(run, key, decision)]."""
    state, seen = {}, {}
    for run in sorted({r for r, _ in emitted} | {r for r, _, _ in reviews}):
        urls = sorted(u for r, u in emitted if r == run)
        for url in urls:
            for k in emitted[run, url]:
                s = state.setdefault(k, {"urls": [], "active": [], "life": "supported", "review": "unreviewed", "reasons": [], "changed": False})
                for f in ("urls", "active"):
                    if url not in s[f]:
                        s[f].append(url)
                s["life"] = "supported"
                s["reasons"] = [r for r in s["reasons"] if r not in SAME]
                if s["review"] not in ("accepted", "rejected") and not s["reasons"]:
                    s["review"] = "unreviewed"
        for url in urls:
            now = emitted[run, url]
            for k in seen.get(url, set()) - now:
                s = state[k]
                if url not in s["active"]:
                    continue
                turned = k[1] in DIRECTIONAL_RELATIONS and (k[2], k[1], k[0]) in now
                s["active"].remove(url)
                s["changed"] = True
                if s["active"]:
                    s["life"] = "supported"
                    continue
                s["life"] = "unsupported_by_latest_source_processing"
                if s["review"] != "rejected":
                    s["review"] = "needs_review"
                reason = "direction_changed_same_article" if turned else "not_reproduced_same_article"
                if reason not in s["reasons"]:
                    s["reasons"].append(reason)
            seen.setdefault(url, set()).update(now)
        for r, k, decision in reviews:
            if r == run and k in state:
                state[k]["review"] = decision
                if decision != "unreviewed":
                    state[k]["reasons"] = []
    return state


def test_fold_equals_state_machine(spark):
    rng = random.Random(3)
    keys = [(a, r, b) for r in ("ACQUIRED", "PARTNERED_WITH") for a in "xyz" for b in "xyz" if a != b]
    emitted = {(run, url): set(rng.sample(keys, rng.randint(1, 5))) for run in range(1, 6) for url in ("u1", "u2", "u3") if rng.random() < 0.8}
    reviews = [(run, k, rng.choice(["accepted", "rejected", "unreviewed"])) for run in range(1, 6) for k in rng.sample(keys, 2)]
    rows = [(run, url, s, r, d) for (run, url), ks in emitted.items() for s, r, d in ks]
    df = spark.createDataFrame(rows, "run long, url string, src_id string, rel_type string, dst_id string")
    rev = spark.createDataFrame([(s, r, d, run, x) for run, (s, r, d), x in reviews], "src_id string, rel_type string, dst_id string, run long, decision string")
    events = lifecycle.article_events(df).unionByName(lifecycle.review_events(rev))
    got = {(r.src_id, r.rel_type, r.dst_id): r for r in lifecycle.fold(events).collect()}
    want = brute(emitted, reviews)
    assert set(got) == set(want)
    for k, s in want.items():
        g = got[k]
        assert (sorted(g.article_urls), sorted(g.active_article_urls), g.lifecycle_status, g.review_status, sorted(g.review_reasons), g.support_changed) == (sorted(s["urls"]), sorted(s["active"]), s["life"], s["review"], sorted(s["reasons"]), s["changed"]), k


def stepped(events):
    """Events of one claim one at a time: (seq, phase, url, kind, detail)."""
    order = {"ASSERT": 1, "NOT_REPRODUCED": 2, "DIRECTION_CHANGED": 2, "CONFLICT": 3, "REVIEW": 4}
    s = None
    for seq, url, kind, detail in sorted(events, key=lambda e: (e[0], order[e[2]], e[3] or "", e[1] or "", e[2])):
        s = s or {"urls": [], "active": [], "life": "supported", "review": "unreviewed", "reasons": [], "changed": False, "made": False}
        if kind == "ASSERT":
            s["made"] = True
            for f in ("urls", "active"):
                if url not in s[f]:
                    s[f].append(url)
            s["life"] = "supported"
            s["reasons"] = [r for r in s["reasons"] if r not in SAME]
            if s["review"] not in ("accepted", "rejected") and not s["reasons"]:
                s["review"] = "unreviewed"
        elif kind == "CONFLICT":
            if s["active"] and s["review"] != "rejected":
                s["review"] = "needs_review"
                s["reasons"] += [detail] * (detail not in s["reasons"])
        elif kind == "REVIEW":
            s["review"] = detail
            if detail != "unreviewed":
                s["reasons"] = []
        elif url in s["active"]:
            s["active"].remove(url)
            s["changed"] = True
            if not s["active"]:
                s["life"] = "unsupported_by_latest_source_processing"
                if s["review"] != "rejected":
                    s["review"] = "needs_review"
                reason = "direction_changed_same_article" if kind == "DIRECTION_CHANGED" else "not_reproduced_same_article"
                s["reasons"] += [reason] * (reason not in s["reasons"])
    return s if s and s["made"] else None


EVENTS = "src_id string, rel_type string, dst_id string, seq long, url string, kind string, detail string"


def random_events(rng, claims, length):
    rows = {}
    for c in range(claims):
        events = set()
        for _ in range(rng.randint(1, length)):
            kind = rng.choice(["ASSERT", "ASSERT", "ASSERT", "NOT_REPRODUCED", "NOT_REPRODUCED", "DIRECTION_CHANGED", "CONFLICT", "REVIEW"])
            url = rng.choice("uvw") if kind in ("ASSERT", "NOT_REPRODUCED", "DIRECTION_CHANGED") else None
            detail = rng.choice(["inverse_direction", "competing_transaction_type"]) if kind == "CONFLICT" else rng.choice(["accepted", "rejected", "unreviewed"]) if kind == "REVIEW" else None
            # an article's events of one time are one; losses of one claim at one time are told apart by address
            seq = rng.randint(0, 25) * 10 + {"ASSERT": 1, "CONFLICT": 5, "REVIEW": 9}.get(kind, 2)
            events.add((seq, url, kind, detail))
        events -= {e for e in events if e[2] == "NOT_REPRODUCED" and (e[0], e[1], "DIRECTION_CHANGED", None) in events}
        rows["a", "ACQUIRED", f"c{c}"] = sorted(events, key=str)
    return rows


def test_fold_of_random_events(spark):
    """Conflicts and reviews among assertions and losses, in any order of rows."""
    rng = random.Random(8)
    histories = random_events(rng, 600, 14)
    rows = [(*k, *e) for k, es in histories.items() for e in es]
    rng.shuffle(rows)
    got = {(r.src_id, r.rel_type, r.dst_id): r for r in lifecycle.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    want = {k: s for k, es in histories.items() if (s := stepped(es))}
    assert set(got) == set(want)
    for k, s in want.items():
        g = got[k]
        assert (g.article_urls, g.active_article_urls, g.lifecycle_status, g.review_status, g.review_reasons, g.support_changed) == (s["urls"], s["active"], s["life"], s["review"], s["reasons"], s["changed"]), (k, histories[k])


def test_no_row_of_a_fold_holds_a_history(spark):
    """A claim of 200,000 events of five articles: what is gathered is by article or by time, and is the same as step by step."""
    from pyspark.sql import functions as F

    n = 200_000
    url = F.concat(F.lit("u"), (F.col("id") % 5).cast("string"))
    kind = F.when(F.col("id") % 3 == 0, "NOT_REPRODUCED").when(F.col("id") % 1001 == 7, "REVIEW").otherwise("ASSERT")
    events = spark.range(n).select(F.lit("a").alias("src_id"), F.lit("ACQUIRED").alias("rel_type"), F.lit("b").alias("dst_id"), F.col("id").alias("seq"), url.alias("url"), kind.alias("kind"), F.when(kind == "REVIEW", F.when(F.col("id") % 2 == 0, "accepted").otherwise("unreviewed")).alias("detail"))
    rows = [(i, f"u{i % 5}", "NOT_REPRODUCED" if i % 3 == 0 else "REVIEW" if i % 1001 == 7 else "ASSERT", ("accepted" if i % 2 == 0 else "unreviewed") if i % 3 and i % 1001 == 7 else None) for i in range(n)]
    s, g = stepped(rows), lifecycle.fold(events).first()
    assert (g.article_urls, g.lifecycle_status, g.review_status, g.review_reasons, g.support_changed) == (s["urls"], s["life"], s["review"], s["reasons"], s["changed"])
    assert sorted(g.active_article_urls) == sorted(s["active"])


def test_flags_of_random_claims(spark):
    rng = random.Random(6)
    rows = {(rng.choice("abc"), rng.choice(["ACQUIRED", "MERGED_WITH", "INVESTED_IN", "PARTNERED_WITH"]), rng.choice("abc")): (rng.choice([None, "supported", "unsupported_by_latest_source_processing"]), rng.choice([None, "accepted", "rejected"])) for _ in range(60)}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "src_id string, rel_type string, dst_id string, lifecycle_status string, review_status string")
    live = {k for k, (life, review) in rows.items() if life in (None, "supported") and review != "rejected"}
    for r in conflicts.flagged(df).collect():
        k = (r.src_id, r.rel_type, r.dst_id)
        want = []
        if k in live and k[1] in DIRECTIONAL_RELATIONS and k[0] != k[2] and (k[2], k[1], k[0]) in live:
            want.append("inverse_direction")
        other = {"ACQUIRED": "MERGED_WITH", "MERGED_WITH": "ACQUIRED"}.get(k[1])
        if k in live and other and {(k[0], other, k[2]), (k[2], other, k[0])} & live:
            want.append("competing_transaction_type")
        assert (r.review_reasons, r.review_status) == (want, "needs_review" if want else rows[k][1]), k


def test_emitted_claims(spark):
    rows = [(1, "u", "FOUNDED_BY", "p", "Person", "s", "Startup", "stated"), (1, "u", "MERGED_WITH", "z", "Startup", "a", "Startup", "stated"), (1, "u", "ACQUIRED", "a", "Startup", "b", "Company", "unsure"), (1, "u", "ACQUIRED", "a", "Startup", "a", "Startup", "stated"), (1, "u", "INVESTED_IN", "i", "Investor", "a", "Startup", "attributed")]
    df = spark.createDataFrame(rows, "run long, url string, rel_type string, src_id string, src_label string, dst_id string, dst_label string, evidence_status string")
    assert sorted((r.rel_type, r.src_id, r.dst_id) for r in lifecycle.emitted_claims(df).collect()) == [("INVESTED_IN", "i", "a"), ("MERGED_WITH", "a", "z")]


def test_evidence_of_random_sightings(spark):
    """Against one sighting after another: status only rises, evidence is replaced by stated or equal ones, keywords by any, titles are kept."""
    rng = random.Random(10)
    rows = []
    for c in range(300):
        for _ in range(rng.randint(1, 8)):
            rows.append(("a", "ACQUIRED", f"c{c}", rng.randint(1, 3), rng.choice("uv"), rng.randint(0, 9), rng.choice(["stated", "attributed", "attributed"]), rng.choice(["", None, "x", "y", "z"]), rng.choice(["", None, "k", "l"]), rng.choice(["", None, "T", "U"])))
    rows = list({r[:6]: r for r in rows}.values())
    want = {}
    for src, rel, dst, _, _, _, status, text, words, title in sorted(rows, key=lambda r: r[:6]):
        s = want.setdefault((src, rel, dst), [None, None, None, []])
        if text and (not s[1] or status == "stated" or s[0] == status):
            s[1] = text
        s[0] = "stated" if "stated" in (s[0], status) else "attributed"
        s[2] = words or s[2]
        s[3] += [title] * bool(title and title not in s[3])
    df = spark.createDataFrame(rows, "src_id string, rel_type string, dst_id string, run long, url string, pos long, evidence_status string, evidence string, keywords string, article_title string")
    got = {(r.src_id, r.rel_type, r.dst_id): [r.evidence_status, r.evidence, r.keywords, r.article_titles] for r in lifecycle.evidence(df).collect()}
    assert got == want


def test_history_has_what_was_said_and_what_went(spark):
    rows = [(1, "u", "ACQUIRED", "a", "Startup", "b", "Startup", 0, "stated", "bought", "", "T"), (1, "v", "ACQUIRED", "a", "Startup", "b", "Startup", 0, "stated", "", "", ""), (2, "u", "ACQUIRED", "b", "Startup", "a", "Startup", 0, "attributed", "the other way", "", "T2"), (3, "u", "ACQUIRED", "b", "Startup", "a", "Startup", 1, "stated", "", "", "T2")]
    seen = lifecycle.sightings(spark.createDataFrame(rows, "run long, url string, rel_type string, src_id string, src_label string, dst_id string, dst_label string, pos long, evidence_status string, evidence string, keywords string, article_title string"))
    events = lifecycle.article_events(seen.select("run", "url", *lifecycle.KEYS).distinct())
    got = sorted((r.src_id, r.run, r.event, r.article_url, r.evidence or "") for r in lifecycle.history(seen, lifecycle.support(events)).collect())
    assert got == [("a", 1, "asserted", "u", "bought"), ("a", 1, "asserted", "v", ""), ("a", 2, "direction_changed", "u", ""), ("b", 2, "asserted", "u", "the other way"), ("b", 3, "asserted", "u", "")]


def test_upsert(spark):
    schema = "id string, name string, aliases array<string>, evidence_status string, description string"
    old = spark.createDataFrame([("e", "Old", ["o"], "stated", "first")], schema)
    new = spark.createDataFrame([("e", "New", ["n", "o"], "attributed", "weaker", 1), ("e", "Newer", [], "unsure", "never", 2), ("f", "F", None, "attributed", "", 1), ("f", "F2", ["x"], "stated", "text", 2)], schema + ", seq long")
    rows = {r.id: r for r in lifecycle.upserted(old, new, ["id"], "seq").collect()}
    assert (rows["e"].name, rows["e"].aliases, rows["e"].evidence_status, rows["e"].description) == ("New", ["o", "n"], "stated", "first")
    assert (rows["f"].name, rows["f"].evidence_status, rows["f"].description) == ("F2", "stated", "text")


def test_conflict_flags_both_ends(spark):
    rows = [("a", "Startup", "ACQUIRED", "b", "Startup", None, None), ("b", "Startup", "ACQUIRED", "a", "Startup", "supported", "accepted"), ("a", "Startup", "MERGED_WITH", "b", "Startup", None, None), ("c", "Startup", "ACQUIRED", "d", "Startup", None, None), ("d", "Startup", "ACQUIRED", "c", "Startup", None, "rejected")]
    df = spark.createDataFrame(rows, "src_id string, src_label string, rel_type string, dst_id string, dst_label string, lifecycle_status string, review_status string")
    got = {(r.src_id, r.rel_type, r.dst_id): (r.review_status, sorted(r.review_reasons)) for r in conflicts.flagged(df).collect()}
    assert got["a", "ACQUIRED", "b"] == ("needs_review", ["competing_transaction_type", "inverse_direction"])
    assert got["a", "MERGED_WITH", "b"] == ("needs_review", ["competing_transaction_type"])
    assert got["c", "ACQUIRED", "d"] == (None, [])
    assert tuple(conflicts.conflict_count(df).first()) == (1, 2, 3)


def test_provenance_and_article_edges(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(lifecycle.provenance(F.lit("asserted"), article_url=F.lit("u"), evidence=F.lit(None).cast("string")).alias("j")).first()
    assert row.j == '{"event":"asserted","article_url":"u"}'
    m = spark.createDataFrame([("a", "t", "Topic", "stated", "d", ""), ("a", "s", "Startup", "attributed", "d", "e"), ("a", "x", "Startup", "unsure", "d", "e")], "article_id string, entity_id string, entity_type string, evidence_status string, description string, evidence string")
    assert sorted((r.rel_type, r.dst_id, r.evidence) for r in lifecycle.article_edges(m).collect()) == [("HAS_TOPIC", "t", "d"), ("MENTIONS", "s", "e")]
