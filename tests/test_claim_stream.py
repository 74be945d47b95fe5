"""The claim streams against the fold of everything that came so far."""

import os
import random

from claimloom.operators import lifecycle
from claimloom.streaming import claims


def rows_of(df):
    return sorted((r.src_id, r.rel_type, r.dst_id, tuple(sorted(r.article_urls)), tuple(sorted(r.active_article_urls)), r.lifecycle_status, r.review_status, tuple(r.review_reasons), r.support_changed) for r in df.collect())


def at_once(spark, relations, reviews):
    """The fold of all relations and reviews so far."""
    made = spark.createDataFrame(relations, claims.RELATIONS)
    runs = made.groupBy("url").agg({"run": "collect_set"}).toDF("url", "runs").selectExpr("url", "array_sort(runs) as runs")
    events = lifecycle.article_events_for(lifecycle.emitted_claims(made), runs)
    if reviews:
        events = events.unionByName(lifecycle.review_events(spark.createDataFrame(reviews, claims.REVIEW)))
    return rows_of(lifecycle.fold(events))


def a_run(rng, run, url):
    """Relations of a run of an article: some not admitted, some loops, some of an invalid direction, perhaps none that makes a claim."""
    out = []
    for _ in range(rng.randint(1, 6)):
        rel, ends = rng.choice([("ACQUIRED", ("Startup", "Startup")), ("MERGED_WITH", ("Startup", "Startup")), ("INVESTED_IN", ("Investor", "Startup")), ("FOUNDED_BY", ("Person", "Startup"))])
        out.append((run, url, rel, rng.choice("abc"), ends[0], rng.choice("abc"), ends[1], rng.choice(["stated", "attributed", "stated", "unsure"])))
    return out


def test_states_are_those_of_the_fold_after_each_batch(spark, tmp_path):
    """Runs come late and in parts, rows twice, reviews before their claims; a batch is run again; the queries are started anew each time."""
    rng = random.Random(12)
    todo = [(run, url) for run in range(1, 5) for url in ("u1", "u2", "u3")]
    rng.shuffle(todo)
    relations, reviews = [], []
    folder = str(tmp_path)
    for step in range(4):
        part = [r for key in todo[step * 3 : step * 3 + 3] for r in a_run(rng, *key)]
        part += rng.sample(relations, min(2, len(relations)))  # some come again
        part += [x for key in todo[: step * 3][:1] for x in a_run(rng, *key)]  # and a run goes on
        relations += part
        spark.createDataFrame(part, claims.RELATIONS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        new = [(rng.choice("abc"), rng.choice(["ACQUIRED", "INVESTED_IN"]), rng.choice("abc"), rng.randint(1, 4), rng.choice(["accepted", "rejected", "unreviewed"])) for _ in range(3)]
        reviews += new
        spark.createDataFrame(new, claims.REVIEW).coalesce(1).write.mode("append").parquet(f"{folder}/reviews")
        if step == 3:  # the last batch of either query has written its rows but isn't known to have ended
            for name in ("events", "states"):
                commits = f"{folder}/{name}-checkpoint/commits"
                last = max(int(x) for x in os.listdir(commits) if x.isdigit())
                for x in (f"{last}", f".{last}.crc"):
                    if os.path.exists(f"{commits}/{x}"):
                        os.remove(f"{commits}/{x}")
        claims.run_claims(spark, f"{folder}/in", folder, f"{folder}/reviews")
        assert rows_of(claims.claims_now(spark, folder)) == at_once(spark, relations, reviews), step


def test_the_steps_of_the_stream_are_those_of_the_fold(spark):
    """folded() against lifecycle.fold() on histories with conflicts."""
    rng = random.Random(1)
    histories = {}
    for c in range(150):
        events = set()
        for _ in range(rng.randint(1, 12)):
            kind = rng.choice(["ASSERT", "ASSERT", "NOT_REPRODUCED", "CONFLICT", "REVIEW"])
            at = rng.randint(0, 9) * 10 + {"ASSERT": 1, "NOT_REPRODUCED": 2, "CONFLICT": 5, "REVIEW": 9}[kind]
            events.add((at, rng.choice("uv") if kind in ("ASSERT", "NOT_REPRODUCED") else None, kind, "inverse_direction" if kind == "CONFLICT" else rng.choice(["accepted", "rejected", "unreviewed"]) if kind == "REVIEW" else None))
        histories["a", "ACQUIRED", f"c{c}"] = events
    rows = [(*k, seq, kind, url, detail) for k, es in histories.items() for seq, url, kind, detail in es]
    got = {(r.src_id, r.rel_type, r.dst_id): (r.article_urls, r.active_article_urls, r.lifecycle_status, r.review_status, r.review_reasons, r.support_changed) for r in lifecycle.fold(spark.createDataFrame(rows, lifecycle.EVENTS)).collect()}
    assert got == {k: s for k, es in histories.items() if (s := claims.folded(list(es)))}


def test_sightings_that_repeat_are_combined_before_an_article_gathers_them(spark, tmp_path):
    from claimloom.streaming import claims

    row = (1, "u", "INVESTED_IN", "investor:1", "Investor", "startup:1", "Startup", "stated")
    spark.createDataFrame([row] * 500, claims.RELATIONS).write.parquet(f"{tmp_path}/in")
    claims.run_claims(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/made").count() == 1
    assert claims.claims_now(spark, f"{tmp_path}/out").count() == 1
