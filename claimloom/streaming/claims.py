"""Claims kept up to date by two streams with a state store.

The article stream has a state for each article: the claims that each of its runs
made. A file of relations changes those of its articles, and what that changes
about their claims goes to an event log: a row for each claim, article and run
that is new or reads differently now, whichever order runs come in.

The claim stream reads that log and reviews, has a state for each claim (its
events, by article), and writes the new state of each claim that a batch touches.

Batches are numbered and write folders of their own, so one that is run again
overwrites what it wrote, and an event that is read twice replaces itself. The
stores are RocksDB's, on the executors' disks, with checkpoints in the shared
folder; a query that is started again goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimloom.model import DIRECTIONAL_RELATIONS, SUPPORTED, UNSUPPORTED
from claimloom.operators.lifecycle import EVENTS, KEYS, claim_ends

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELATIONS = "run long, url string, rel_type string, src_id string, src_label string, dst_id string, dst_label string, evidence_status string"
REVIEW = "src_id string, rel_type string, dst_id string, run long, decision string"
STATE = "src_id string, rel_type string, dst_id string, article_urls array<string>, active_article_urls array<string>, lifecycle_status string, review_status string, review_reasons array<string>, support_changed boolean"


def events_of(runs: dict[int, set[tuple]]) -> dict[tuple, str]:
    """(claim, run) to what that run of an article does to the claim, for all runs from the first that made it."""
    first: dict[tuple, int] = {}
    for run in sorted(runs):
        for claim in runs[run]:
            first.setdefault(claim, run)
    out = {}
    for run, made in runs.items():
        for claim, since in first.items():
            if run >= since:
                src, rel, dst = claim
                turned = rel in DIRECTIONAL_RELATIONS and (dst, rel, src) in made
                out[claim, run] = "ASSERT" if claim in made else "DIRECTION_CHANGED" if turned else "NOT_REPRODUCED"
    return out


class Articles(StatefulProcessor):
    """Of an article: the claims of each run, as one value: its runs are few."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getValueState("runs", "runs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = json.loads(self.runs.get()[0]) if self.runs.exists() else []
        runs = {run: {tuple(c) for c in claims} for run, claims in stored}
        before = events_of(runs)
        for part in rows:
            for run, *claim in part[["run", *KEYS]].itertuples(index=False, name=None):
                made = runs.setdefault(int(run), set())
                if isinstance(claim[0], str):
                    made.add(tuple(claim))
        self.runs.update((json.dumps([[run, sorted(claims)] for run, claims in runs.items()]),))
        new = [(*claim, run * 10 + (1 if kind == "ASSERT" else 2), kind, key[0], None) for (claim, run), kind in events_of(runs).items() if before.get((claim, run)) != kind]
        yield pd.DataFrame(sorted(new, key=str), columns=[*KEYS, "seq", "kind", "url", "detail"])

    def close(self) -> None:
        pass


def folded(events: list[tuple]) -> tuple | None:
    """The state after (seq, url, kind, detail) in order, as lifecycle.fold() has it; None if nothing was asserted."""
    urls, active, reasons = {}, {}, []
    review, changed, asserted = "unreviewed", False, False
    phase = {"ASSERT": 1, "NOT_REPRODUCED": 2, "DIRECTION_CHANGED": 2, "CONFLICT": 3}
    for _, url, kind, detail in sorted(events, key=lambda e: (e[0], phase.get(e[2], 4), e[3] or "", e[1] or "")):
        conflicts = [r for r in reasons if not r.endswith("_same_article")]
        if kind == "ASSERT":
            asserted = True
            urls.setdefault(url)
            active.setdefault(url)
            reasons = conflicts
            if review not in ("accepted", "rejected") and not conflicts:
                review = "unreviewed"
        elif kind == "REVIEW":
            review = detail
            reasons = reasons if detail == "unreviewed" else []
        elif kind == "CONFLICT":
            if active and review != "rejected":
                review = "needs_review"
                reasons = reasons if detail in reasons else [*reasons, detail]
        elif url in active:
            del active[url]
            changed = True
            if not active:
                review = review if review == "rejected" else "needs_review"
                reasons = [*reasons, "direction_changed_same_article" if kind == "DIRECTION_CHANGED" else "not_reproduced_same_article"]
    return (list(urls), list(active), SUPPORTED if active else UNSUPPORTED, review, reasons, changed) if asserted else None


class Claims(StatefulProcessor):
    """Of a claim: its events, by article; reviews and conflicts have no article. Times are told apart, so an event that comes again replaces itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "url string", "events string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list] = {}
        for part in rows:
            for seq, kind, url, detail in part[["seq", "kind", "url", "detail"]].itertuples(index=False, name=None):
                new.setdefault(url or "", []).append((int(seq), kind, detail))
        for url, found in new.items():
            known = {(seq, detail) if kind in ("REVIEW", "CONFLICT") else (seq // 10, None): (seq, kind, detail) for seq, kind, detail in (json.loads(self.events.getValue((url,))[0]) if self.events.containsKey((url,)) else [])}
            for seq, kind, detail in found:
                known[(seq, detail) if kind in ("REVIEW", "CONFLICT") else (seq // 10, None)] = (seq, kind, detail)
            self.events.updateValue((url,), (json.dumps(sorted(known.values(), key=str)),))
        state = folded([(seq, url or None, kind, detail) for (url,), (events,) in self.events.iterator() for seq, kind, detail in json.loads(events)])
        if state:
            yield pd.DataFrame([(*key, *state)], columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def _stream(spark: SparkSession, schema: str, folder: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def _started(rows: DataFrame, folder: str, name: str):
    """Starts a query that writes each batch to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()


def follow_articles(stream: DataFrame, folder: str):
    """Starts the article stream over relations (see lifecycle.emitted_claims); events go to folder/events.

    An article's rows come to one task. So the batches of relations are first
    written to folder/made with each claim of a run once: sightings that repeat are
    combined in all tasks, and an article's task reads what its state will hold.
    """
    spark, found = stream.sparkSession, claim_ends(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{folder}/made/batch={number}")

    found.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/made-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.readStream.schema(found.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/made")
    return _started(rows.groupBy("url").transformWithStateInPandas(Articles(), EVENTS, "Update", "None"), folder, "events")


def follow_claims(events: DataFrame, folder: str):
    """Starts the claim stream over events; new states go to folder/states."""
    return _started(events.groupBy(*KEYS).transformWithStateInPandas(Claims(), STATE, "Update", "None"), folder, "states")


def run_claims(spark: SparkSession, relations: str, folder: str, reviews: str | None = None, files_per_batch: int = 10) -> None:
    """Brings the states in folder up to date with the files of relations and reviews (REVIEW) that are there now."""
    follow_articles(_stream(spark, RELATIONS, relations, files_per_batch), folder).awaitTermination()
    events = _stream(spark, EVENTS, f"{folder}/events", files_per_batch)
    if reviews:
        rows = _stream(spark, REVIEW, reviews, files_per_batch)
        events = events.unionByName(rows.select(*KEYS, (F.col("run") * 10 + 9).alias("seq"), F.lit("REVIEW").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("decision").alias("detail")))
    follow_claims(events, folder).awaitTermination()


def claims_now(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every claim: that of the last batch that touched it."""
    rows = spark.read.schema(STATE + ", batch long").parquet(f"{folder}/states")
    rest = [c.split()[0] for c in STATE.split(", ")][3:]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*KEYS, *[F.col("s")[c].alias(c) for c in rest])
