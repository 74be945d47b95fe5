"""What goes with a run: parameters and tags, timed steps, tasks in the background."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import SparkSession

log = logging.getLogger("claimloom.runs")

# Names of parameters, tags and counts, and the gate's name.
REQUEST = ("max_pages", "source_name", "source_url", "include_feed")
SETTINGS = ("openai_model", "embedding_model", "embedding_similarity_threshold", "enable_embedding_resolution", "llm_retry_attempts", "llm_max_concurrency", "llm_gleaning_passes", "app_env", "git_sha", "app_version")
COUNTS = ("articles_found", "articles_processed", "articles_failed", "entities_extracted", "relationships_created", "duration_ms")
GATE = "evidence_status:stated|attributed"


def parameters(request: dict, settings: dict) -> dict:
    """A run's parameters. What a request or the settings leave out is None."""
    return {n: request.get(n) for n in REQUEST} | {"paths_count": len(request.get("paths") or ()), "admission_policy": GATE} | {n: settings.get(n) for n in SETTINGS}


def tags(request: dict, settings: dict) -> dict[str, str]:
    """What runs are searched by."""
    found = {"env": settings.get("app_env"), "git_sha": settings.get("git_sha"), "app_version": settings.get("app_version"), "source_name": request.get("source_name"), "model": settings.get("openai_model")}
    return {n: str(v) for n, v in found.items() if v is not None}


@contextmanager
def timed(step: str, into: dict[str, float] | None = None) -> Iterator[None]:
    """Logs a step's milliseconds, and adds them to a dict, if the step fails too."""
    start = time.perf_counter()
    outcome = "failed"
    try:
        yield
        outcome = "done"
    finally:
        ms = round((time.perf_counter() - start) * 1000, 3)
        if into is not None:
            into[step] = into.get(step, 0.0) + ms
        log.info("step %s %s in %s ms", step, outcome, ms, extra={"event": "step", "workflow_step": step, "duration_ms": ms})


class Tasks:
    """Work in threads whose Spark jobs form a group each, so that a task can be cancelled. Statuses live as long as this object."""

    def __init__(self, spark: SparkSession):
        self.spark, self._status, self._threads = spark, {}, {}

    def start(self, name: str, work: Callable[[str], object]) -> str:
        """Runs work(task id); gives the id."""
        task = str(uuid.uuid4())
        self._status[task] = {"task_id": task, "name": name, "status": "queued", "created_at": datetime.now(timezone.utc), "started_at": None, "completed_at": None, "result": None, "error": None}
        self._threads[task] = InheritableThread(target=self._run, args=(task, work), session=self.spark, daemon=True)
        self._threads[task].start()
        return task

    def get(self, task: str) -> dict | None:
        return dict(self._status[task]) if task in self._status else None

    def wait(self, task: str, seconds: float | None = None) -> dict | None:
        if task in self._threads:
            self._threads[task].join(seconds)
        return self.get(task)

    def cancel(self, task: str) -> None:
        """Stops the task's Spark jobs; the task then fails with Spark's error."""
        self.spark.sparkContext.cancelJobGroup(task)

    def _run(self, task: str, work: Callable[[str], object]) -> None:
        status = self._status[task]
        status.update(status="running", started_at=datetime.now(timezone.utc))
        self.spark.sparkContext.setJobGroup(task, status["name"], interruptOnCancel=True)
        try:
            with timed(status["name"]):
                found = work(task)
            status.update(status="succeeded", result=found if found is None or isinstance(found, dict) else {"value": found})
        except Exception as error:  # whatever a task fails with is its status
            status.update(status="failed", error=str(error))
            log.exception("task %s failed", status["name"])
        finally:
            status["completed_at"] = datetime.now(timezone.utc)


def result_text(result: dict | None) -> str:
    """A task's result in a line."""
    if not result:
        return "no result payload"
    return ", ".join(f"{n}={result[n]}" for n in COUNTS if n in result) or "result ready"
