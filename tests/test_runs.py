import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.functions import present
from claimloom.operators import extract, metrics, runs


def test_parameters_and_tags():
    made = runs.parameters({"max_pages": 2, "paths": ["a", "b"]}, {"git_sha": "1"})
    assert made["max_pages"] == 2 and made["paths_count"] == 2 and made["admission_policy"] == runs.GATE and made["openai_model"] is None
    assert runs.tags({"source_name": "s"}, {"app_env": "dev"}) == {"env": "dev", "source_name": "s"}


def test_timed_adds_up_and_counts_failures():
    took: dict = {}
    with runs.timed("a", took):
        pass
    first = took["a"]
    with pytest.raises(ValueError), runs.timed("a", took):
        raise ValueError
    assert took["a"] >= first >= 0


def test_tasks(spark):
    tasks = runs.Tasks(spark)
    good = tasks.start("count", lambda task: {"articles_found": spark.range(5).count(), "other": 1})
    plain = tasks.start("plain", lambda task: 3)
    bad = tasks.start("bad", lambda task: 1 / 0)
    done = tasks.wait(good, 60)
    assert done["status"] == "succeeded" and done["created_at"] <= done["started_at"] <= done["completed_at"] and runs.result_text(done["result"]) == "articles_found=5"
    assert tasks.wait(plain, 60)["result"] == {"value": 3} and runs.result_text({"value": 3}) == "result ready" and runs.result_text(None) == "no result payload"
    failed = tasks.wait(bad, 60)
    assert failed["status"] == "failed" and "division" in failed["error"] and failed["result"] is None
    assert tasks.get("none") is None and tasks.wait("none") is None


def test_properties(spark):
    at = datetime.datetime(2024, 5, 1)
    rows = spark.createDataFrame(
        [("a", 1234.5678, "2024-05-01", "soon", ["x ", " "], float("nan"), at, "unsure"), (None, None, "", None, [], 2.0, None, None)],
        "canonical_name string, amount double, published_at string, announced_at string, category array<string>, stage double, url timestamp, evidence_status string",
    ).withColumn("id", F.lit("n"))
    found = [(r.property, r.value) for r in present.property_rows(rows).orderBy("place").collect()]
    assert found == [("canonical_name", "a"), ("category", "x"), ("stage", "2"), ("amount", "1,235 EUR"), ("published_at", "01 May 2024"), ("announced_at", "soon"), ("evidence_status", "Unsure - not written to graph"), ("url", "01 May 2024")]
    article = spark.createDataFrame([("n", "ab c", "{}", 1234.56789, True)], "id string, text string, trace_provenance string, zeta double, flag boolean")
    assert [(r.property, r.value) for r in present.property_rows(article, article=True).orderBy("place").collect()] == [("id", "n"), ("text", "4 characters"), ("zeta", "1,234.568")]
    assert present.property_rows(spark.range(2)).count() == 0


def test_fact_summaries(spark):
    entities = spark.createDataFrame([(1, 0, "n", "Startup", "stated", False, "d " * 200)], "article_id long, pos long, name string, entity_type string, evidence_status string, evidence_status_defaulted boolean, description string")
    relations = spark.createDataFrame([(1, 0, "a", "b", "ACQUIRED", "stated", False, "k", "d")], "article_id long, pos long, source string, target string, rel_type string, evidence_status string, evidence_status_defaulted boolean, keywords string, description string")
    one, two = extract.fact_summaries(entities, relations)
    assert len(one.first().description) == 240 and two.first().label == "a -> b (ACQUIRED)"
    first = extract.audit(spark.createDataFrame([("entity",), ("relation",)], "kind string")).first()
    assert (first.gleaning_configured_passes, first.gleaning_passes_run, first.total_changes, first.final_raw_entities, first.final_raw_relationships) == (1, 0, 0, 1, 1)


def test_usage_and_registry_size(spark):
    calls = spark.createDataFrame([(1, 2, None), (None, None, None)], "p int, c int, t int").select(metrics.call_usage(F.col("p"), F.col("c"), F.col("t")).alias("u")).collect()
    assert [tuple(r.u) if r.u else None for r in calls] == [(1, 2, 0), None]
    assert metrics.registry_size(spark.range(4)).first().registry_size == 4
