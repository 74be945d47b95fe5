from claimloom.functions.normalize import key_column
from claimloom.operators import extract as x

SEP, END = "<|#|>", "<|COMPLETE|>"


def text(*rows):
    return "\n".join(SEP.join(r) for r in rows)


def parsed(spark, *texts):
    return x.parse(spark.createDataFrame(list(enumerate(texts)), "article_id long, text string"))


def test_rows_and_defaults(spark):
    t = text(("entity", "Acme", "Startup", "stated", "makes"), ("entity", "Bob", "Person", "founder"), ("ENTITY", "Cat", "Topic", "sure?", "thing"), ("relation", "Acme", "Bob", "founded_by", "stated", "a,b", "by Bob"), ("relation", "Acme", "Cat", "HAS_TOPIC", "", "about cats"), ("relation", "a", "b", "c", "d"), ("note", "a", "b", "c")) + f"\n\n{END}\n" + text(("entity", "Late", "Topic", "stated", "x"))
    rows = sorted(parsed(spark, t, None, "").collect(), key=lambda r: r.pos)
    assert [(r.name or r.source, r.evidence_status, r.evidence_status_defaulted) for r in rows] == [("Acme", "stated", False), ("Bob", "unsure", True), ("Cat", "unsure", True), ("Acme", "stated", False), ("Acme", "unsure", True)]
    assert rows[1].description == "founder" and rows[3].rel_type == "FOUNDED_BY" and rows[3].keywords == "a,b" and rows[4].keywords is None


def test_required_parts(spark):
    t = text(("entity", "", "Startup", "stated", "x"), ("entity", "A", "Startup", "stated", ""), ("relation", "A", "B", "ACQUIRED", "stated", "", ""))
    assert parsed(spark, t).count() == 0


def test_typed_drops_unknown_ends_and_types(spark):
    t = text(("entity", "Acme", "startup", "stated", "x"), ("entity", "Bob", "alien", "stated", "x"), ("entity", "Cat", "Topic", "stated", "x"), ("relation", "ACME", "cat", "HAS_TOPIC", "stated", "", "e"), ("relation", "Acme", "Bob", "ACQUIRED", "stated", "", "e"), ("relation", "Acme", "Cat", "LIKES", "stated", "", "e"))
    mentions, relations = x.typed(parsed(spark, t))
    assert {r.name for r in mentions.collect()} == {"Acme", "Cat"}
    (r,) = relations.collect()
    assert (r.rel_type, r.source_type, r.target_type) == ("HAS_TOPIC", "Startup", "Topic")


def test_gleaning(spark):
    one = parsed(spark, text(("entity", "Acme", "Startup", "unsure", "x"), ("entity", "Bob", "Person", "stated", "y")))
    two = parsed(spark, text(("entity", "acme", "Startup", "stated", "z"), ("entity", "New", "Topic", "stated", "n")))
    rows = sorted(x.gleaned(one, two).collect(), key=lambda r: (r["pass"], r.pos))
    assert [(r.name, r.change) for r in rows] == [("acme", "corrected"), ("Bob", "kept"), ("New", "added")]
    assert x.gleaning_summary(x.gleaned(one, two)).first().entity_added == 1


def test_gate_and_endpoints(spark):
    mentions = spark.createDataFrame([(1, 0, "Startup", "Acme", "stated", False, "x"), (1, 1, "Investor", "Fund", "unsure", True, "y")], "article_id long, pos int, entity_type string, name string, evidence_status string, evidence_status_defaulted boolean, description string")
    kept, counts = x.gate(mentions)
    assert kept.count() == 1 and tuple(counts.first()) == (2, 1, 1)
    relations = spark.createDataFrame([(1, 2, "FOUNDED_BY", "ACME", "Startup", "Bob", "Person", None, "attributed", False, "e"), (1, 3, "MERGED_WITH", "Un", "Startup", "Sure", "Startup", None, "unsure", True, "e")], "article_id long, pos int, rel_type string, source_name string, source_type string, target_name string, target_type string, keywords string, evidence_status string, evidence_status_defaulted boolean, evidence string")
    rows = x.with_endpoints(kept, relations, key_column).where("materialised").collect()
    assert [(r.name, r.entity_type, r.evidence_status) for r in rows] == [("Bob", "Person", "attributed")]


def test_a_text_is_cut_by_itself_and_ends_are_hashed(spark):
    """No task gathers an article's lines to find where its text stops, and no texts are sorted for the ends' types."""
    from claimloom.functions.batches import dealt

    sep = x.SEPARATOR
    text = f"entity{sep}A{sep}startup{sep}stated{sep}x\n{x.COMPLETE}\nentity{sep}B{sep}topic{sep}stated{sep}y"
    rows = spark.createDataFrame([(1, text), (2, None), (3, x.COMPLETE), (None, text)], "article_id long, text string")
    parsed = x.parse(rows)
    assert [(r.article_id, r.pos, r.name) for r in parsed.collect()] == [(1, 0, "A")]
    assert "Aggregate" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in x.typed(parsed)[1]._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert dealt(spark.range(1000), "id", 100).rdd.getNumPartitions() == 10 and spark.conf.get("spark.sql.shuffle.partitions") == "10"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
