"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os
import pickle
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import brown, bytecnn, decontaminate, fertility, htmltext, langid, ngramjoin, packing, toxicity, urlfilter

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards make toxic brew for two big jovial queens "
CLASH = "id y h body doc node key keys row n size band at a b links digest copies text_len word c pool kind free k own decided_id url html page_id score held_out predicted".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


#: A number that is no floating-point number.
BIG = 2**60 + 1


def docs(spark, rows):
    """One partition, so that all ids are in one Arrow batch."""
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS).coalesce(1)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


ROWS = [(1, PROSE * 8, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "xx"), (5, PROSE * 8, "en"), (5, PROSE * 8, "en"), (None, PROSE, "en"), (6, "x" * 50_000, "de"), (7, PROSE * 900, "fr"), (8, "日本語 テキスト " * 40, "ja"), (9, "a\x00b \ud7ff <|endoftext|>", "en"), (10, "bad idiot " * 30, "en"), (BIG, "one of a kind", "en")]
IDS = {i for i, _, _ in ROWS}
LABELS = [(i, int(i % 2 == 0), int(i == 10)) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (5, 0, 0)]


@pytest.fixture(scope="module")
def given(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("id", F.lit("z")).withColumn("h", F.lit(1))
    return docs(spark, ROWS), labels


def per_row(df, n=len(ROWS)):
    rows = df.collect()
    assert len(rows) == n and (n != len(ROWS) or {r.doc_id for r in rows} == IDS)
    return {r.doc_id: r for r in rows}


def test_quality_rules(given):
    got = per_row(fertility.quality_rules(given[0]))
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[8].band == "kana" and got[6].n_words == 1


@pytest.mark.parametrize("module, f", [(toxicity, toxicity.score_toxicity), (bytecnn, bytecnn.score_quality)])
def test_classifiers(spark, given, module, f):
    got = per_row(f(*given))
    assert all(0 <= r.score <= 1 and r.held_out in (True, False) for r in got.values())
    assert got[2].score == got[3].score
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({round(r.score, 6) for r in per_row(f(given[0], none)).values()}) == 1
    assert f(given[0].limit(0), given[1]).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in per_row(f(given[0], one)).values())


def test_language_model(given):
    got = per_row(brown.score_lm(given[0]))
    assert got[2].n_tokens == got[3].n_tokens == got[4].n_tokens == 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in got.values())
    empty = brown.score_lm(given[0].limit(0))
    assert empty.count() == 0


def test_language_model_without_training(spark):
    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    for r in brown.score_lm(docs(spark, [(i, "one two", "en") for i in held])).collect():
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and r.n_tokens == 3


def test_decontamination(spark, given):
    items = spark.createDataFrame([(1, PROSE), (2, PROSE), (3, None), (4, "short"), (5, "unrelated words of some length that no document has at all"), (None, PROSE)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.find_leaks(given[0], items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 5, 7, None) for i in (1, 2)} and all(r.distance == 0 for r in got)
    assert len(got) == 10
    big = spark.createDataFrame([(BIG, "of a  KIND"), (None, "of a kind"), (6, "f a kin"), (7, ""), (8, " "), (9, "one")], "item_id long, text string").coalesce(1)
    assert {(r.doc_id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.find_leaks(given[0], big).collect()} == {(BIG, BIG, 0, 4, 13), (BIG, 9, 0, 0, 3)}
    kept = decontaminate.without_leaks(given[0].select("doc_id", "text"), items.unionByName(big, True), block_chars=60).collect()
    assert {r.doc_id for r in kept} == IDS - {1, 5, 7, None, BIG}
    assert decontaminate.find_leaks(given[0], items.limit(0)).count() == 0
    assert decontaminate.find_leaks(given[0].limit(0), items).count() == 0
    blocked = decontaminate.find_leaks(given[0], items, block_chars=60).collect()
    assert sorted(map(str, blocked)) == sorted(map(str, got))


def test_packing(given):
    rows = packing.pack(given[0]).collect()
    assert {r.doc_id for r in rows} == IDS
    ends = sorted((r.sequence_id, r.offset, r.offset + r.length) for r in rows)
    assert all(b[1] == (a[2] if a[0] == b[0] else 0) and b[2] <= 1024 for a, b in zip([(None, 0, 0), *ends], ends))
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert len([r for r in rows if r.doc_id == 5]) == 2
    assert packing.pack(given[0].limit(0)).count() == 0


def test_jaccard_join(given):
    rows = ngramjoin.jaccard_join(given[0]).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert set(got) == IDS and got[BIG].class_id == got[BIG].copy_of == BIG
    # 7 has the same set of shingles; that of the row without an id is similar
    assert got[1].class_id == got[5].class_id == got[None].class_id == 1 and got[1].n_links == got[5].n_links == got[None].n_links == 4 and got[None].copy_of is None
    assert got[7].copy_of == 1 and got[2].n_links == got[3].n_links == 0 and got[2].class_id == 2 and got[2].n_shingles == 0
    assert ngramjoin.jaccard_join(given[0].limit(0)).count() == 0


PAGES = [(1, "https://A.example.net/de/x", '<html lang="de"><p>der hund und die katze</p>'), (2, None, None), (3, "no address", ""), (4, "https://a.example.net/", "<p>" * 500 + "deep"), (4, "https://a.example.net/", "<p>" * 500 + "deep"), (None, "http://[", "<div"), (BIG, "https://b.example.net/", "<p>big</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    for c in "row host p ll suffix domain declared text lang value v says prior verdict rule".split():
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_html(pages):
    rows = htmltext.extract(pages).collect()
    assert [r.text for r in rows if r.page_id == BIG] == ["big"]
    assert len(rows) == len(PAGES) and {r.text for r in rows if r.page_id == 4} == {"deep"} and {r.text for r in rows if r.page_id in (2, 3)} == {""}
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_urls(pages):
    rows = {r.page_id: r for r in urlfilter.filter_urls(pages).collect()}
    assert set(rows) == {p[0] for p in PAGES} and rows[BIG].host == "b.example.net"
    assert (rows[1].host, rows[1].path, rows[1].verdict) == ("a.example.net", "/de/x", "allow") and (rows[2].host, rows[3].path) == ("", "")
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0 and urlfilter.filter_urls(pages, (), ()).count() == len(PAGES)


def test_language_id(spark, pages):
    learn = docs(spark, [(1, "der hund und die katze sind im haus " * 9, "de"), (2, "the dog and the cat are in the house " * 9, "en"), (3, None, "fr"), (4, "x", None)])
    rows = langid.identify(pages, learn).collect()
    assert len(rows) == len(PAGES) and {r.lang for r in rows if r.page_id == 1} == {"de"} and {r.page_id for r in rows} == {p[0] for p in PAGES}
    assert all(0 <= r.probability <= 1 for r in rows)
    assert langid.identify(pages.limit(0), learn).count() == 0
    assert {r.lang for r in langid.identify(pages, learn.limit(0)).collect()} == {None}


def test_stages(spark, given, tmp_path):
    folder = str(tmp_path)
    base = given[0].select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"{folder}/documents.parquet")
    given[1].select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PROSE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for given_docs in (base, base.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given_docs, folder)
            assert out.columns == base.columns, name
            assert out.count() <= len(ROWS)
        assert corpus_pipeline.STAGES[-1][1](spark, given_docs, folder).count() >= 0
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, base, folder).collect()}
    assert left == {1, 2, 3, 4, 6, 8, 9, 10, BIG}
    assert {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, base, folder).collect()} >= {2, 3, 4, 6, 8, 9, 10, BIG}
    assert not {1, 5, 7} & {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, base, folder).collect()}
    assert corpus_pipeline.run(spark, folder).count() >= 0


def test_one_of_each_group_is_chosen_by_its_text(spark):
    """One id with several texts, rows without ids, whole repeats: one row of each group stays, whatever the order of rows."""
    other = PROSE.upper() * 3
    rows = [(1, PROSE * 8, "en"), (1, other, "en"), (None, other, "en"), (None, "a text without an id " * 9, "en"), (None, "a text without an id " * 9, "de"), (2, PROSE * 9, "en"), (None, "", "en"), (None, "", "en"), (3, " ", None), (1, PROSE * 8, "aa")]
    for order in (rows, rows[::-1]):
        got = ngramjoin.one_of_each(docs(spark, order)).collect()
        assert sorted((str(r.doc_id), r.text[:6], str(r.lang)) for r in got) == sorted([("1", PROSE[:6], "aa"), ("1", other[:6], "en"), ("None", "a text", "de"), ("None", "", "en"), ("None", "", "en"), ("3", " ", "None")])
        assert got[0].node == "clash"


def test_markup_in_linear_time():
    for page in ("<a " * 300_000, "<!-- " * 200_000, "<style>" + "a" * 500_000, "<style>" + "/*" * 300_000, "<b c='" * 100_001, "<" * 300_000, "&" * 300_000, "<li>" * 20_000):
        began = time.time()
        htmltext.render(page)
        assert time.time() - began < 5


def test_visibility():
    def text(page):
        return htmltext.render(page)[0]

    assert text('<p aria-hidden="true">shown') == "shown" and text('<a href="x"">alpha</a>') == "alpha" and text("a < b </ x>c <b") == "a < b c"
    assert text('<div style="visibility:hidden">no <b style="visibility: visible">yes</b> no<hr><img alt=no></div>end') == "yes\nend"
    assert text("<style>@media print{.a{display:none}} .b{display:none} #c{display:block} p.d{visibility:hidden}</style><p class=a>1<p class=b>2<p class=b id=c>3<p class=d>4") == "1\n\n3"
    assert text("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>longer<td>D</table>") == "A      | B\n       | C\nlonger | D"
    assert text("<table><tr><td rowspan=9 colspan=2>A<td>B</tr><tr><td>C</tr></table>x") == "A   | B\n |  | C\n\nx"
    assert text("<input type=submit value=go><input type=hidden value=no><textarea>a &amp; b</textarea>") == "go a & b"


def test_a_long_run_of_blanks():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(file), packing.Encoder(file)
    for text in (" " * 1_200_000 + "a", "\n" * 1_200_000, "x\t" + " \t" * 600_000):
        assert e.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_more_than_64_languages(spark):
    learn = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i:03}") for i in range(90)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"https://h{i}.com/", f'<html lang="l{i:03}"><p>' + f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30) for i in range(90)], "page_id long, url string, html string")
    got = langid.identify(pages, learn).collect()
    assert all(r.lang == r.text_lang == r.declared == f"l{r.page_id:03}" for r in got)


def test_a_page_is_no_evidence_for_itself(spark):
    """The only page of a host, domain and suffix gets no more from its address than a page without one."""
    learn = spark.createDataFrame([(1, "der hund und die katze sind im haus " * 20, "de"), (2, "the dog and the cat are in the house " * 20, "en")], "doc_id long, text string, lang string")
    page = "<p>der hund the cat im house</p>"
    rows = [(1, "https://a.only/", page), (2, "https://b.other.single/", page)]
    alone = {r.page_id: r.probability for r in langid.identify(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), learn).collect()}
    both = {r.page_id: r.probability for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), learn).collect()}
    bare = langid.identify(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string"), learn).first().probability
    assert abs(alone[1] - bare) < 1e-9 and abs(both[1] - both[2]) < 1e-9


def test_hosts_of_many_labels(spark):
    rules = urlfilter.array_parts([("a.b.com/x", "block", False)])
    began = time.time()
    data = b"".join(rules)
    file = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"digests-{os.getpid()}.bin")
    with open(file, "wb") as f:
        f.write(data)
    array = urlfilter.DigestArray(file)
    os.remove(file)
    urls = ["https://" + "a." * 50_000 + "a.b.com/x/y", "https://" + "a." * 50_000 + "b.com/x", "https://a.b.com/x", "https://za.b.com/x", "https://.com/x"]
    assert [v[3] for v in urlfilter.judge(array, urls)] == ["block", "block", "block", "allow", "allow"] and time.time() - began < 5
    listed = spark.createDataFrame([(f"h{i}.org/",) for i in range(5000)] + [(None,), ("noslash",), ("/x",)], "rule string")
    pages = spark.createDataFrame([(1, "http://x.h77.org/"), (2, "http://h5001.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, block_list=listed).collect()} == {1: "block", 2: "allow"}


def test_models_travel_without_the_package():
    assert b"claimloom" not in pickle.dumps(bytecnn.Net().arrays())


def test_chunks_of_very_long_texts():
    """Chunks and their lengths are the same as without spans, and all weights are positive."""
    net = bytecnn.Net()
    pairs = net.pairs()
    for size in (bytecnn.SPAN - 1, bytecnn.SPAN, bytecnn.SPAN + 10, 2 * bytecnn.SPAN + bytecnn.HALF + 7, 5 * bytecnn.SPAN + 1):
        text = np.random.default_rng(size).integers(32, 120, size, dtype=np.uint8).tobytes()
        pooled, sizes = bytecnn.pooled_chunks(text, pairs)
        whole = bytecnn.windows(np.frombuffer(text, np.uint8), pairs)
        starts = range(0, max(1, len(whole) - bytecnn.HALF), bytecnn.HALF)
        assert len(starts) == len(pooled) and all(np.array_equal(pooled[i], whole[a : a + bytecnn.CHUNK].max(0)) and sizes[i] == len(whole[a : a + bytecnn.CHUNK]) for i, a in enumerate(starts))


def test_frequent_words_of_tied_counts_and_long_words(spark):
    text = " ".join(f"w{i}" for i in range(380)) + " " + "long" * 20
    head = brown.frequent(brown.word_counts(spark.createDataFrame([(text,)], "text string")), 50)
    assert 40 <= len(head) <= 50
    rows = [(i, f"{'long' * 20} of w{i % 7} end") for i in range(300)]
    got = brown.score_lm(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_known == r.n_tokens == 5 and r.score > r.base_score for r in got)


def test_samples_are_bounded_in_bytes(spark):
    from claimloom.llm.common import labelled_sample

    df = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows, counts = labelled_sample(df, labels, "quality", (3, 1), 100, most_bytes=55)
    assert sum(counts) > 20 and [sum(y == k for _, y in rows) for k in (0, 1)] == [5, 5] and all(len(t) == 10 for t, _ in rows)


def test_a_bucket_with_an_empty_block():
    """Links within one block are counted once, whether the task compares it with itself or with another."""
    sets = [np.arange(100, dtype=np.uint64), np.arange(1, 101, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64)]
    bands, copies = np.arange(9).reshape(3, 3), np.ones(3, int)
    within, _ = ngramjoin.compare(sets, bands, copies, None, 0, 0.8)
    across, links = ngramjoin.compare(sets, bands, copies, np.zeros(3, int), 0, 0.8)
    assert within.tolist() == [2, 2, 2] and across.tolist() == [0, 0, 0] and not links
