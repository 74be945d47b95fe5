"""The operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import brown, bytecnn, decontaminate, fertility, hamerly, htmltext, infill, langid, ngramjoin, packing, suffixdedup, toxicity, urlfilter
from claimloom.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_lm(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.col("listed"))


def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.report(*hamerly.cluster(table(spark, sf_dir, "embeddings")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_tokeniser_fertility, op3_toxicity, op4_brown_lm, op5_decontamination, op6_best_fit_packing, op7_ngram_jaccard_join, op8_language_id, op9_url_filter, op10_byte_cnn_quality, op11_fill_in_middle, op12_centroid_clusters, op13_suffix_dedup)}


def _url_sql() -> str:
    rules = ", ".join(f"({i}, '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for i, (r, v) in enumerate(urlfilter.BASE_RULES))
    listed = ", ".join(f"('{r[:-1]}')" for r in urlfilter.BLOCK_LIST)
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    parts AS (
      SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    rules(n, rule_host, rule_path, decision) AS (VALUES {rules}),
    listed(list_host) AS (VALUES {listed}),
    urls AS (SELECT DISTINCT host, path FROM parts),
    named AS (
      SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(decision, length(rule_host || rule_path)) AS decision
      FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
    blocked AS (
      SELECT host, path, arg_max(list_host || '/', length(list_host)) AS listed
      FROM urls JOIN listed ON (host = list_host OR ends_with(host, '.' || list_host)) AND starts_with(path, '/') GROUP BY host, path)
    SELECT page_id, p.host, p.path, rule, coalesce(decision, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed
    FROM parts p LEFT JOIN named n ON p.host = n.host AND p.path = n.path LEFT JOIN blocked b ON p.host = b.host AND p.path = b.path
    """


def _infill_sql() -> str:
    return r"""
    WITH units AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    seeded AS (
      SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
    cuts AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM seeded),
    parts AS (
      SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM cuts)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM parts
    """


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignment and means, round by round, over one row for each component."""
    steps = [
        """kept AS MATERIALIZED (
      SELECT vec_id, embedding FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0)""",
        "x AS MATERIALIZED (SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) r(i))",
        f"seed AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS m FROM seed JOIN x USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
      SELECT vec_id, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{r} USING (i) GROUP BY vec_id, c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
      SELECT c, i, coalesce(s, m) AS m FROM c{r} LEFT JOIN (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM x JOIN d{r} USING (vec_id) GROUP BY c, i) USING (c, i))""")
    return f"""
    WITH {", ".join(steps)},
    digest AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
    FROM d{rounds} JOIN digest USING (c)
    """


def _repeats_sql() -> str:
    """Every window of 50 bytes as text of hexadecimal digits."""
    return """
    WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    cut AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, h FROM bytes WHERE n >= 50),
    named AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS w FROM cut),
    gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM named) WHERE least < doc_id),
    starts AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM gone),
    numbered AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM starts),
    spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
    pieces AS (
      SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi, b - a AS gone, 1 AS spans FROM spans
      UNION ALL SELECT bytes.doc_id, coalesce(max(b), 0), n, 0, 0 FROM bytes LEFT JOIN spans ON bytes.doc_id = spans.doc_id GROUP BY bytes.doc_id, n)
    SELECT doc_id, n AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(spans) AS BIGINT) AS n_spans, sha256(unhex(string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo, hi))) AS kept_sha256
    FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id, n
    """


ORACLE_SQL = {"op9_url_filter": _url_sql(), "op11_fill_in_middle": _infill_sql(), "op12_centroid_clusters": _clusters_sql(), "op13_suffix_dedup": _repeats_sql()}
