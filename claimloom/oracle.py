"""SQL for DuckDB that the queries are held against, over the same tables."""

from claimloom.model import DOMAIN_RELATIONS, DIRECTIONAL_RELATIONS

_LINES = """
  SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s, 'startup:' || l_partkey AS p,
         CASE l_suppkey % 3 WHEN 0 THEN 'investor:' WHEN 1 THEN 'company:' ELSE 'person:' END || l_suppkey AS b FROM lineitem
"""

GRAPH = f"""
WITH lines AS MATERIALIZED ({_LINES}),
nodes AS MATERIALIZED (
  SELECT 'startup:' || p_partkey AS id, 'Startup' AS label, p_name AS name, [p_brand || ' ' || p_name] AS aliases, p_type AS description, NULL AS title, NULL::TIMESTAMP AS published_at, NULL AS source_name FROM part
  UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN 'investor:' WHEN 1 THEN 'company:' ELSE 'person:' END || s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Investor' WHEN 1 THEN 'Company' ELSE 'Person' END, s_name, [], NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'person:c' || c_custkey, 'Person', c_name, [], c_mktsegment, NULL, NULL, NULL FROM customer
  UNION ALL SELECT DISTINCT 'topic:' || p_brand, 'Topic', p_brand, [], NULL, NULL, NULL::TIMESTAMP, NULL FROM part
  UNION ALL SELECT 'article:' || o_orderkey, 'Article', NULL, [], NULL, 'Order ' || o_orderkey, o_orderdate, o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT 'source:' || o_orderpriority, 'Source', o_orderpriority, [], NULL, NULL, NULL::TIMESTAMP, NULL FROM orders),
pairs AS MATERIALIZED (SELECT a.o, a.f, a.s, a.p AS x, c.p AS y, c.n - a.n AS k FROM lines a JOIN lines c ON a.o = c.o AND c.n - a.n IN (1, 2, 3) WHERE a.p <> c.p),
claims AS MATERIALIZED (
  SELECT b AS src_id, 'INVESTED_IN' AS rel_type, p AS dst_id, o, f, s FROM lines
  UNION ALL SELECT p, 'FOUNDED_BY', 'person:c' || o_custkey, o, f, s FROM lines JOIN orders ON o = o_orderkey WHERE n = 1
  UNION ALL SELECT 'person:c' || o_custkey, 'EMPLOYED_BY', b, o, f, s FROM lines JOIN orders ON o = o_orderkey WHERE n = 6
  UNION ALL SELECT x, 'ACQUIRED', y, o, f, s FROM pairs WHERE k = 1
  UNION ALL SELECT least(x, y), 'MERGED_WITH', greatest(x, y), o, f, s FROM pairs WHERE k = 2
  UNION ALL SELECT x, 'PARTNERED_WITH', y, o, f, s FROM pairs WHERE k = 3),
bare AS MATERIALIZED (
  SELECT src_id, rel_type, dst_id, 'stated' AS evidence_status, CASE max(s) WHEN 'O' THEN 'supported' ELSE 'unsupported_by_latest_source_processing' END AS lifecycle_status,
         CASE max(f) WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'unreviewed' WHEN 'R' THEN 'rejected' END AS review_status, count(DISTINCT o) AS support FROM claims GROUP BY 1, 2, 3
  UNION ALL SELECT 'startup:' || p_partkey, 'HAS_TOPIC', 'topic:' || p_brand, 'stated', 'supported', 'unreviewed', 1 FROM part
  UNION ALL SELECT DISTINCT 'article:' || l_orderkey, 'HAS_TOPIC', 'topic:' || p_brand, 'stated', 'supported', 'unreviewed', 1 FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'article:' || o, 'MENTIONS', p, CASE WHEN min(n) = 6 THEN 'unsure' WHEN max(s) = 'O' THEN 'stated' ELSE 'attributed' END, NULL, NULL, 1 FROM lines GROUP BY o, p
  UNION ALL SELECT 'article:' || o_orderkey, 'FROM_SOURCE', 'source:' || o_orderpriority, 'stated', 'supported', 'unreviewed', 1 FROM orders),
edges AS MATERIALIZED (
  SELECT *, upper(src_id[1]) || split_part(src_id, ':', 1)[2:] AS src_label, upper(dst_id[1]) || split_part(dst_id, ':', 1)[2:] AS dst_label FROM bare),
counted AS MATERIALIZED (SELECT * FROM edges WHERE coalesce(lifecycle_status, 'supported') = 'supported' AND coalesce(review_status, 'unreviewed') IN ('unreviewed', 'accepted')),
living AS MATERIALIZED (SELECT * FROM edges WHERE coalesce(lifecycle_status, 'supported') = 'supported' AND coalesce(review_status, 'unreviewed') <> 'rejected'),
ways AS MATERIALIZED (SELECT src_id AS a, dst_id AS b, rel_type FROM edges UNION ALL SELECT dst_id, src_id, rel_type FROM edges)
"""

DOMAIN = ", ".join(f"'{r}'" for r in DOMAIN_RELATIONS)
DIRECTED = ", ".join(f"'{r}'" for r in DIRECTIONAL_RELATIONS)


def few(column: str, n: int) -> str:
    return f"array_to_string(list_slice(list_sort(list(DISTINCT {column})), 1, {n}), '|')"


SQL = {
    "q1_trending_startups": GRAPH + f"""
      SELECT n.id, n.name, count(DISTINCT e.src_id) AS mentions, {few('a.title', 5)} AS articles, strftime(max(a.published_at), '%Y-%m-%d %H:%M:%S') AS last_seen
      FROM edges e JOIN nodes a ON e.src_id = a.id JOIN nodes n ON e.dst_id = n.id
      WHERE rel_type = 'MENTIONS' AND evidence_status IN ('stated', 'attributed') AND a.published_at >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)
      GROUP BY n.id, n.name ORDER BY mentions DESC, max(a.published_at) DESC, n.name, n.id LIMIT 10""",
    "q2_top_investors": GRAPH + f"""
      SELECT i.id, i.name, i.label AS type, count(DISTINCT e.dst_id) AS investments, {few('s.name', 5)} AS examples
      FROM counted e JOIN nodes i ON e.src_id = i.id JOIN nodes s ON e.dst_id = s.id
      WHERE rel_type = 'INVESTED_IN' GROUP BY ALL ORDER BY investments DESC, i.name, i.id LIMIT 10""",
    "q3_co_investments": GRAPH + f"""
      SELECT a.id AS source_id, a.name AS source, a.label AS source_type, b.id AS target_id, b.name AS target, b.label AS target_type,
             count(DISTINCT s.id) AS shared_startups, count(DISTINCT s.id) AS rounds, {few('s.name', 5)} AS examples
      FROM counted x JOIN counted y ON x.dst_id = y.dst_id AND x.src_id < y.src_id JOIN nodes a ON x.src_id = a.id JOIN nodes b ON y.src_id = b.id JOIN nodes s ON x.dst_id = s.id
      WHERE x.rel_type = 'INVESTED_IN' AND y.rel_type = 'INVESTED_IN' GROUP BY ALL ORDER BY shared_startups DESC, source, target, source_id, target_id LIMIT 20""",
    "q4_topic_clusters": GRAPH + f"""
      SELECT t.id, t.name, count(DISTINCT e.src_id) AS entity_count, {few('coalesce(x.name, x.title)', 6)} AS examples
      FROM counted e JOIN nodes t ON e.dst_id = t.id JOIN nodes x ON e.src_id = x.id WHERE rel_type = 'HAS_TOPIC'
      GROUP BY t.id, t.name ORDER BY entity_count DESC, t.name, t.id LIMIT 20""",
    "q5_entity_profile": GRAPH + """
      , hit AS (SELECT *, CASE WHEN lower(name) = 'small ring' THEN 4 WHEN list_contains(list_transform(aliases, lambda a: lower(a)), 'small ring') THEN 2 ELSE 1 END AS r FROM nodes
                WHERE label = 'Startup' AND (lower(name) LIKE '%small ring%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%small ring%')) > 0) ORDER BY r DESC, id LIMIT 1),
      near AS (SELECT DISTINCT h.id AS center, w.b, w.rel_type FROM hit h JOIN ways w ON w.a = h.id),
      rel AS (SELECT center, n.id AS related_id, coalesce(n.name, n.title) AS related_name, n.label AS related_type, rel_type AS relationship FROM near JOIN nodes n ON near.b = n.id ORDER BY relationship, related_name, related_id LIMIT 50)
      SELECT h.id, h.name, h.label AS type, h.description, related_id, related_name, related_type, relationship FROM hit h LEFT JOIN rel ON h.id = center""",
    "q7_node_claims": GRAPH + f"""
      SELECT CASE WHEN rel_type IN ({DOMAIN}) AND src_label <> 'Article' AND dst_label <> 'Article' THEN 'claim' ELSE 'mention' END AS kind, rel_type AS relationship,
             CASE WHEN rel_type = 'MERGED_WITH' THEN 'undirected' WHEN src_id = 'startup:1' THEN 'outgoing' ELSE 'incoming' END AS direction,
             CASE WHEN src_id = 'startup:1' THEN dst_id ELSE src_id END AS counterparty_id, coalesce(lifecycle_status, 'supported') AS lifecycle_status, coalesce(review_status, 'unreviewed') AS review_status,
             CASE WHEN rel_type IN ('MENTIONS', 'HAS_TOPIC') THEN 0 ELSE support END AS active_support_count, src_id AS source_id, dst_id AS target_id, coalesce(n.name, n.title) AS counterparty, n.label AS counterparty_type
      FROM edges LEFT JOIN nodes n ON n.id = CASE WHEN src_id = 'startup:1' THEN dst_id ELSE src_id END
      WHERE (src_id = 'startup:1' OR dst_id = 'startup:1') AND rel_type <> 'FROM_SOURCE'""",
    "q8_search": GRAPH + """
      , words AS (SELECT id, name, label, aliases, description, regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+') AS f1, regexp_split_to_array(lower(array_to_string(aliases, ' ')), '[^a-z0-9]+') AS f3, regexp_split_to_array(lower(coalesce(description, '')), '[^a-z0-9]+') AS f4 FROM nodes WHERE label NOT IN ('Article', 'Source')),
      hits AS (SELECT id, name, label, aliases, description, [2 * (len(list_filter(f1, lambda w: starts_with(w, t))) > 0)::INT + (len(list_filter(f3, lambda w: starts_with(w, t))) > 0)::INT + (len(list_filter(f4, lambda w: starts_with(w, t))) > 0)::INT for t in ['ring', 'sm']] AS s FROM words)
      SELECT id, name, label AS type, list_sum(s)::DOUBLE AS score, array_to_string(aliases, '|') AS aliases, description FROM hits WHERE list_min(s) > 0 ORDER BY score DESC, name, id LIMIT 15""",
    "q9_entity_graph_nodes": GRAPH + """
      , c AS (SELECT 'startup:1' AS id), one AS (SELECT DISTINCT b AS id FROM ways WHERE a = 'startup:1'), two AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM one)),
      near AS (SELECT id, min(h) AS hops FROM (SELECT id, 0 AS h FROM c UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY id),
      ranked AS (SELECT n.id, n.label, coalesce(n.name, n.title) AS name, hops, row_number() OVER (PARTITION BY hops = 0 ORDER BY hops, lower(coalesce(n.name, n.title, n.id)), n.id) AS r FROM near JOIN nodes n ON n.id = near.id)
      SELECT id, label, name FROM ranked WHERE hops = 0 OR r <= 120""",
    "q10_landscape_nodes": GRAPH + f"""
      , ends AS (SELECT DISTINCT src_id AS id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND src_label = 'Startup' UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND dst_label = 'Startup'
                 UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type = 'MENTIONS'),
      top AS (SELECT n.id FROM nodes n LEFT JOIN ends e ON n.id = e.id WHERE label = 'Startup' GROUP BY n.id, n.name ORDER BY count(e.id) DESC, n.name, n.id LIMIT 10),
      m AS (SELECT src_id, dst_id FROM edges WHERE rel_type = 'MENTIONS' AND dst_id IN (SELECT id FROM top)),
      ids AS (SELECT id FROM top UNION SELECT dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND src_id IN (SELECT id FROM top) UNION SELECT src_id FROM edges WHERE rel_type IN ({DOMAIN}) AND dst_id IN (SELECT id FROM top)
              UNION SELECT src_id FROM m UNION SELECT dst_id FROM edges WHERE rel_type IN ('FROM_SOURCE', 'HAS_TOPIC') AND src_id IN (SELECT src_id FROM m))
      SELECT id, label, coalesce(name, title) AS name FROM nodes WHERE id IN (SELECT id FROM ids)""",
    "q10_landscape_edges": GRAPH + f"""
      , ends AS (SELECT DISTINCT src_id AS id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND src_label = 'Startup' UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND dst_label = 'Startup'
                 UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type = 'MENTIONS'),
      top AS (SELECT n.id FROM nodes n LEFT JOIN ends e ON n.id = e.id WHERE label = 'Startup' GROUP BY n.id, n.name ORDER BY count(e.id) DESC, n.name, n.id LIMIT 10),
      m AS (SELECT * FROM edges WHERE rel_type = 'MENTIONS' AND dst_id IN (SELECT id FROM top)),
      found AS (SELECT * FROM m UNION SELECT * FROM edges WHERE rel_type IN ({DOMAIN}) AND (src_id IN (SELECT id FROM top) OR dst_id IN (SELECT id FROM top)) UNION SELECT * FROM edges WHERE rel_type IN ('FROM_SOURCE', 'HAS_TOPIC') AND src_id IN (SELECT src_id FROM m))
      SELECT src_id, rel_type, dst_id FROM found WHERE coalesce(review_status, 'unreviewed') <> 'rejected'""",
    "q9_entity_graph_edges": GRAPH + """
      , one AS MATERIALIZED (SELECT DISTINCT b AS id FROM ways WHERE a = 'startup:1'), two AS MATERIALIZED (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM one)),
      near AS MATERIALIZED (SELECT id, min(h) AS hops FROM (SELECT 'startup:1' AS id, 0 AS h UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY id),
      ranked AS (SELECT n.id, hops, row_number() OVER (PARTITION BY hops = 0 ORDER BY hops, lower(coalesce(n.name, n.title, n.id)), n.id) AS r FROM near JOIN nodes n ON n.id = near.id),
      kept AS MATERIALIZED (SELECT id FROM ranked WHERE hops = 0 OR r <= 60)
      SELECT src_id, rel_type, dst_id FROM edges WHERE src_id IN (SELECT id FROM kept) AND dst_id IN (SELECT id FROM kept) AND coalesce(review_status, 'unreviewed') <> 'rejected'""",
    "q9_best_match": GRAPH + """
      , d AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id)
      SELECT n.id, name FROM nodes n LEFT JOIN d ON n.id = d.id WHERE label NOT IN ('Article', 'Source') AND (lower(name) LIKE '%small ring%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%small ring%')) > 0)
      ORDER BY CASE WHEN lower(name) = 'small ring' THEN 4 WHEN list_contains(list_transform(aliases, lambda a: lower(a)), 'small ring') THEN 2 ELSE 1 END DESC, coalesce(d.n, 0) DESC, lower(name), n.id LIMIT 1""",
    "q6_investor_profile": GRAPH + """
      , hit AS (SELECT * FROM nodes WHERE label = 'Investor' AND lower(name) LIKE '%supplier#000000003%' ORDER BY lower(name) = 'supplier#000000003' DESC, id LIMIT 1),
      near AS (SELECT DISTINCT h.id AS center, w.b, w.rel_type FROM hit h JOIN ways w ON w.a = h.id),
      rel AS (SELECT center, n.id AS related_id, coalesce(n.name, n.title) AS related_name, n.label AS related_type, rel_type AS relationship FROM near JOIN nodes n ON near.b = n.id ORDER BY relationship, related_name, related_id LIMIT 50)
      SELECT h.id, h.name, h.label AS type, h.description, related_id, related_name, related_type, relationship FROM hit h LEFT JOIN rel ON h.id = center""",
    "q17_focus_node": GRAPH + """
      SELECT id, label, coalesce(name, title) AS name, CASE WHEN lower(coalesce(title, '')) = 'order 7' OR lower(coalesce(name, '')) = 'order 7' THEN 1 ELSE 2 END AS rank FROM nodes
      WHERE lower(id || ' ' || coalesce(name, '') || ' ' || coalesce(title, '')) LIKE '%order 7%' ORDER BY rank, id LIMIT 1""",
    "q18_claim_filter": GRAPH + f"""
      , c AS (SELECT rel_type AS relationship, CASE WHEN rel_type = 'MERGED_WITH' THEN 'undirected' WHEN src_id = 'startup:1' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN src_id = 'startup:1' THEN dst_id ELSE src_id END AS counterparty_id,
              coalesce(lifecycle_status, 'supported') AS lifecycle_status, coalesce(review_status, 'unreviewed') AS review_status, CASE WHEN rel_type = 'HAS_TOPIC' THEN 0 ELSE support END AS active_support_count, src_id AS source_id, dst_id AS target_id
              FROM edges WHERE (src_id = 'startup:1' OR dst_id = 'startup:1') AND rel_type IN ({DOMAIN}) AND src_label <> 'Article' AND dst_label <> 'Article')
      SELECT 'claim' AS kind, c.*, coalesce(n.name, n.title) AS counterparty, n.label AS counterparty_type, CASE review_status WHEN 'accepted' THEN 'Accepted' ELSE 'Supported' END AS status_label,
             CASE WHEN review_status = 'unreviewed' THEN 2 ELSE 3 END AS rank, concat_ws(':', relationship, direction, coalesce(n.name, n.title, counterparty_id)) AS label
      FROM c LEFT JOIN nodes n ON n.id = counterparty_id WHERE review_status NOT IN ('needs_review', 'rejected')""",
    "f10_gleaning": "SELECT 0::BIGINT AS entity_added, count(*) FILTER (p_size % 2 = 0 AND p_type <> upper(p_type)) AS entity_corrected, 0::BIGINT AS relation_added, 0::BIGINT AS relation_corrected FROM part",
    "q11_feed_edges": GRAPH + """
      SELECT src_id, rel_type, dst_id FROM edges JOIN nodes a ON a.id = src_id WHERE src_label = 'Article' AND rel_type IN ('HAS_TOPIC', 'FROM_SOURCE', 'MENTIONS') ORDER BY a.published_at DESC NULLS FIRST, src_id, rel_type, dst_id LIMIT 120""",
    "q13_entity_listing": GRAPH + "SELECT id, label, name, name AS canonical_name, array_to_string(aliases, '|') AS aliases, description FROM nodes WHERE label = 'Startup' ORDER BY id LIMIT 50000",
    "q14_bfs": GRAPH + """
      , n0 AS (SELECT 'investor:3' AS id), n1 AS (SELECT DISTINCT b AS id FROM ways WHERE a = 'investor:3'), n2 AS (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM n1))
      SELECT id, min(h) AS hops FROM (SELECT id, 0 AS h FROM n0 UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2) GROUP BY id""",
    "q15_visible_nodes": GRAPH + """
      , d AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id)
      SELECT n.id, label, coalesce(d.n, 0) AS degree, 2 * coalesce(d.n, 0) + CASE label WHEN 'Startup' THEN 62 WHEN 'Investor' THEN 58 WHEN 'Company' THEN 54 WHEN 'Topic' THEN 45 WHEN 'Person' THEN 38 WHEN 'Article' THEN 24 WHEN 'Source' THEN 20 ELSE 18 END AS score
      FROM nodes n LEFT JOIN d ON n.id = d.id ORDER BY score DESC, coalesce(name, title, n.id), n.id LIMIT 100""",
    "q16_neighbourhood": GRAPH + "SELECT DISTINCT unnest([a, b]) AS id FROM ways WHERE a = 'startup:1'",
    "q18_claim_counts": GRAPH + f"""
      SELECT count(*) FILTER (r = 'needs_review') AS review, count(*) FILTER (r NOT IN ('needs_review', 'rejected')) AS supported, count(*) FILTER (r IN ('accepted', 'rejected')) AS reviewed, count(*) FILTER (r = 'accepted') AS accepted, count(*) FILTER (r = 'rejected') AS rejected
      FROM (SELECT coalesce(review_status, 'unreviewed') AS r FROM edges WHERE (src_id = 'startup:1' OR dst_id = 'startup:1') AND rel_type IN ({DOMAIN}) AND src_label <> 'Article' AND dst_label <> 'Article')""",
    "g10_inverse_conflicts": GRAPH + f"""
      SELECT rel_type, least(src_id, dst_id) AS low_id, greatest(src_id, dst_id) AS high_id FROM living WHERE rel_type IN ({DIRECTED}) AND src_id <> dst_id
      GROUP BY ALL HAVING count(DISTINCT src_id) = 2""",
    "g11_transaction_conflicts": GRAPH + """
      SELECT x.src_id, x.dst_id, y.src_id AS merged_src, y.dst_id AS merged_dst FROM living x JOIN living y ON least(x.src_id, x.dst_id) = least(y.src_id, y.dst_id) AND greatest(x.src_id, x.dst_id) = greatest(y.src_id, y.dst_id) WHERE x.rel_type = 'ACQUIRED' AND y.rel_type = 'MERGED_WITH'""",
    "g12_flagged_claims": GRAPH + f"""
      , inv AS (SELECT x.src_id, x.rel_type, x.dst_id FROM living x JOIN living y ON x.src_id = y.dst_id AND x.dst_id = y.src_id AND x.rel_type = y.rel_type WHERE x.rel_type IN ({DIRECTED}) AND x.src_id <> x.dst_id),
      tr AS (SELECT x.src_id AS a, x.dst_id AS b, y.src_id AS c, y.dst_id AS d FROM living x JOIN living y ON least(x.src_id, x.dst_id) = least(y.src_id, y.dst_id) AND greatest(x.src_id, x.dst_id) = greatest(y.src_id, y.dst_id) WHERE x.rel_type = 'ACQUIRED' AND y.rel_type = 'MERGED_WITH'),
      hit AS (SELECT *, 'inverse_direction' AS reason FROM inv UNION SELECT a, 'ACQUIRED', b, 'competing_transaction_type' FROM tr UNION SELECT c, 'MERGED_WITH', d, 'competing_transaction_type' FROM tr)
      SELECT src_id, rel_type, dst_id, 'needs_review' AS review_status, array_to_string(list_reverse_sort(list(DISTINCT reason)), '|') AS review_reasons FROM hit GROUP BY 1, 2, 3""",
    "p3_evidence_gate": GRAPH + "SELECT rel_type, count(*) AS n_before, count(*) FILTER (evidence_status IN ('stated', 'attributed')) AS n_after, count(*) FILTER (evidence_status NOT IN ('stated', 'attributed')) AS n_dropped FROM edges GROUP BY rel_type",
    "p4_claim_direction": GRAPH + f"""
      SELECT rel_type, src_label, dst_label, count(*) AS n, CASE rel_type WHEN 'INVESTED_IN' THEN src_label IN ('Investor', 'Company', 'Person') AND dst_label = 'Startup' WHEN 'FOUNDED_BY' THEN src_label = 'Startup' AND dst_label = 'Person'
        WHEN 'EMPLOYED_BY' THEN src_label = 'Person' AND dst_label IN ('Startup', 'Company') WHEN 'ACQUIRED' THEN src_label IN ('Startup', 'Company') AND dst_label IN ('Startup', 'Company') WHEN 'HAS_TOPIC' THEN src_label <> 'Topic' AND src_label <> 'Article' AND dst_label = 'Topic' ELSE true END AS valid
      FROM edges WHERE rel_type IN ({DOMAIN}) GROUP BY ALL""",
    "p12_lens": GRAPH + "SELECT src_id, rel_type, dst_id FROM edges WHERE rel_type IN ('INVESTED_IN', 'ACQUIRED') AND src_label IN ('Startup', 'Investor') AND dst_label IN ('Startup', 'Investor')",
    "a5_startup_degree": GRAPH + f"""
      , ends AS (SELECT src_id AS id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND src_label = 'Startup' UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type IN ({DOMAIN}) AND dst_label = 'Startup' UNION SELECT dst_id, src_id, rel_type, dst_id FROM edges WHERE rel_type = 'MENTIONS')
      SELECT n.id, n.name, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id WHERE label = 'Startup' GROUP BY n.id, n.name""",
    "a7_degree": GRAPH + "SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id",
    "a8_node_types": GRAPH + "SELECT label AS type, count(*) AS n FROM nodes GROUP BY label",
    "a8_relation_types": GRAPH + "SELECT rel_type AS relation, count(*) AS n FROM edges GROUP BY rel_type",
    "a9_summary": GRAPH + "SELECT (SELECT count(*) FROM nodes WHERE label = 'Startup') AS startups, count(DISTINCT id) AS investors FROM (SELECT id FROM nodes WHERE label = 'Investor' UNION ALL SELECT src_id FROM edges WHERE rel_type = 'INVESTED_IN' AND src_label IN ('Company', 'Person'))",
    "a10_relationship_mix": GRAPH + "SELECT rel_type AS relationship, count(*) AS n FROM edges WHERE (src_id = 'startup:1' OR dst_id = 'startup:1') AND rel_type <> 'FROM_SOURCE' GROUP BY 1",
    "a11_related_entities": GRAPH + f"""
      SELECT CASE WHEN src_id = 'startup:1' THEN dst_id ELSE src_id END AS counterparty_id, count(*) AS weight, {few('rel_type', 2)} AS relations
      FROM edges WHERE (src_id = 'startup:1' OR dst_id = 'startup:1') AND rel_type <> 'FROM_SOURCE' GROUP BY 1 ORDER BY weight DESC, counterparty_id LIMIT 12""",
    "a19_density": GRAPH + "SELECT a AS n_nodes, b AS n_edges, CASE WHEN a > 1 THEN b / a ELSE 0.0 END AS density FROM (SELECT (SELECT count(*) FROM nodes) AS a, (SELECT count(*) FROM edges) AS b)",
    "o8_flow_layout": GRAPH + """
      , d AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id),
      s AS (SELECT n.id, label, coalesce(name, title, n.id) AS shown, 2 * coalesce(d.n, 0) + CASE label WHEN 'Startup' THEN 62 WHEN 'Investor' THEN 58 WHEN 'Company' THEN 54 WHEN 'Topic' THEN 45 WHEN 'Person' THEN 38 WHEN 'Article' THEN 24 ELSE 20 END AS score FROM nodes n LEFT JOIN d ON n.id = d.id),
      r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, shown, id) AS position, count(*) OVER (PARTITION BY label) AS c FROM s)
      SELECT id, label, score, position, round(40.0 + 600.0 * position / (c + 1), 6) AS y FROM r""",
    "o9_highest_degree": GRAPH + "SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 1",
    "p1_p2_article_links": """
      WITH u AS (SELECT page_id, url, replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)
      SELECT page_id, h AS host, h = 'ththen.example.com' AS same_host, h = h AND NOT regexp_matches(url, '#|/author/|/category/|/feed|/jobs|/page/|/ressort/|/tag/|/wp-content/') AND trim(p, '/') <> '' AND regexp_matches(p, '[0-9]') AS is_article FROM u""",
    "p15_valid_articles": "SELECT doc_id, length(trim(coalesce(text, ''), ' ')) >= 20 AS accepted, length(trim(coalesce(text, ''), ' ')) >= 120 AS scraped FROM documents",
    "s1_collected_links": "SELECT link, pos FROM (SELECT url AS link, page_id AS pos, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY page_id, url) AS r FROM pages) WHERE r = 1 ORDER BY pos, link LIMIT 150",
    "s5_page_links": """
      WITH a AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+') AS site, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1) AS targets FROM pages)
      SELECT page_id, unnest(range(len(targets)))::INT AS pos, site || unnest(targets) AS link FROM a""",
    "s6_article_titles": "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM pages",
    "f1_f4_names": """
      SELECT p_partkey, trim(p_name) AS display, lower(p_name) AS key, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1 AND t NOT IN ('a', 'and', 'at', 'by', 'for', 'in', 'of', 'the', 'to')))), ' ') AS tokens,
             trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha1(p_name) AS digest FROM part""",
    "f8_parsed_entities": """
      SELECT p_partkey AS article_id, p_name AS name, 'Startup' AS entity_type, CASE p_size % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'attributed' ELSE 'unsure' END AS evidence_status, p_size % 3 = 2 AS evidence_status_defaulted, p_type AS description FROM part
      UNION ALL SELECT p_partkey, p_brand, 'Topic', 'stated', false, 'brand' FROM part""",
    "f13_typed_relations": "SELECT p_partkey AS article_id, 'HAS_TOPIC' AS rel_type, p_name AS source_name, 'Startup' AS source_type, p_brand AS target_name, 'Topic' AS target_type, NULL AS keywords, 'unsure' AS evidence_status, true AS evidence_status_defaulted, 'made by' AS evidence FROM part",
    "r7_exact_resolution": """
      WITH reg AS (SELECT lower(p_name) AS key, max('startup:' || p_partkey) AS entity_id FROM part GROUP BY 1)
      SELECT o_orderkey AS cand_id, entity_id, key FROM orders JOIN part ON o_orderkey % 500 = p_partkey JOIN reg ON lower(p_name) = key""",
    "r8_similarity": """
      WITH n AS (SELECT DISTINCT lower(p_name) AS x FROM part)
      SELECT a.x AS a, b.x AS b, round(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 6) AS levenshtein, round(jaro_winkler_similarity(a.x, b.x), 6) AS jaro_winkler,
             round(len(list_intersect(string_split(a.x, ' '), string_split(b.x, ' '))) / len(list_distinct(list_concat(string_split(a.x, ' '), string_split(b.x, ' ')))), 6) AS jaccard
      FROM n a JOIN n b ON a.x < b.x AND substr(a.x, 1, 2) = substr(b.x, 1, 2)""",
    "r12_nearest_vectors": """
      WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
      s AS (SELECT q.vec_id AS cand_id, e.vec_id AS entity_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON true),
      r AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY c DESC, entity_id) AS k FROM s),
      f AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY k) AS place FROM r WHERE k <= 5 AND cand_id <> entity_id)
      SELECT cand_id, entity_id, round((1 + c) / 2, 6) AS score FROM f WHERE place = 1 AND (1 + c) / 2 >= 0.55""",
    "g4_claim_lifecycle": """
      WITH e AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS run, 'u' || l_orderkey % 7 AS url, l_suppkey % 10 AS s, l_partkey % 4000 AS p FROM lineitem),
      runs AS (SELECT DISTINCT url, run FROM e),
      state AS (SELECT s, p, url, max(run) AS last, max(CASE WHEN run = 2 THEN 1 ELSE 0 END) AS two FROM e GROUP BY s, p, url),
      lost AS (SELECT st.*, (two = 0 AND EXISTS (SELECT 1 FROM runs r WHERE r.url = st.url AND r.run = 2))::INT AS gone FROM state st)
      SELECT 'investor:' || s AS src_id, 'startup:' || p AS dst_id, count(*) AS n_urls, count(*) FILTER (gone = 0) AS n_active, CASE WHEN count(*) FILTER (gone = 0) = 0 THEN 'unsupported_by_latest_source_processing' ELSE 'supported' END AS lifecycle_status,
             CASE WHEN count(*) FILTER (gone = 0) = 0 THEN 'needs_review' ELSE 'unreviewed' END AS review_status, CASE WHEN count(*) FILTER (gone = 0) = 0 THEN 'not_reproduced_same_article' ELSE '' END AS review_reasons, max(gone) = 1 AS support_changed FROM lost GROUP BY s, p""",
    "m1_tally": "SELECT count(*) FILTER (o_orderstatus <> 'P') AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed, coalesce(sum(o_custkey % 9) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS entities, coalesce(sum(o_custkey % 13) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS relationships_created FROM orders",
    "m2_resolution_report": """
      WITH o AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'Investor' WHEN 1 THEN 'Company' ELSE 'Person' END AS t, CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'embedding' ELSE 'new' END AS m FROM lineitem)
      SELECT coalesce(t, 'all') AS entity_type, count(*) AS total, count(*) FILTER (m = 'exact') AS exact, count(*) FILTER (m = 'fuzzy') AS fuzzy, count(*) FILTER (m = 'embedding') AS embedding, count(*) FILTER (m = 'new') AS "new", round(1 - count(*) FILTER (m = 'new') / count(*), 3) AS dedup_rate FROM o GROUP BY ROLLUP(t)""",
    "m5_latency_percentiles": "SELECT l[(round_even(0.5 * (len(l) - 1), 0))::BIGINT + 1] AS p50, l[(round_even(0.95 * (len(l) - 1), 0))::BIGINT + 1] AS p95 FROM (SELECT list_sort(list(value)) AS l FROM events)",
    "a13_evidence_counts": GRAPH + """
      SELECT count(*) FILTER (rel_type = 'MENTIONS' AND evidence_status = 'stated') AS entities_stated, count(*) FILTER (rel_type = 'MENTIONS' AND evidence_status = 'attributed') AS entities_attributed, count(*) FILTER (rel_type = 'MENTIONS' AND evidence_status = 'unsure') AS entities_unsure, count(*) FILTER (rel_type = 'MENTIONS' AND evidence_status = 'unsure') AS entities_defaulted,
             count(*) FILTER (rel_type = 'ACQUIRED' AND evidence_status = 'stated') AS relations_stated, count(*) FILTER (rel_type = 'ACQUIRED' AND evidence_status = 'attributed') AS relations_attributed, count(*) FILTER (rel_type = 'ACQUIRED' AND evidence_status = 'unsure') AS relations_unsure, count(*) FILTER (rel_type = 'ACQUIRED' AND evidence_status = 'unsure') AS relations_defaulted FROM edges""",
    "stream_windowed_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "o2_null_order": "SELECT event_id, nullif(value::BIGINT % 5, 0) AS v FROM events ORDER BY v DESC NULLS FIRST, event_id LIMIT 50",
}
SQL["g5_claim_stream"] = SQL["g4_claim_lifecycle"]
SQL["q8_search_by_index"] = SQL["q8_search"]
SQL["q14_walk_of_three"] = GRAPH + """
      , n1 AS MATERIALIZED (SELECT DISTINCT b AS id FROM ways WHERE a = 'investor:3'), n2 AS MATERIALIZED (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM n1)), n3 AS MATERIALIZED (SELECT DISTINCT b AS id FROM ways WHERE a IN (SELECT id FROM n2))
      SELECT id, min(h) AS hops FROM (SELECT 'investor:3' AS id, 0 AS h UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2 UNION ALL SELECT id, 3 FROM n3) GROUP BY id"""
SQL["m1_observed_tally"] = SQL["m1_tally"]
SQL["r10_r13_resolution"] = """
      WITH reg AS (SELECT lower(p_name) AS key, max('startup:' || p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
      said AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END AS words FROM part),
      cands AS (SELECT p_partkey AS cand_id, CASE p_partkey % 4 WHEN 1 THEN words || ' GmbH' WHEN 3 THEN words ELSE upper(words) END AS name, lower(words) AS key, array_to_string(list_sort(list_distinct(string_split(lower(words), ' '))), ' ') AS tokens FROM said),
      met AS (SELECT cands.*, id FROM cands LEFT JOIN reg ON cands.key = reg.key),
      fresh AS (SELECT *, row_number() OVER w AS n, first_value(name) OVER w AS first FROM met WHERE id IS NULL WINDOW w AS (PARTITION BY tokens ORDER BY cand_id))
      SELECT cand_id, 'Startup' AS entity_type, name, key, id AS entity_id, 'exact' AS method, 1.0::DOUBLE AS similarity FROM met WHERE id IS NOT NULL
      UNION ALL SELECT cand_id, 'Startup', name, key, 'startup:' || trim(regexp_replace(lower(first), '[^a-z0-9]+', '-', 'g'), '-'), CASE WHEN n = 1 THEN 'new' ELSE 'exact' END, NULL FROM fresh"""
