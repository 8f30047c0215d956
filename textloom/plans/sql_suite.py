"""Operators that are plain relational plans, as SQL over the driver's tables.

One text serves Spark and the check: it keeps to what both dialects read alike. Each entry names the inventory ids that
it covers. Joins, filters and partial aggregates are left to Catalyst; every ranking has a total order.
"""

from __future__ import annotations

from textloom.plans.catalogue import query
from textloom.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EDGES = """edges AS (
  SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst, 'LOCATED_IN' AS type FROM customer
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'LOCATED_IN' FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'PART_OF' FROM nation
  UNION ALL SELECT DISTINCT concat('s', l_suppkey), concat('p', l_partkey), 'SUPPLIES' FROM lineitem)"""
NODES = """nodes AS (
  SELECT concat('c', c_custkey) AS id, c_name AS name, 'Customer' AS type FROM customer
  UNION ALL SELECT concat('s', s_suppkey), s_name, 'Supplier' FROM supplier
  UNION ALL SELECT concat('p', p_partkey), p_name, 'Part' FROM part
  UNION ALL SELECT concat('n', n_nationkey), n_name, 'Nation' FROM nation
  UNION ALL SELECT concat('r', r_regionkey), r_name, 'Region' FROM region)"""
BOTH = "both_ways AS (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"
CLAIMS = "claims AS (SELECT sha1(concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING))) AS claim_uid, l_orderkey * 10 + l_linenumber AS seq, l_discount * 10 AS p_true FROM lineitem)"
DOCID = "concat('episode ', CAST(doc_id AS STRING))"

SQL: dict[str, tuple[str, str]] = {
    # --- filters and projections
    "metadata_filter": ("FLT1 FLT12", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')"),
    "substring_filter": ("FLT2 TK3", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('OLD')) ORDER BY p_retailprice DESC, p_partkey LIMIT 20"),
    "type_filter": ("FLT3", "SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_retailprice DESC, p_partkey LIMIT 50"),
    "common_entities": ("FLT4", "SELECT a.l_partkey AS part FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1) a JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 2) b ON a.l_partkey = b.l_partkey"),
    "viz_filter": ("FLT5", f"WITH {EDGES}, top AS (SELECT p_partkey, concat('p', p_partkey) AS id FROM part WHERE p_retailprice >= 900 AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8) ORDER BY p_retailprice DESC, p_partkey LIMIT 100) SELECT src, dst FROM edges WHERE type = 'SUPPLIES' AND dst IN (SELECT id FROM top)"),
    "confidence_buckets": ("FLT8", "SELECT CASE WHEN l_discount >= 0.075 THEN 'high' WHEN l_discount >= 0.05 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY 1"),
    "type_violations": ("FLT9 FLT10", f"WITH {EDGES}, {NODES}, rules AS (SELECT 'LOCATED_IN' AS type, 'Customer' AS s, 'Nation' AS t UNION ALL SELECT 'PART_OF', 'Nation', 'Region' UNION ALL SELECT 'SUPPLIES', 'Supplier', 'Part') SELECT e.type, x.type AS source_type, y.type AS target_type, count(*) AS n, CAST(sum(CASE WHEN r.type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM edges e JOIN nodes x ON e.src = x.id JOIN nodes y ON e.dst = y.id LEFT JOIN rules r ON r.type = e.type AND r.s = x.type AND r.t = y.type GROUP BY 1, 2, 3"),
    "min_degree_subgraph": ("FLT11", f"WITH {EDGES}, {BOTH}, keepers AS (SELECT a FROM both_ways GROUP BY a HAVING count(*) >= 20) SELECT src, dst, type FROM edges WHERE src IN (SELECT a FROM keepers) AND dst IN (SELECT a FROM keepers)"),
    "previews": ("FLT13 RK19", "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS preview, coalesce(lang, 'unknown') AS lang FROM documents"),
    "conflicts": ("FLT18", "SELECT count(*) AS total, CAST(sum(CASE WHEN l_tax >= 0.06 AND l_discount < 0.03 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM lineitem"),
    "stale_labels": ("FLT19", "SELECT d.source, l.field, l.label, count(*) AS n FROM documents d JOIN (SELECT doc_id, 'quality' AS field, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3"),
    "first_pattern": ("FLT17", "SELECT p_partkey, rule FROM (SELECT p_partkey, r.rule, row_number() OVER (PARTITION BY p_partkey ORDER BY r.o) AS k FROM part JOIN (SELECT 1 AS o, 'small' AS rule, 5 AS lim UNION ALL SELECT 2, 'middle', 25 UNION ALL SELECT 3, 'large', 100) r ON p_size <= r.lim) x WHERE k = 1"),
    # --- joins
    "left_metadata": ("JN1 JN19 JN22", "SELECT d.doc_id, d.source, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "edge_endpoints": ("JN2", "SELECT n.n_nationkey AS source_id, r.r_regionkey AS target_id FROM nation n JOIN (SELECT lower(r_name) AS k, max(r_regionkey) AS r_regionkey, max(r_name) AS r_name FROM region GROUP BY 1) r ON n.n_regionkey = r.r_regionkey"),
    "evaluations": ("JN4 SC51", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "cache_split": ("JN5 ST6", "SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(count(*) - sum(hit) AS BIGINT) AS misses FROM (SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 1 ELSE 0 END AS BIGINT) AS hit FROM documents d) x"),
    "category_members": ("JN6", "SELECT DISTINCT vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id < 3)"),
    "cooccurrence": ("JN10", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2"),
    "typed_cooccurrence": ("JN11", "SELECT l_suppkey AS supplier, l_partkey AS part, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2"),
    "cooccurring_with": ("JN12", "SELECT b.l_partkey AS part, count(DISTINCT b.l_orderkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey = 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "anti_new": ("JN17 ST1 SET2", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "missing_pairs": ("JN18 SET4", "WITH a AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) AS only_new, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y) AS missing, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) z) AS shared"),
    "run_comparison": ("JN24 AG39", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 4) AS delta FROM orders GROUP BY 1"),
    "source_links": ("JN23 GR11", "SELECT o_custkey AS customer, l_partkey AS part, CASE WHEN sum(l_quantity) > 40 THEN 'FEATURES' ELSE 'MENTIONS' END AS type FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"),
    "parity_check": ("JN25 SET5", "SELECT count(*) AS differing FROM (SELECT doc_id FROM documents) a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL"),
    "progress": ("JN26 AG20", "SELECT d.source, count(*) AS expected, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "chapter_range": ("JN21 SC50", "SELECT p_partkey, p_size, c.chapter FROM part JOIN (SELECT 1 AS chapter, 0 AS lo, 10 AS hi UNION ALL SELECT 2, 11, 25 UNION ALL SELECT 3, 26, 1000) c ON p_size BETWEEN c.lo AND c.hi"),
    # --- aggregates
    "category_counts": ("AG4 AG12", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1"),
    "entity_merge": ("WN9", "SELECT lower(trim(p_type)) AS k, count(*) AS mention_count, count(DISTINCT p_brand) AS brands, max(length(p_name)) AS longest FROM part GROUP BY 1"),
    "edge_dedup": ("AG6 AG8", "SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS chunks FROM lineitem GROUP BY 1, 2"),
    "importance": ("AG9", f"WITH {EDGES}, d AS (SELECT dst AS id, count(*) AS connections FROM edges GROUP BY 1), m AS (SELECT concat('p', l_partkey) AS id, count(*) AS mentions, count(DISTINCT l_orderkey) AS episodes FROM lineitem GROUP BY 1) SELECT m.id, CAST(round(0.3 * mentions + 0.4 * episodes + 0.3 * coalesce(connections, 0), 2) AS DOUBLE) AS importance FROM m LEFT JOIN d ON m.id = d.id"),
    "importance_variants": ("AG10 AG11", "SELECT l_partkey, count(DISTINCT l_orderkey) * 10 + count(*) AS by_episodes, least(CAST(count(*) AS DOUBLE) / 10, 1) AS by_mentions FROM lineitem GROUP BY 1"),
    "relationship_patterns": ("AG13 AG29", f"WITH {EDGES}, {NODES} SELECT x.type AS source_type, e.type, y.type AS target_type, count(*) AS n FROM edges e JOIN nodes x ON e.src = x.id JOIN nodes y ON e.dst = y.id GROUP BY 1, 2, 3"),
    "bridging": ("AG14", f"WITH {EDGES}, {NODES}, {BOTH} SELECT a, count(DISTINCT b) AS neighbours, count(DISTINCT n.type) AS types, count(DISTINCT w.type) AS relations FROM both_ways w JOIN nodes n ON w.b = n.id GROUP BY a ORDER BY types DESC, neighbours DESC, a LIMIT 10"),
    "degree_zero_incl": ("AG15", f"WITH {EDGES}, {NODES}, {BOTH} SELECT n.id, count(w.b) AS degree FROM nodes n LEFT JOIN both_ways w ON n.id = w.a GROUP BY 1"),
    "edge_strength": ("AG16", "SELECT l_suppkey, l_partkey, least(CAST(count(*) AS DOUBLE) / 3, 1) AS strength FROM lineitem GROUP BY 1, 2"),
    "viz_statistics": ("AG17 AG36", f"WITH {EDGES}, {NODES} SELECT n.nodes, e.links, round(2.0 * e.links / n.nodes, 6) AS mean_degree, round(e.links / (CAST(n.nodes AS DOUBLE) * (n.nodes - 1)), 10) AS density FROM (SELECT count(*) AS nodes FROM nodes) n, (SELECT count(*) AS links FROM edges) e"),
    "claim_merge": ("AG18", f"WITH {CLAIMS} SELECT claim_uid, seq, p_true, sources FROM (SELECT *, row_number() OVER (PARTITION BY claim_uid ORDER BY p_true DESC, seq) AS k, count(*) OVER (PARTITION BY claim_uid) AS sources FROM claims) x WHERE k = 1"),
    "variant_groups": ("AG19 ER2", "SELECT lower(p_type) AS k, count(DISTINCT p_type) AS variants, count(*) AS n, min(p_type) AS canonical FROM part GROUP BY 1"),
    "repeat_confidence": ("AG21", "SELECT l_partkey, round(least(1.0, min(l_discount) + 0.1 * (count(*) - 1)), 6) AS confidence FROM lineitem GROUP BY 1"),
    "confidence_stats": ("AG23", "SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high, round(100.0 * sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM lineitem GROUP BY 1"),
    "rollup_relations": ("AG24", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "cube_events": ("extension", "SELECT event_type, user_id % 7 AS g, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 7)"),
    "feedback_summary": ("AG25 SRC16", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 0 THEN value END), 6) AS rating, round(100.0 * sum(CASE WHEN value > 1 THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM events GROUP BY 1"),
    "map_rollups": ("AG26", "SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"),
    "cost_rollup": ("AG27 AG28 AG40 UD3", "SELECT lang, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(n_chars) / 4.0 / 1000 * 0.0001, 6) AS embedding_cost, round(sum(n_chars) / 1000.0 * 0.15, 6) AS voice_cost FROM documents GROUP BY 1"),
    "ece": ("AG30", "WITH b AS (SELECT least(CAST(floor(n_chars % 1000 / 100.0) AS INT), 9) AS bin, (n_chars % 1000) / 1000.0 AS p, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM g"),
    "page_coverage": ("AG31", "SELECT count(*) AS pages, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 4) AS pct FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"),
    "duplicate_signatures": ("AG32", "SELECT CAST(sum(n - 1) AS BIGINT) AS extra, count(*) AS signatures FROM (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1) x"),
    "usage_counters": ("AG33 ST5", "SELECT count(*) AS total, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, round(100.0 * sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / count(*), 4) AS pct FROM events"),
    "content_groups": ("AG34", "SELECT source, count(*) AS chunks, max(n_chars) AS max_score FROM documents GROUP BY 1 ORDER BY 3 DESC, 1"),
    "correction_report": ("AG35 AG42", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "extraction_summary": ("AG38", "SELECT source, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) x"),
    "acceptance_checks": ("AG41", "SELECT round(100.0 * sum(CASE WHEN length(md5(text)) = 32 THEN 1 ELSE 0 END) / count(*), 4) AS hash_coverage, count(*) - count(DISTINCT doc_id) AS repeated_uids, round(avg(n_chars), 4) AS mean FROM documents"),
    "entities_by_chapter": ("AG43", "SELECT p_size AS chapter, p_type, count(*) AS n FROM part GROUP BY 1, 2"),
    # --- windows
    "per_group_top": ("WN1 WN11", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) x WHERE k <= 3"),
    "neighbours": ("WN5 WN6", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations"),
    "chunk_index": ("WN7", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS chunk_total FROM conversations"),
    "zscore": ("WN12", "SELECT s_suppkey, round((s_acctbal - m) / s * 500, 4) + 0.0 AS z FROM supplier CROSS JOIN (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier) t"),
    "recency_bonus": ("WN13 RK18", "SELECT conv_id, turn, CAST((count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1) * 2 AS BIGINT) AS bonus FROM conversations"),
    "window_frames": ("extension", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events"),
    # --- top-k
    "top_entities": ("TK1 TK2 TK4 TK5", "SELECT l_partkey, count(*) AS mentions, count(DISTINCT l_orderkey) AS episodes FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "scored_search": ("TK6 TK7 TK11", "SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'an') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), 'st') THEN 5 ELSE 0 END) * (1 + p_size / 50.0) AS score FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'st') ORDER BY 2 DESC, 1 LIMIT 20"),
    "match_ladder": ("TK8", "SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN lower(p_name) = t.term THEN 10 WHEN contains(lower(p_name), t.term) THEN 7 ELSE 3 END AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY t.o) AS k FROM part JOIN (SELECT 1 AS o, 'an' AS term UNION ALL SELECT 2, 'e') t ON contains(lower(p_name), t.term) OR contains(lower(p_type), t.term)) x WHERE k = 1 ORDER BY score DESC, p_partkey LIMIT 10"),
    "leaf_top": ("TK9 TK10", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) x WHERE k <= 20"),
    # --- sets
    "result_sets": ("SET3", "SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels"),
    "append_new": ("SET6", "SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "replace_prefix": ("SET7", "SELECT source AS id FROM documents WHERE substr(source, 1, 4) <> 'src1' UNION ALL SELECT concat('src1_', CAST(doc_id AS STRING)) FROM documents WHERE substr(source, 1, 4) = 'src1'"),
    # --- scalar functions
    "document_ids": ("SC12 SC21", "SELECT doc_id, substr(md5(text), 1, 12) AS hash_id, sha2_text AS sha FROM (SELECT doc_id, text, md5(text) AS sha2_text FROM documents) x"),
    "claim_uids": ("SC20 SC29", "SELECT l_orderkey, l_linenumber, sha1(concat(CAST(l_partkey AS STRING), '|', l_returnflag, '|', CAST(l_suppkey AS STRING), '|', substr(sha1(l_linestatus), 1, 8))) AS candidate_uid FROM lineitem"),
    "p_true": ("SC22 SC23", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-1.2 + 2.1 * l_discount * 10 + 0.9 * l_tax * 10 + 0.6 * 0.5 - 0.8 * CASE WHEN l_discount * 10 >= 0.8 AND l_tax * 10 < 0.5 THEN 1 ELSE 0 END))), 6) AS p_true FROM lineitem"),
    "haversine": ("SC24", "SELECT s_suppkey, round(2 * 6371 * asin(sqrt(power(sin(radians(s_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(s_nationkey)) * power(sin(radians(s_suppkey % 90) / 2), 2))), 3) AS km FROM supplier"),
    "pattern_prior": ("SC27", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, round(least(0.5, (n + 3.0) / (sum(n) OVER () + 3.0 * count(*) OVER ())), 6) AS prior FROM c"),
    "resolved_types": ("SC28", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'Place' WHEN contains(lower(p_type), 'brass') THEN 'Org' ELSE 'UNKNOWN' END AS kind FROM part"),
    "stt_cost": ("SC39", "SELECT event_id, round(CASE WHEN value > 0 THEN 0.006 * ceil(value / 60.0) WHEN event_id > 0 THEN event_id / 16000.0 ELSE 0.03 END, 6) AS cost FROM events"),
    "palette": ("SC42", "SELECT label, CASE label % 3 WHEN 0 THEN 'circle' WHEN 1 THEN 'square' ELSE 'star' END AS shape FROM embeddings"),
    "estimated_timestamp": ("SC43", "SELECT conv_id, turn, round(turn * 3000.0 / count(*) OVER (PARTITION BY conv_id), 4) AS at FROM conversations"),
    "uncertain_topn": ("ER5 SC49", "SELECT l_orderkey, l_linenumber, round(1 - abs(l_discount * 10 - 0.5), 6) AS uncertainty FROM lineitem ORDER BY round(1 - abs(l_discount * 10 - 0.5), 6) DESC, l_orderkey, l_linenumber LIMIT 50"),
    "day_key": ("SC52 ST8 SRC15", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1"),
    # --- graph
    "entity_details": ("GR1", f"WITH {EDGES}, {NODES}, {BOTH} SELECT n.id, n.name, count(w.b) AS degree FROM nodes n LEFT JOIN both_ways w ON n.id = w.a WHERE n.id = 'n3' GROUP BY 1, 2"),
    "related_1hop": ("GR2", f"WITH {EDGES}, {NODES} SELECT n.id, n.type, e.type AS relation FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.src = 's1' ORDER BY n.id LIMIT 20"),
    "related_2hop": ("GR3", f"WITH {EDGES}, hops AS (SELECT dst AS id, 1 AS h FROM edges WHERE src = 's1' UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 's1') SELECT id, min(h) AS min_hops FROM hops GROUP BY 1"),
    "timeline": ("GR8", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS mentions FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 7 GROUP BY 1"),
    "sync_check": ("GR14", "SELECT (SELECT count(*) FROM documents) AS extracted, (SELECT count(DISTINCT doc_id) FROM documents) AS pages, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS in_step"),
    "graph_nodes": ("GR13 GR15 SRC12", f"WITH {NODES} SELECT id, type, substr(name, 1, 500) AS description, CAST(0.8 AS DOUBLE) AS importance FROM nodes"),
    "centroids": ("AG37 ON2", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS x, round(avg(c_custkey), 4) AS y FROM customer GROUP BY 1"),
    "rate_limit": ("ST3", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "tumbling": ("extension", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"),
}


def views(spark, sf_dir: str) -> None:
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _register(name: str, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        views(spark, sf_dir)
        df = spark.sql(sql)
        # Literals with a point are decimals here and doubles there.
        return df.withColumns({c: df[c].cast("double") for c, t in df.dtypes if t.startswith("decimal")})


#: Written as DataFrames in edge_suite.py.
DEALT = ("min_degree_subgraph", "bridging", "cooccurrence")

for _name, (_ids, _sql) in SQL.items():
    if _name not in DEALT:
        _register(_name, _sql)
