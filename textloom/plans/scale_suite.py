"""Queries whose operators keep a group of any size out of one task: time joins, ranks, mentions, communities, the budget stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators import communities, evolution, graph, mentions, packing, ranks, resolution, time_joins, ward
from textloom.operators import vectors as V
from textloom.operators.graph import shared_folder
from textloom.plans.catalogue import query
from textloom.plans.sql_suite import BOTH, EDGES, views
from textloom.sources.tables import table
from textloom.streaming import budgets, streams


@query("interval_overlap", "SELECT seg, spk FROM (SELECT a.event_id AS seg, b.event_type AS spk, row_number() OVER (PARTITION BY a.event_id ORDER BY round(sum(least(a.value + 10, b.value + 5) - greatest(a.value, b.value)), 9) DESC, b.event_type) AS k FROM events a JOIN events b ON a.user_id = b.user_id AND a.value < b.value + 5 AND b.value < a.value + 10 GROUP BY a.event_id, b.event_type) x WHERE k = 1")
def interval_overlap(spark, sf):
    e = table(spark, sf, "events")
    segments = e.select("user_id", F.col("event_id").alias("id"), F.col("value").alias("start"), (F.col("value") + 10).alias("end"))
    turns = e.select("user_id", F.col("event_type").alias("label"), F.col("value").alias("start"), (F.col("value") + 5).alias("end"))
    return time_joins.dominant(segments, turns, "user_id").select(F.col("id").alias("seg"), F.col("label").alias("spk"))


@query("asof_nearest", "SELECT event_id, nearest FROM (SELECT a.event_id, b.event_id AS nearest, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.value - b.value), b.event_id) AS k FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click') x WHERE k = 1")
def asof_nearest(spark, sf):
    e = table(spark, sf, "events")
    probes = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("t"))
    points = e.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("pid"), F.col("value").alias("t"))
    return time_joins.asof(probes, points, "user_id").filter("pid IS NOT NULL").select(F.col("id").alias("event_id"), F.col("pid").alias("nearest"))


@query("asof_backward", "SELECT event_id, purchase FROM (SELECT a.event_id, b.event_id AS purchase, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id) AS k FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts AND epoch(a.ts) - epoch(b.ts) <= 86400 WHERE a.event_type = 'click') x WHERE k = 1")
def asof_backward(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    probes = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "t")
    points = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), "t")
    return time_joins.asof(probes, points, "user_id", "backward", tolerance=86_400).select(F.col("id").alias("event_id"), F.col("pid").alias("purchase"))


@query("nearest_group", "SELECT s_suppkey, nation FROM (SELECT s_suppkey, g.c_nationkey AS nation, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - g.m), g.c_nationkey) AS k FROM supplier CROSS JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) g) x WHERE k = 1")
def nearest_group(spark, sf):
    points = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("t")).select(F.lit(1).alias("g"), F.col("c_nationkey").alias("pid"), "t")
    probes = table(spark, sf, "supplier").select(F.lit(1).alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("t"))
    return time_joins.asof(probes, points, "g").select(F.col("id").alias("s_suppkey"), F.col("pid").alias("nation"))


@query("every_nth", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, (SELECT count(*) FROM documents) AS n FROM documents) x WHERE (rn - 1) % CAST(floor(n / 20.0) AS BIGINT) = 0 ORDER BY doc_id LIMIT 20")
def every_nth(spark, sf):
    return ranks.every_nth(table(spark, sf, "documents").select("doc_id"), [F.col("doc_id")], 20)


@query("worst_share", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS rn, (SELECT count(*) FROM lineitem) AS n FROM lineitem) x WHERE rn <= greatest(50, floor(n / 20.0))")
def worst_share(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.worst(rows, [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 0.05, 50).select("l_orderkey", "l_linenumber")


@query("union_mention", "SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id UNION SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def union_mention(spark, sf):
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    same = items.select("item_id", F.col("item_id").alias("doc_id")).join(docs.select("doc_id"), "doc_id").select("item_id", "doc_id")
    return same.unionByName(mentions.containing(docs, items)).distinct()


@query("louvain", "WITH l AS (SELECT c_nationkey AS n, min(concat('c', c_custkey)) AS low FROM customer GROUP BY 1) SELECT concat('c', c_custkey) AS id, low AS community FROM customer JOIN l ON c_nationkey = n UNION ALL SELECT concat('n', n_nationkey), coalesce(low, concat('n', n_nationkey)) FROM nation LEFT JOIN l ON n_nationkey = n")
def louvain(spark, sf):
    # Customers around their nations; weak edges join the nations to a ring, which hold no community together.
    stars = table(spark, sf, "customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst", "1.0D AS weight")
    ring = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS src", "concat('n', (n_nationkey + 1) % 25) AS dst", "0.01D AS weight")
    return communities.louvain(stars.unionByName(ring))


KIND = "CASE event_type WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'reconcile' WHEN 'error' THEN 'refund' ELSE 'other' END"


@query("budget_stream", f"WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {KIND} AS kind, CASE WHEN value > 0 THEN 0.006 * ceil(value * 10 / 60) ELSE 0.03 END AS cost, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rn FROM events), f(day, rn, spent, n_accepted, n_denied) AS (SELECT DISTINCT day, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT FROM e UNION ALL SELECT e.day, e.rn, round(f.spent + CASE WHEN e.kind = 'reserve' AND f.spent < 0.9 THEN 0.03 WHEN e.kind = 'reconcile' THEN round(e.cost - 0.03, 6) WHEN e.kind = 'refund' THEN -0.03 ELSE 0 END, 6), f.n_accepted + (e.kind = 'reserve' AND f.spent < 0.9)::BIGINT, f.n_denied + (e.kind = 'reserve' AND f.spent >= 0.9)::BIGINT FROM f JOIN e ON e.day = f.day AND e.rn = f.rn + 1) SELECT day, arg_max(spent, rn) AS spent, max(n_accepted) AS n_accepted, max(n_denied) AS n_denied FROM f GROUP BY day")
def budget_stream(spark, sf):
    """The events of the table as a stream, their decisions as days."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").selectExpr("event_id", "ts", f"{KIND} AS kind", "value * 10 AS duration_seconds", "CAST(NULL AS DOUBLE) AS upload_bytes")
    path = f"{shared_folder(spark)}/budget-{uuid.uuid4().hex}"
    # The whole table is one batch for the watermark, or late only by less than its days.
    budgets.run(events, 0.9, path, late="40 days").awaitTermination()
    rows = spark.read.parquet(f"{path}/decisions").filter("NOT closed")
    return rows.groupBy("day").agg(F.max_by("spent", "seq").alias("spent"), F.max("n_accepted").alias("n_accepted"), F.max("n_denied").alias("n_denied"))


SEGMENTS = "SELECT conv_id, text, length(text) AS l, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations"


@query("segment_pack", f"WITH RECURSIVE t AS ({SEGMENTS}), f(conv_id, i, k, s, total, l1, l2) AS (SELECT conv_id, i, 0::BIGINT, 0::BIGINT, l + 1, l, -1::BIGINT FROM t WHERE i = 0 UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.total + t.l > 500 THEN f.k + 1 ELSE f.k END, CASE WHEN f.total + t.l > 500 THEN greatest(t.i - 2, 0) ELSE f.s END, CASE WHEN f.total + t.l > 500 THEN f.l1 + 1 + f.l2 + 1 + t.l + 1 ELSE f.total + t.l + 1 END, t.l, f.l1 FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1), c AS (SELECT conv_id, k, min(s) AS s, max(i) AS e FROM f GROUP BY conv_id, k) SELECT c.conv_id AS episode, c.k AS chunk_index, n.n AS chunk_total, CAST(min(t.turn) AS DOUBLE) AS start, CAST(max(t.turn) + 1 AS DOUBLE) AS end, string_agg(t.text, ' ' ORDER BY t.i) AS chunk FROM c JOIN t ON t.conv_id = c.conv_id AND t.i BETWEEN c.s AND c.e JOIN (SELECT conv_id, count(*) AS n FROM c GROUP BY 1) n ON n.conv_id = c.conv_id GROUP BY c.conv_id, c.k, n.n")
def segment_pack(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")
    return packing.segment_chunks(rows)


WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"


@query("page_windows", f"WITH p AS (SELECT source, doc_id AS page, {WORDS} AS w FROM documents), q AS (SELECT * FROM p WHERE len(w) >= 50), x AS (SELECT source, page, unnest(w) AS word, unnest(range(len(w))) AS k FROM q), y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, k) - 1 AS i FROM x), z AS (SELECT *, unnest(range(CAST(greatest(0, floor((i - 500) / 425) + 1) AS BIGINT), i // 425 + 1)) AS win FROM y) SELECT source AS book, win * 425 AS start, count(DISTINCT page) AS pages, md5(string_agg(word, ' ' ORDER BY i)) AS chunk FROM z GROUP BY source, win")
def page_windows(spark, sf):
    """The documents of a source as the pages of a book."""
    rows = packing.page_windows(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"))
    return rows.select(F.col("doc_id").alias("book"), "start", F.size("pages").cast("long").alias("pages"), F.md5("chunk").alias("chunk"))


@query("ward_levels")
def ward_levels(spark, sf):
    return ward.levels(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


@query("near_vectors", "SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9")
def near_vectors(spark, sf):
    return V.product_pairs(V.units(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))), 0.9)


@query("near_vectors_hashed")
def near_vectors_hashed(spark, sf):
    return V.hashed_pairs(V.units(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))), 0.9)


@query("domain_evolution")
def domain_evolution(spark, sf):
    """Names of five tables, one batch a table, each with the counts of its letters as its vector."""
    path = f"{shared_folder(spark)}/domains-{uuid.uuid4().hex}"
    counts = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length("name") - F.length(F.replace(F.lower("name"), F.char(c), F.lit("")))).cast("double"))
    for k, (name, column) in enumerate((("nation", "n_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type"), ("region", "r_name"))):
        rows = table(spark, sf, name).select(F.col(column).alias("name"))
        evolution.evolve(rows.withColumn("vector", counts), path, k)
    domains = evolution.state(spark, path)[3]
    return domains.select("domain", "name", "parent", "n", "frequency")


NEAR = f"{EDGES}, {BOTH}".replace(" AS (\n", " AS MATERIALIZED (\n", 1).replace("both_ways AS (", "both_ways AS MATERIALIZED (")


@query("neighborhood", f"WITH {NEAR}, first AS MATERIALIZED (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'r1'), second AS MATERIALIZED (SELECT DISTINCT w.b AS id FROM both_ways w SEMI JOIN first f ON w.a = f.id), near AS MATERIALIZED (SELECT 'r1' AS id UNION SELECT id FROM first UNION SELECT id FROM second) SELECT src, dst, type FROM edges e SEMI JOIN near a ON e.src = a.id SEMI JOIN near b ON e.dst = b.id")
def neighborhood(spark, sf):
    views(spark, sf)
    return graph.neighborhood(spark.sql(f"WITH {EDGES} SELECT * FROM edges"), "r1", 2)


#: Regions as states, nations as cities, each with its customers as people; suppliers in nations, regions as they should not be.
PEOPLE = "people AS (SELECT n_nationkey, n_regionkey, n_name, count(c_custkey) AS population FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name)"
PLACES = f"{PEOPLE}, places AS (SELECT lower(n_name) AS name, population FROM people WHERE strpos(n_name, ' ') = 0 UNION ALL SELECT lower(r_name), sum(population) FROM people JOIN region ON r_regionkey = n_regionkey WHERE strpos(r_name, ' ') = 0 GROUP BY r_name)"
RELS = "SELECT n_name AS source, 'located_in' AS relationship, r_name AS target FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'PART_OF', n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT concat(r_name, ' province'), 'trades with', n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT concat(a.n_name, '  coast'), 'contains', b.n_name FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 7) % 25"


@query("population_reversal", f"WITH {PLACES}, rels AS ({RELS}), k AS (SELECT *, regexp_extract(lower(source), '^[^ ]+') AS s, regexp_extract(lower(target), '^[^ ]+') AS t FROM rels WHERE relationship <> 'trades with') SELECT source, relationship, target, CAST(a.population AS BIGINT) AS source_population, CAST(b.population AS BIGINT) AS target_population, 'REVERSE_RELATIONSHIP' AS suggested_fix FROM k JOIN places a ON a.name = s JOIN places b ON b.name = t WHERE a.population > 1.5 * b.population")
def population_reversal(spark, sf):
    views(spark, sf)
    places = spark.sql(f"WITH {PLACES.replace('strpos', 'instr')} SELECT name, CAST(population AS BIGINT) AS population FROM places")
    return resolution.population_reversals(spark.sql(RELS), places)


#: Nations as cities of their region, with places on a grid; claims of the right and of the next region, and of nations in nations.
GEO = f"{PEOPLE}, geo AS (SELECT n_name AS name, population, n_regionkey * 10.0 + n_nationkey % 5 AS lat, n_nationkey * 1.5 AS lon, 'City' AS type, r_name AS parent FROM people JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, sum(population) + 1, r_regionkey * 10.0 + 1, r_regionkey * 7.0, 'State', NULL FROM people JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey)"
CLAIMED = "SELECT n_name AS source, 'located_in' AS relationship, r_name AS target, 0.8 AS p_true FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, 'located_in', r_name, 0.5 FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % 5 UNION ALL SELECT a.n_name, 'located_in', b.n_name, 0.9 FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 UNION ALL SELECT n_name, 'located_in', 'Nowhere', 0.6 FROM nation UNION ALL SELECT n_name, 'near', 'Nowhere', 0.6 FROM nation"


@query("geo_checks", f"WITH {GEO}, claims AS ({CLAIMED}), j AS (SELECT c.*, s.population AS sp, t.population AS tp, s.type AS st, t.type AS tt, s.parent AS sa, t.parent AS ta, s.name AS sn, t.name AS tn, 2 * 6371 * asin(sqrt(pow(sin(radians(t.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2))) AS km FROM claims c LEFT JOIN geo s ON c.source = s.name LEFT JOIN geo t ON c.target = t.name WHERE relationship = 'located_in'), k AS (SELECT *, CASE WHEN sn IS NULL OR tn IS NULL THEN 0.05 WHEN NOT (ta IS NULL OR coalesce(sa = ta, false)) THEN 0.7 WHEN sp > 1.2 * tp THEN 0.6 WHEN km > CASE WHEN st = 'City' AND tt = 'State' THEN 500 ELSE 50 END THEN 0.3 ELSE 0.0 END AS penalty FROM j) SELECT source, target, CAST(p_true AS DOUBLE) AS p_true, CASE WHEN tn IS NULL THEN NULL ELSE penalty = 0 END AS valid, CAST(penalty AS DOUBLE) AS penalty, tn IS NOT NULL AND sp > 1.2 * tp AS swap, round(greatest(0, p_true - penalty), 6) AS adjusted FROM k")
def geo_checks(spark, sf):
    views(spark, sf)
    places = spark.sql(f"WITH {GEO} SELECT name, population, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, type, CASE WHEN parent IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array(parent) END AS admin_path FROM geo")
    found = resolution.geo_validate(spark.sql(CLAIMED).withColumn("p_true", F.col("p_true").cast("double")), places)
    return found.withColumn("adjusted", F.round("adjusted", 6))


def stream(spark, sf, name):
    """A table as a stream of its files."""
    return streams.parquet_stream(spark, f"{sf}/{name}.parquet*", table(spark, sf, name).schema)


@query("stream_new_items", "SELECT DISTINCT user_id FROM events")
def stream_new_items(spark, sf):
    path = f"{shared_folder(spark)}/new-{uuid.uuid4().hex}"
    events = stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.new_items(events, "user_id", late="40 days")
    found.writeStream.format("parquet").option("path", f"{path}/items").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{path}/items")


@query("stream_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_days(spark, sf):
    """Events appended to a folder for each day, and read again."""
    path = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    streams.append_by_day(stream(spark, sf, "events"), f"{path}/events", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/events")
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_pairs", "SELECT DISTINCT least(l_suppkey, l_partkey) AS x, greatest(l_suppkey, l_partkey) AS y FROM lineitem")
def stream_pairs(spark, sf):
    path = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    streams.validated_pairs(stream(spark, sf, "lineitem"), path, "l_suppkey", "l_partkey").awaitTermination()
    return spark.read.parquet(f"{path}/pairs").select("x", "y")


#: Regions with their nations; suppliers of the first five keys stand alone. Places: averages of balances and keys.
CLUSTERS = "SELECT concat('r', r_regionkey) AS id, CAST(NULL AS STRING) AS parent_id, r_regionkey * 10.0D AS x, r_regionkey * r_regionkey * 1.0D AS y FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_nationkey * 1.0D, 0.0D FROM nation WHERE n_regionkey < 4 UNION ALL SELECT concat('s', s_suppkey), CAST(NULL AS STRING), s_acctbal / 100, s_suppkey / 3.0D FROM supplier"


@query("hierarchy", "WITH c AS (" + CLUSTERS.replace("0D", "0::DOUBLE") + "), g AS (SELECT * FROM c WHERE parent_id IS NULL AND id IN (SELECT parent_id FROM c)), l AS (SELECT * FROM c WHERE parent_id IS NULL AND id NOT IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL)), m AS (SELECT l.id, arg_min(g.id, ((l.x - g.x) * (l.x - g.x) + (l.y - g.y) * (l.y - g.y), g.id)) AS parent FROM l, g GROUP BY l.id) SELECT id, 0 AS depth, id AS path FROM g UNION ALL SELECT id, 1, concat(parent_id, '/', id) FROM c WHERE parent_id IS NOT NULL UNION ALL SELECT id, 1, concat(parent, '/', id) FROM m")
def hierarchy(spark, sf):
    views(spark, sf)
    return graph.hierarchy_paths(graph.adopted(spark.sql(CLUSTERS)))
