"""Further registered queries: writes, lookups, reports, chains and measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.functions import text as T
from archivum.operators import audit, graph, policy, records, reports, search, similarity
from archivum.plans import domain as D
from archivum.plans.registry import SINCE, STALE, UNTIL, query, ts

EVEN, ODD = "id % 2 = 0", "id % 2 = 1"


def counted():
    return F.count(F.lit(1)).alias("n")


# B: writes.


@query("SELECT id, tenant_id FROM memories WHERE id % 2 = 0 UNION SELECT id, tenant_id FROM memories WHERE id % 3 = 0")
def b1_insert_memories(s, d):
    rows = D.memories(s, d).select("id", "tenant_id")
    return records.insert_new(rows.where(EVEN), rows.where("id % 3 = 0"), ["id"])


@query("SELECT id, CASE WHEN status = 'inbox' AND tenant_id = 'en' THEN 'rejected' ELSE status END AS status FROM memories")
def b5_update_status(s, d):
    base = D.memories(s, d).select("id", "status", "tenant_id")
    changes = records.find(base, status="inbox", tenant_id="en").withColumn("status", F.lit("rejected"))
    return records.upsert(base, changes, "id").select("id", "status")


@query("SELECT * FROM links WHERE NOT (source_id = 4)")
def b7_delete_links(s, d):
    return D.links(s, d).where(~(F.col("source_id") == 4))


CHAIN_SQL = "sha256(json_object('id', id, 'action', action, 'memory_id', memory_id, 'tenant_id', tenant_id, 'actor_json', '{}', 'reason', '', 'details_json', details_json, 'prev_entry_hash', prev_entry_hash)::VARCHAR)"


@query(
    f""", p AS (SELECT tenant_id, seq, CAST(id AS VARCHAR) AS id, action, CAST(memory_id AS VARCHAR) AS memory_id, details_json, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS n FROM audit_events),
    c AS (SELECT *, {CHAIN_SQL} AS entry_hash FROM (SELECT *, NULL::VARCHAR AS prev_entry_hash FROM p WHERE n = 1)
      UNION ALL SELECT *, {CHAIN_SQL} FROM (SELECT p.*, c.entry_hash AS prev_entry_hash FROM c JOIN p ON p.tenant_id = c.tenant_id AND p.n = c.n + 1))
    SELECT tenant_id, seq, id, action, memory_id, details_json, '{{}}' AS actor_json, '' AS reason, prev_entry_hash, entry_hash FROM c"""
)
def b8_append_audit(s, d):
    return audit.chained(D.audit_events(s, d).select("tenant_id", "seq", F.col("id").cast("string").alias("id"), "action", F.col("memory_id").cast("string").alias("memory_id"), "details_json"), "tenant_id")


@query("SELECT source, count(*) AS n, count(*) FILTER (status = 'rejected') AS n_rejected, 'completed' AS state FROM memories WHERE source LIKE '%import' GROUP BY source")
def b10_import_batches(s, d):
    rows = D.memories(s, d).where("source like '%import'")
    return rows.groupBy("source").agg(counted(), F.count_if(F.col("status") == "rejected").alias("n_rejected")).withColumn("state", F.lit("completed"))


@query("SELECT tenant_id, max(updated_at) AS last_indexed_at FROM memories WHERE id % 3 > 0 GROUP BY tenant_id UNION ALL SELECT 'zz', TIMESTAMP '2025-01-01 00:00:00'")
def b12_index_watermarks(s, d):
    latest = D.memories(s, d).where("id % 3 > 0").groupBy("tenant_id").agg(F.max("updated_at").alias("last_indexed_at"))
    base = s.createDataFrame([("en",), ("zz",)], "tenant_id string").withColumn("last_indexed_at", ts("2025-01-01 00:00:00"))
    return records.upsert(base, latest, "tenant_id")


@query("SELECT id, (id % 3 = 0) AS written FROM memories WHERE sensitivity IN ('public', 'internal')")
def b18_export_changed(s, d):
    rows = records.exportable(D.memories(s, d)).select("id", "content_hash")
    before = rows.where("id % 3 <> 0").select("id", F.col("content_hash").alias("old"))
    return rows.join(before, "id", "left").select("id", (~F.col("content_hash").eqNullSafe(F.col("old"))).alias("written"))


@query("SELECT id, sha256('q' || chr(0) || content_hash) AS key, CASE WHEN id % 4 = 0 THEN CAST(id AS DOUBLE) END AS cached FROM memories")
def b27_rerank_cache(s, d):
    keyed = D.memories(s, d).select("id", "content_hash", F.sha2(F.concat(F.lit("q\u0000"), "content_hash").cast("binary"), 256).alias("key"))
    cache = keyed.where("id % 4 = 0").groupBy("key", "id").agg(F.first("id").cast("double").alias("cached"))
    return keyed.join(cache, ["key", "id"], "left").select("id", "key", "cached")


# C and D: lookups and joins.


@query("SELECT id FROM memories WHERE tenant_id = 'es' AND lifecycle = 'archived'")
def c6_memories_by_tenant_lifecycle(s, d):
    return records.find(D.memories(s, d), tenant_id="es", lifecycle="archived").select("id")


@query("SELECT id, CASE WHEN lifecycle IN ('archived', 'superseded') THEN 'archived' WHEN source = 'bulk_import' THEN 'bulk' ELSE 'curated' END AS scope FROM memories")
def c19_scopes(s, d):
    scope = F.when(F.col("lifecycle").isin("archived", "superseded"), "archived").when(F.col("source") == "bulk_import", "bulk").otherwise("curated")
    return D.memories(s, d).select("id", scope.alias("scope"))


@query(f"SELECT id FROM memories WHERE source = 'import' AND category = 'reference' AND updated_at < TIMESTAMP '{STALE}'")
def c22_batch_criteria(s, d):
    return records.find(D.memories(s, d), source="import", category="reference").where(F.col("updated_at") < ts(STALE)).select("id")


@query("SELECT m.id, m.title FROM memories m JOIN (SELECT DISTINCT memory_id FROM audit_events WHERE action = 'promoted') e ON e.memory_id = m.id")
def d1_hits_with_records(s, d):
    promoted = D.audit_events(s, d).where("action = 'promoted'").select(F.col("memory_id").alias("id"))
    return D.memories(s, d).join(promoted, "id", "left_semi").select("id", "title")


@query(
    """SELECT id, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY id) > 1 THEN 'batch'
      WHEN content_hash IN (SELECT content_hash FROM memories WHERE id % 3 = 0) THEN 'curated' ELSE 'none' END AS collision FROM memories WHERE id % 3 > 0"""
)
def d6_collisions(s, d):
    memories = D.memories(s, d).select("id", "content_hash", F.lit("").alias("tenant_id"))
    batch = similarity.first_in_batch(memories.where("id % 3 > 0"))
    known = memories.where("id % 3 = 0").select("content_hash").distinct().withColumn("known", F.lit(True))
    joined = batch.join(known, "content_hash", "left")
    return joined.select("id", F.when(~F.col("first"), "batch").when(F.col("known"), "curated").otherwise("none").alias("collision"))


@query("SELECT v.vec_id, coalesce(m.category, '') AS category, coalesce(m.sensitivity, 'public') AS sensitivity FROM embeddings v LEFT JOIN memories m ON m.id = v.vec_id * 3")
def d9_hit_metadata(s, d):
    hits = D.read(s, d, "embeddings").select("vec_id", (F.col("vec_id") * 3).alias("id"))
    joined = hits.join(D.memories(s, d).select("id", "category", "sensitivity"), "id", "left")
    return joined.select("vec_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("sensitivity", F.lit("public")).alias("sensitivity"))


@query("SELECT id, min(side) AS side FROM (SELECT id, 0 AS side FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, 1 FROM memories WHERE id % 5 = 0) GROUP BY id")
def d19_clone_union(s, d):
    rows = D.memories(s, d).select("id")
    return rows.where(EVEN).withColumn("side", F.lit(0)).unionAll(rows.where("id % 5 = 0").withColumn("side", F.lit(1))).groupBy("id").agg(F.min("side").alias("side"))


# E: aggregations.


@query("SELECT count(*) AS n FROM memories")
def e1_count(s, d):
    return D.memories(s, d).agg(counted())


@query("SELECT category, count(*) AS n FROM memories GROUP BY category")
def e3_by_category(s, d):
    return D.memories(s, d).groupBy("category").agg(counted())


@query("SELECT tenant_id, count(*) AS n FROM memories GROUP BY tenant_id")
def e4_by_tenant(s, d):
    return D.memories(s, d).groupBy("tenant_id").agg(counted())


@query("SELECT action, count(*) AS n FROM audit_events GROUP BY action")
def e5_by_action(s, d):
    return D.audit_events(s, d).groupBy("action").agg(counted())


@query(f"SELECT tenant_id, count(*) AS n_stale, min(updated_at) AS oldest FROM memories WHERE lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}' GROUP BY tenant_id")
def e13_stale_report(s, d):
    return records.stale(D.memories(s, d), ts(STALE)).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_stale"), F.min("updated_at").alias("oldest"))


@query("SELECT CAST(max(seconds) AS BIGINT) AS worst FROM (SELECT tenant_id, date_diff('second', min(updated_at), TIMESTAMP '2026-01-01 00:00:00') AS seconds FROM memories GROUP BY tenant_id)")
def e17_worst_staleness(s, d):
    own = D.memories(s, d).groupBy("tenant_id").agg((F.unix_timestamp(ts(D.NOW)) - F.unix_timestamp(F.min("updated_at"))).alias("seconds"))
    return own.agg(F.max("seconds").alias("worst"))


@query("SELECT count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) AS processed FROM memories")
def e18_batch_outcomes(s, d):
    of = lambda v, n: F.count_if(F.col("status") == v).alias(n)
    return D.memories(s, d).agg(of("promoted", "promoted"), of("rejected", "rejected"), of("flagged", "flagged"), of("duplicate", "duplicates"), F.count(F.lit(1)).alias("processed"))


@query("SELECT round(coalesce(avg(value), 0), 6) AS mean, count(DISTINCT memory_id) AS n_memories FROM audit_events WHERE action = 'promoted'")
def e21_means(s, d):
    return D.audit_events(s, d).where("action = 'promoted'").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.count_distinct("memory_id").alias("n_memories"))


# F and G: windows and order.


@query("SELECT tenant_id, id, rank FROM (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY length(content) DESC, id) AS rank FROM memories) WHERE rank <= 10")
def f7_ranks_in_lists(s, d):
    own = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc(F.length("content")), "id"))
    return D.memories(s, d).withColumn("rank", own).where("rank <= 10").select("tenant_id", "id", "rank")


@query("SELECT id, TIMESTAMP '2026-01-01 00:00:00' + to_milliseconds(row_number() OVER (ORDER BY id) - 1) AS clock FROM memories WHERE id % 2 = 0")
def f10_merge_clock(s, d):
    placed = audit.with_position(D.memories(s, d).where(EVEN).select("id"), "id")
    return placed.select("id", F.timestamp_millis(F.lit(1767225600000) + F.col("position") - 1).alias("clock"))


@query("SELECT id, weight FROM (SELECT source_id * 1000 + target_id AS id, weight FROM links WHERE link_type = 'part_of') ORDER BY weight DESC, id LIMIT 100")
def g1_rank_limit(s, d):
    rows = D.links(s, d).where("link_type = 'part_of'").select((F.col("source_id") * 1000 + F.col("target_id")).alias("id"), "weight")
    return search.top(rows, 100, "weight")


@query("SELECT tenant_id, id FROM (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY updated_at DESC, id) AS n FROM memories) WHERE n <= 5")
def g12_newest_first(s, d):
    own = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("updated_at"), "id"))
    return D.memories(s, d).withColumn("n", own).where("n <= 5").select("tenant_id", "id")


@query("SELECT tenant_id FROM memories WHERE id % 2 = 0 UNION SELECT tenant_id FROM audit_events")
def h4_tenant_union(s, d):
    return D.memories(s, d).where(EVEN).select("tenant_id").union(D.audit_events(s, d).select("tenant_id")).distinct()


@query("SELECT id FROM memories WHERE lifecycle IN ('active', 'deprecated')")
def h5_lifecycle_parts(s, d):
    return records.find(D.memories(s, d), lifecycle=["active", "deprecated"]).select("id")


# I: scalar functions.


@query(plain="SELECT page_id, CASE WHEN regexp_extract(url, '([^/]*)$', 1) = '' THEN NULL ELSE nullif(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]+$', ''), '') END AS cited FROM pages")
def i17_citation_ids(s, d):
    return D.read(s, d, "pages").select("page_id", T.citation_id(F.col("url")).alias("cited"))


@query("SELECT id, floor((id / 7.0) * 1000 + 0.5) / 1000 AS score, CAST(id % 3 + 1 AS DOUBLE) AS other FROM memories")
def i8_rounding(s, d):
    return D.memories(s, d).select("id", T.round3(F.col("id") / 7.0).alias("score"), (F.col("id") % 3 + 1).cast("double").alias("other"))


@query("SELECT id, CASE category WHEN 'decision' THEN 1.2 WHEN 'architecture' THEN 1.15 WHEN 'convention' THEN 1.1 WHEN 'pattern' THEN 1.1 WHEN 'troubleshooting' THEN 1.0 WHEN 'onboarding' THEN 0.95 ELSE 0.9 END::DOUBLE AS boost FROM memories")
def i7_category_boost(s, d):
    return D.memories(s, d).select("id", T.category_boost(F.col("category")).alias("boost"))


@query("SELECT id, regexp_matches(lower(content), '(^|[^a-z0-9])idiot($|[^a-z0-9])') AS mentioned FROM memories")
def i39_mentions(s, d):
    return D.memories(s, d).select("id", T.mentions(F.col("content"), "idiot").alias("mentioned"))


@query(plain="SELECT doc_id AS id, length(text) < 10 OR length(text) > 20000 AS failed FROM documents")
def j2_content_length(s, d):
    return D.memories(s, d).select("id", (policy.content_length(10, 20_000) == "fail").alias("failed"))


@query("SELECT id, CASE WHEN tenant_id = 'en' THEN 'pass' ELSE 'fail' END AS result FROM memories")
def j3_tenant_match(s, d):
    return D.memories(s, d).select("id", policy.tenant_match("en").alias("result"))


@query("SELECT c.id, CASE WHEN c.content_hash IN (SELECT content_hash FROM memories WHERE id % 2 = 0) THEN 'fail' ELSE 'pass' END AS result FROM memories c WHERE id % 2 = 1")
def j7_dedup_check(s, d):
    rows = D.memories(s, d).withColumn("tenant_id", F.lit(""))
    found = similarity.exact_duplicates(rows.where(ODD), rows.where(EVEN))
    return found.select("id", F.when(F.col("duplicate"), "fail").otherwise("pass").alias("result"))


@query("SELECT id, CASE WHEN regexp_matches(content, '[a-zA-Z0-9-]+\\.internal\\b|[a-zA-Z0-9-]+\\.local\\b|(/home/|/Users/)[A-Za-z0-9_-]+|[A-Za-z]:\\\\[A-Za-z0-9_\\\\-]+|\\b(10\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}|172\\.(1[6-9]|2\\d|3[01])\\.\\d{1,3}\\.\\d{1,3}|192\\.168\\.\\d{1,3}\\.\\d{1,3})\\b') THEN 'flag' ELSE 'pass' END AS result FROM memories")
def j8_content_sanitization(s, d):
    return D.memories(s, d).select("id", policy.content_sanitization().alias("result"))


# K: pipelines.


@query("SELECT id, 'untrusted' AS trust_level, 'inbox' AS status FROM memories WHERE id % 2 = 1 AND id NOT IN (SELECT id FROM memories WHERE id % 3 = 0)")
def k3_ingest(s, d):
    rows = D.memories(s, d)
    fresh = rows.where(ODD).join(rows.where("id % 3 = 0").select("id"), "id", "left_anti")
    return fresh.select("id", F.lit("untrusted").alias("trust_level"), F.lit("inbox").alias("status"))


@query("SELECT lifecycle, count(*) FILTER (lifecycle = 'active') AS changed, count(*) FILTER (lifecycle = 'deprecated') AS unchanged, count(*) FILTER (lifecycle NOT IN ('active', 'deprecated')) AS illegal FROM memories GROUP BY lifecycle")
def k16_batch_transition(s, d):
    moved = records.with_transition(D.memories(s, d), F.lit("deprecated"))
    of = lambda v, n: F.count_if(F.col("outcome") == v).alias(n)
    return moved.groupBy("lifecycle").agg(of("allowed", "changed"), of("unchanged", "unchanged"), of("illegal", "illegal"))


@query("SELECT count(*) AS n_memories, count(*) FILTER (NOT EXISTS (SELECT 1 FROM audit_events e WHERE e.memory_id = m.id AND action = 'promoted')) AS n_orphans FROM memories m")
def k24_corpus_accounting(s, d):
    receipts = D.audit_events(s, d).where("action = 'promoted'").select(F.col("memory_id").alias("id")).distinct().withColumn("r", F.lit(1))
    joined = D.memories(s, d).join(receipts, "id", "left")
    return joined.agg(F.count(F.lit(1)).alias("n_memories"), F.count_if(F.col("r").isNull()).alias("n_orphans"))


# L, M, N, O: search, graph, chain, measures.


@query(
    """, strong AS (SELECT * FROM links WHERE weight > 0.08), a AS (SELECT target_id AS id, max(weight) AS weight, 1 AS depth FROM strong WHERE source_id = 5 GROUP BY 1),
    b AS (SELECT l.target_id AS id, max(l.weight) AS weight, 2 AS depth FROM a JOIN strong l ON l.source_id = a.id GROUP BY 1), c AS (SELECT l.target_id AS id, max(l.weight) AS weight, 3 AS depth FROM b JOIN strong l ON l.source_id = b.id GROUP BY 1),
    e AS (SELECT l.target_id AS id, max(l.weight) AS weight, 4 AS depth FROM c JOIN strong l ON l.source_id = c.id GROUP BY 1)
    SELECT id, depth, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, weight DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e) WHERE id <> 5) WHERE n = 1"""
)
def m2_traverse_deeper(s, d):
    return graph.traverse(D.links(s, d).where("weight > 0.08"), 5, 4)


@query(plain="SELECT lang, avg(CASE WHEN n_chars > 300 THEN 1.0 ELSE 0.0 END) AS predicted, avg(quality) AS actual, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def o5_stratified(s, d):
    rows = D.read(s, d, "documents").join(D.read(s, d, "labels"), "doc_id")
    return rows.rollup("lang").agg(F.avg(F.when(F.col("n_chars") > 300, 1.0).otherwise(0.0)).alias("predicted"), F.avg("quality").alias("actual"), counted())


@query("SELECT avg(CASE WHEN c.content_hash IN (SELECT content_hash FROM memories WHERE id % 2 = 0) THEN 1.0 ELSE 0.0 END) AS caught FROM memories c WHERE id % 2 = 1")
def o11_dedup_catch_rate(s, d):
    rows = D.memories(s, d).withColumn("tenant_id", F.lit(""))
    found = similarity.exact_duplicates(rows.where(ODD), rows.where(EVEN))
    return found.agg(F.avg(F.col("duplicate").cast("double")).alias("caught"))


@query(f"SELECT actor, count(*) AS n FROM access_log WHERE time >= TIMESTAMP '{SINCE}' AND time <= TIMESTAMP '{UNTIL}' GROUP BY actor HAVING count(*) > 5")
def p11_rolling_window(s, d):
    return reports.cited_queries(D.access_log(s, d), ts(SINCE), ts(UNTIL)).where("total > 5").select("actor", F.col("total").alias("n"))


# Classical joins, top-k and windows over the star schema.


@query(plain="SELECT n_name, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def t1_orders_by_nation(s, d):
    joined = D.read(s, d, "orders").join(D.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(D.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(plain="SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL")
def t2_pricing_summary(s, d):
    rows = D.read(s, d, "lineitem").where(F.col("l_shipdate") <= ts("1998-09-02 00:00:00"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), counted())


# Files, anchors and limits.


@query(plain="SELECT page_id, regexp_matches(lower(url), '(^|/)(vendor|dist|build|coverage)/') AS ignored FROM pages")
def i36_ignored_paths(s, d):
    from archivum.functions.ignore import ignored

    return D.read(s, d, "pages").select("page_id", ignored(F.regexp_replace("url", "^https?://", "")).alias("ignored"))


def limited_sql(rows: str, most: int, window_ms: int) -> str:
    """After WITH: each event (event_id, who, ms) of ``rows`` with ``allowed``."""
    return f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY ms, event_id) AS n FROM ({rows})),
    w AS (SELECT event_id, who, n, ms AS start, 1 AS seen FROM q WHERE n = 1
      UNION ALL SELECT q.event_id, q.who, q.n, CASE WHEN q.ms - w.start > {window_ms} THEN q.ms ELSE w.start END, CASE WHEN q.ms - w.start > {window_ms} THEN 1 ELSE w.seen + 1 END FROM w JOIN q ON q.who = w.who AND q.n = w.n + 1),
    judged AS (SELECT event_id, who, seen <= {most} AS allowed FROM w) """


@query(plain=limited_sql("SELECT event_id, user_id AS who, epoch_ms(ts) AS ms FROM events", 3, 3_600_000) + "SELECT event_id, allowed FROM judged")
def p6_rate_limit(s, d):
    from archivum.operators.limits import limited

    events = D.read(s, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return limited(events, "user_id", "at", 3, 3_600_000).select("event_id", "allowed")


@query("SELECT CAST(id AS VARCHAR) AS path, CASE WHEN id % 3 = 0 THEN 'no_manifest' WHEN id % 3 = 1 THEN 'verified' ELSE 'tampered' END AS state FROM memories")
def a7_verified_files(s, d):
    from archivum.operators.anchors import verified_files

    files = D.memories(s, d).select(F.col("id").cast("string").alias("path"), F.col("content").cast("binary").alias("content"), "content_hash", "id")
    sidecars = files.where("id % 3 > 0").select("path", F.when(F.col("id") % 3 == 1, F.col("content_hash")).otherwise("0").alias("sha256"))
    return verified_files(files.select("path", "content"), sidecars)
