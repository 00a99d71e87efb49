"""The registered queries outside the training-data subpackage, with SQL.

A query is a function of (spark, sf_dir); its SQL runs on the given tables
and, with ``WITH``, on the projected domain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivum.functions import hashing as H
from archivum.functions import text as T
from archivum.operators import audit, graph, policy, records, reports, search, similarity
from archivum.plans import domain as D
from archivum.plans.domain import WITH

#: The searched words and instants of the fixed queries.
QUERY = "the and"
STALE = "2025-10-01 00:00:00"
SINCE, UNTIL = "2024-01-02 00:00:00", "2024-01-20 00:00:00"
_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, plain: str | None = None):
    """Registers the function under its name; ``sql`` starts from WITH."""

    def put(f):
        _queries[f.__name__] = f
        if sql or plain:
            _sql[f.__name__] = WITH + sql if sql else plain
        return f

    return put


def ts(text: str):
    return F.lit(text).cast("timestamp")


# Finders and predicates (C).


@query("SELECT id, title, content_hash FROM memories WHERE id = 17")
def c1_memory_by_id(s, d):
    return records.find(D.memories(s, d), id=17).select("id", "title", "content_hash")


@query("SELECT id, category, lifecycle FROM memories WHERE tenant_id = 'de'")
def c2_memories_by_tenant(s, d):
    return records.find(D.memories(s, d), tenant_id="de").select("id", "category", "lifecycle")


@query("SELECT min(id) AS id, content_hash FROM memories WHERE content_hash = (SELECT content_hash FROM memories WHERE id = 1) GROUP BY content_hash")
def c3_memory_by_hash(s, d):
    memories = D.memories(s, d)
    wanted = records.find(memories, id=1).select("content_hash")
    return memories.join(wanted, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("id").alias("id"))


@query("SELECT id, tenant_id FROM memories WHERE lifecycle = 'superseded'")
def c5_memories_by_lifecycle(s, d):
    return records.find(D.memories(s, d), lifecycle="superseded").select("id", "tenant_id")


@query("SELECT id FROM memories WHERE tenant_id = 'en' AND lifecycle = 'active' AND category = 'decision'")
def c7_memories_by_tenant_lifecycle_category(s, d):
    return records.find(D.memories(s, d), tenant_id="en", lifecycle="active", category="decision").select("id")


@query(f"SELECT id, updated_at FROM memories WHERE lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}'")
def c8_stale_memories(s, d):
    return records.stale(D.memories(s, d), ts(STALE)).select("id", "updated_at")


@query("SELECT DISTINCT content_hash FROM memories WHERE tenant_id = 'fr'")
def c9_tenant_hashes(s, d):
    return records.find(D.memories(s, d), tenant_id="fr").select("content_hash").distinct()


@query("SELECT id FROM memories WHERE tenant_id = 'en' AND category IN ('decision', 'pattern')")
def c10_optional_filters(s, d):
    return records.find(D.memories(s, d), tenant_id="en", category=["decision", "pattern"], source=[]).select("id")


@query("SELECT id, status FROM memories WHERE id % 2 = 1 AND status = 'inbox' AND tenant_id = 'en'")
def c11_candidates_by_status(s, d):
    return records.find(D.memories(s, d).where("id % 2 = 1"), status="inbox", tenant_id="en").select("id", "status")


@query("SELECT id, action, timestamp FROM audit_events WHERE memory_id = 7 AND tenant_id = 't3'")
def c12_audit_by_memory(s, d):
    return records.find(D.audit_events(s, d), memory_id=7, tenant_id="t3").select("id", "action", "timestamp").orderBy("timestamp", "id")


@query(f"SELECT id, action FROM audit_events WHERE timestamp BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'")
def c13_audit_in_range(s, d):
    return D.audit_events(s, d).where(F.col("timestamp").between(ts(SINCE), ts(UNTIL))).select("id", "action")


@query("SELECT * FROM links WHERE source_id = 3 AND link_type = 'supersedes'")
def c14_links_by_source(s, d):
    return records.find(D.links(s, d), source_id=3, link_type="supersedes")


@query("SELECT id, title FROM memories WHERE contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'and') OR contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'and') ORDER BY id LIMIT 100")
def c16_like_search(s, d):
    return records.like_search(D.memories(s, d), "AND").select("id", "title")


@query("SELECT id, sensitivity FROM memories WHERE sensitivity NOT IN ('confidential', 'restricted')")
def c17_visible(s, d):
    return records.visible(D.memories(s, d)).select("id", "sensitivity")


@query("SELECT id FROM memories WHERE source <> 'bulk_import'")
def c18_curated_scope(s, d):
    return records.in_scope(D.memories(s, d), "curated").select("id")


@query("SELECT id FROM memories WHERE sensitivity IN ('public', 'internal')")
def c25_exportable(s, d):
    return records.exportable(D.memories(s, d)).select("id")


@query(f"SELECT id, updated_at FROM memories WHERE updated_at > TIMESTAMP '{STALE}'")
def c26_changed_since_export(s, d):
    return D.memories(s, d).where(F.col("updated_at") > ts(STALE)).select("id", "updated_at")


@query(
    """SELECT id, CASE WHEN lifecycle IN ('archived', 'superseded') THEN 'archive' WHEN source = 'bulk_import' THEN 'bulk'
    WHEN category = 'decision' THEN 'decisions' WHEN category IN ('pattern', 'convention', 'architecture') THEN 'curated' ELSE 'guides' END AS directory FROM memories"""
)
def c27_export_routing(s, d):
    return D.memories(s, d).select("id", T.directory(F.col("lifecycle"), F.col("source"), F.col("category")).alias("directory"))


# Writes (B), as the tables that they leave.


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'archived' ELSE lifecycle END AS lifecycle, CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END AS version FROM memories")
def b3_update_memories(s, d):
    base = D.memories(s, d).select("id", "lifecycle", "version")
    changes = base.where("id % 10 = 0").withColumn("lifecycle", F.lit("archived")).withColumn("version", F.lit(2))
    return records.upsert(base, changes, "id")


@query(
    """SELECT id, lifecycle, 'archived' AS target, CASE WHEN lifecycle = 'archived' THEN 'unchanged' ELSE 'allowed' END AS outcome FROM memories WHERE id % 2 = 0
    UNION ALL SELECT id, lifecycle, 'active', CASE WHEN lifecycle = 'active' THEN 'unchanged' WHEN lifecycle = 'deprecated' THEN 'allowed' ELSE 'illegal' END FROM memories WHERE id % 2 = 1"""
)
def b4_guarded_lifecycle(s, d):
    rows = D.memories(s, d).select("id", "lifecycle")
    return records.with_transition(rows, F.when(F.col("id") % 2 == 0, "archived").otherwise("active"))


@query("SELECT id, status FROM memories WHERE source <> 'import'")
def b6_delete_batch(s, d):
    base = D.memories(s, d).select("id", "status", "source")
    return records.without(base, base.where("source = 'import'"), "id").select("id", "status")


@query("SELECT source_id, target_id, link_type, weight FROM links UNION ALL SELECT -1, target_id, 'part_of', max(weight) FROM links GROUP BY target_id")
def b9_insert_links(s, d):
    base = D.links(s, d)
    new = base.groupBy("target_id").agg(F.max("weight").alias("weight")).select(F.lit(-1).cast("long").alias("source_id"), "target_id", F.lit("part_of").alias("link_type"), "weight")
    return records.insert_new(base, new.unionByName(base), ["source_id", "target_id", "link_type"])


@query("""SELECT id, '---' || chr(10) || 'id: "' || id || '"' || chr(10) || 'category: "' || category || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || content || chr(10) AS markdown FROM memories""")
def b19_render_markdown(s, d):
    from archivum.sources.markdown import rendered

    return D.memories(s, d).select("id", rendered(["id", "category"]).alias("markdown"))


# Joins (D).


@query("SELECT m.id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM audit_events e WHERE e.memory_id = m.id AND e.action = 'promoted')")
def d4_without_receipt(s, d):
    receipts = D.audit_events(s, d).where("action = 'promoted'").select(F.col("memory_id").alias("id"))
    return D.memories(s, d).join(receipts, "id", "left_anti").select("id")


@query("SELECT c.id, c.content_hash IN (SELECT content_hash FROM memories m WHERE m.id % 2 = 0 AND m.tenant_id = c.tenant_id) AS duplicate FROM memories c WHERE c.id % 2 = 1")
def d5_exact_duplicates(s, d):
    memories = D.memories(s, d)
    return similarity.exact_duplicates(memories.where("id % 2 = 1"), memories.where("id % 2 = 0")).select("id", "duplicate")


@query("SELECT coalesce(m.tenant_id, c.tenant_id) AS tenant_id, coalesce(m.n, 0) AS n_memories, coalesce(c.n, 0) AS n_candidates FROM (SELECT tenant_id, count(*) AS n FROM memories WHERE id % 2 = 0 GROUP BY 1) m FULL JOIN (SELECT tenant_id, count(*) AS n FROM memories WHERE id % 2 = 1 GROUP BY 1) c ON m.tenant_id = c.tenant_id")
def d13_tenants(s, d):
    memories = D.memories(s, d)
    return reports.tenants(memories.where("id % 2 = 0"), memories.where("id % 2 = 1"))


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state FROM (SELECT id, id % 3 AS v FROM memories WHERE id % 5 > 0) a FULL JOIN (SELECT id, id % 2 AS v FROM memories WHERE id % 7 > 0) b ON a.id = b.id")
def d14_index_delta(s, d):
    memories = D.memories(s, d)
    now = memories.where("id % 5 > 0").select("id", (F.col("id") % 3).alias("v"))
    stored = memories.where("id % 7 > 0").select("id", (F.col("id") % 2).alias("w"))
    both = now.join(stored, "id", "full_outer")
    return both.select("id", F.when(F.col("w").isNull(), "new").when(F.col("v").isNull(), "removed").when(F.col("v") != F.col("w"), "changed").otherwise("same").alias("state"))


# Aggregations (E).


@query("SELECT lifecycle, count(*) AS n FROM memories GROUP BY lifecycle")
def e2_by_lifecycle(s, d):
    return D.memories(s, d).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tenant_id, action, count(*) AS n FROM audit_events GROUP BY ALL")
def e6_by_tenant_and_action(s, d):
    return D.audit_events(s, d).groupBy("tenant_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.lifecycle, coalesce(n, 0) AS n FROM (SELECT unnest(['active', 'deprecated', 'superseded', 'archived', 'quarantined']) AS lifecycle) s LEFT JOIN (SELECT lifecycle, count(*) AS n FROM memories GROUP BY 1) c ON s.lifecycle = c.lifecycle")
def e7_lifecycle_report(s, d):
    return reports.zero_filled(D.memories(s, d), "lifecycle", [*D.LIFECYCLES, "quarantined"]).select("lifecycle", "n")


@query("SELECT *, promoted / (promoted + rejected) AS promotion_rate FROM (SELECT count(*) FILTER (action = 'promoted') AS promoted, count(*) FILTER (action = 'demoted') AS rejected, count(*) FILTER (action = 'superseded') AS superseded, count(*) FILTER (action = 'archived') AS archived FROM audit_events)")
def e8_curation_report(s, d):
    return reports.curation(D.audit_events(s, d))


@query(f"SELECT *, 1 - stale / active AS freshness FROM (SELECT count(*) AS total, count(*) FILTER (lifecycle = 'active') AS active, count(*) FILTER (lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}') AS stale FROM memories)")
def e9_health_report(s, d):
    return reports.health(D.memories(s, d), ts(STALE))


@query("SELECT lifecycle, category, tenant_id, count(*) AS n FROM memories GROUP BY GROUPING SETS ((lifecycle), (category), (tenant_id), ())")
def e14_status_counts(s, d):
    return reports.status_sets(D.memories(s, d))


@query(f"SELECT actor, count(*) AS total, count(*) FILTER (citations > 0) AS cited, CAST(sum(citations) AS BIGINT) AS citations FROM access_log WHERE time BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}' GROUP BY actor")
def e15_cited_queries(s, d):
    return reports.cited_queries(D.access_log(s, d), ts(SINCE), ts(UNTIL))


@query("SELECT tenant_id, CAST(max(greatest(0, date_diff('second', updated_at, TIMESTAMP '2026-01-01 00:00:00'))) AS BIGINT) AS seconds FROM memories WHERE updated_at > TIMESTAMP '2025-06-01 00:00:00' GROUP BY tenant_id")
def e16_index_staleness(s, d):
    waiting = D.memories(s, d).where(F.col("updated_at") > ts("2025-06-01 00:00:00"))
    age = F.greatest(F.unix_timestamp(ts(D.NOW)) - F.unix_timestamp(F.min("updated_at")), F.lit(0))
    return waiting.groupBy("tenant_id").agg(age.alias("seconds"))


@query(plain="SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT n_chars > 300 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id))))")
def e20_confusion(s, d):
    rows = D.read(s, d, "documents").join(D.read(s, d, "labels"), "doc_id")
    return reports.confusion(rows, F.col("n_chars") > 300, F.col("quality") == 1)


# Windows (F), order (G), sets (H).


@query("SELECT id, tenant_id, n FROM (SELECT id, tenant_id, row_number() OVER (PARTITION BY tenant_id, content_hash ORDER BY id) AS n FROM memories) WHERE n = 1")
def f5_first_in_batch(s, d):
    return similarity.first_in_batch(D.memories(s, d)).where("first").select("id", "tenant_id", F.lit(1).alias("n"))


@query("SELECT id, row_number() OVER (ORDER BY seq) AS position FROM audit_events WHERE action = 'promoted'")
def f4_chain_position(s, d):
    return audit.with_position(D.audit_events(s, d).where("action = 'promoted'")).select("id", "position")


@query("SELECT id, lag(value) OVER (PARTITION BY memory_id ORDER BY seq) AS previous FROM audit_events")
def f2_previous_value(s, d):
    return D.audit_events(s, d).select("id", F.lag("value").over(Window.partitionBy("memory_id").orderBy("seq")).alias("previous"))


@query("SELECT id, updated_at FROM memories ORDER BY updated_at DESC, id LIMIT 20 OFFSET 20")
def g7_second_page(s, d):
    return search.page(D.memories(s, d).select("id", "updated_at"), 2, 20, [F.desc("updated_at"), F.asc("id")])


@query("SELECT target_id AS id, link_type, weight, 'outgoing' AS direction FROM links WHERE source_id = 9 UNION ALL SELECT source_id, link_type, weight, 'incoming' FROM links WHERE target_id = 9")
def h1_neighbours(s, d):
    return graph.neighbours(D.links(s, d), 9)


@query("SELECT id FROM memories WHERE id % 2 = 0 EXCEPT SELECT id FROM memories WHERE id % 3 = 0")
def h9_removed_docs(s, d):
    memories = D.memories(s, d).select("id")
    return memories.where("id % 2 = 0").join(memories.where("id % 3 = 0"), "id", "left_anti")


@query("SELECT id, content_hash, min(side) AS side FROM (SELECT id, content_hash, 0 AS side FROM memories WHERE id % 2 = 0 UNION ALL SELECT id, content_hash, 1 FROM memories WHERE id % 3 = 0) GROUP BY id, content_hash")
def h3_clone_union(s, d):
    memories = D.memories(s, d).select("id", "content_hash")
    both = memories.where("id % 2 = 0").withColumn("side", F.lit(0)).unionAll(memories.where("id % 3 = 0").withColumn("side", F.lit(1)))
    return both.groupBy("id").agg(F.min_by("content_hash", "side").alias("content_hash"), F.min("side").alias("side"))


# Scalar functions (I).


@query("SELECT id, content_hash FROM memories")
def i1_content_hash(s, d):
    return D.memories(s, d).select("id", H.content_hash(F.col("content")).alias("content_hash"))


@query("SELECT id, round(exp(-ln(2) / 90 * (date_diff('millisecond', updated_at, TIMESTAMP '2026-01-01 00:00:00') / 86400000.0)), 9) AS freshness FROM memories")
def i6_freshness(s, d):
    return D.memories(s, d).select("id", F.round(T.freshness(F.col("updated_at"), ts(D.NOW)), 9).alias("freshness"))


@query("SELECT id, len(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> ''))) AS n FROM memories")
def i13_unique_words(s, d):
    return D.memories(s, d).select("id", F.size(T.title_tokens(F.col("content"))).cast("long").alias("n"))


@query(plain="SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/+$', '')) AS url FROM pages")
def i26_urls(s, d):
    return D.read(s, d, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url"))


# Policy (J) and pipelines (K).


@query("SELECT id, CASE WHEN trust_level = 'untrusted' THEN 'flag' ELSE 'pass' END AS result FROM memories")
def j4_source_trust(s, d):
    return D.memories(s, d).select("id", policy.source_trust("low", "flag").alias("result"))


@query("SELECT id, CASE WHEN sensitivity IN ('restricted', 'confidential') THEN 'fail' ELSE 'pass' END AS result FROM memories")
def j6_sensitivity_gate(s, d):
    return D.memories(s, d).select("id", policy.sensitivity_gate().alias("result"))


@query(f"SELECT id, 'deprecated' AS lifecycle FROM memories WHERE tenant_id = 'en' AND lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}'")
def k17_staleness_sweep(s, d):
    swept = records.stale(records.find(D.memories(s, d), tenant_id="en"), ts(STALE))
    return records.with_transition(swept, F.lit("deprecated")).where("outcome = 'allowed'").select("id", F.col("target").alias("lifecycle"))


# Search (L) and graph (M).

BM25_SQL = """, w AS (SELECT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM memories),
tf AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'and')) AS b FROM w),
st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
hits AS (SELECT id, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)) AS score
  FROM tf, st WHERE a > 0 AND b > 0)
"""


@query(BM25_SQL + "SELECT id, round(score, 9) AS score FROM hits")
def l1_bm25(s, d):
    return search.bm25(D.memories(s, d), QUERY).select("id", F.round("score", 9).alias("score"))


@query(
    """, a AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS rank FROM memories QUALIFY rank <= 50), b AS (SELECT id, row_number() OVER (ORDER BY length(content) DESC, id) AS rank FROM memories QUALIFY rank <= 50)
    SELECT id, round(sum(1 / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def l6_rank_fusion(s, d):
    memories = D.memories(s, d).withColumn("n", F.length("content"))

    def ranked(*order):
        top = memories.orderBy(*order).limit(50).select("id", "updated_at", "n")
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # 50 rows

    fused = search.fuse(ranked(F.desc("updated_at"), "id"), ranked(F.desc("n"), "id"))
    return fused.select("id", F.round("score", 12).alias("score"), "best_rank")


@query(
    """, one AS (SELECT target_id AS id, max(weight) AS weight, 1 AS depth FROM links WHERE source_id = 5 GROUP BY 1),
    two AS (SELECT l.target_id AS id, max(l.weight) AS weight, 2 AS depth FROM one JOIN links l ON l.source_id = one.id GROUP BY 1)
    SELECT id, depth, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, weight DESC) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id <> 5) WHERE n = 1"""
)
def m2_traverse(s, d):
    return graph.traverse(D.links(s, d), 5, 2)


# Evaluation.


def _load() -> None:
    """The other modules register their own when they are imported."""
    from archivum.plans import chains, dataflows, extra, lookups, measures, more, retrieval, scalars, sources, streams, surface, writes  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivum.plans.retrieval import l10_cited_rerank

    return l10_cited_rerank(spark, sf_dir)


def queries() -> dict:
    _load()

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
