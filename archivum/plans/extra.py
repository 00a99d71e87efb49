"""The last registered queries: histograms, sets, normalised scores, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.functions import text as T
from archivum.operators import policy, records, reports, similarity
from archivum.plans import domain as D
from archivum.plans.registry import query, ts

RULES = ["content_length", "content_sanitization", "contradiction_check", "dedup_check", "relevance_score", "secret_detection", "sensitivity_gate", "source_trust", "tenant_match"]


def counted():
    return F.count(F.lit(1)).alias("n")


@query("SELECT tenant_id, count(*) AS n_memories, count(*) FILTER (lifecycle = 'active') AS n_active, max(updated_at) AS latest FROM memories GROUP BY tenant_id HAVING count(*) > 0")
def e12_tenant_report(s, d):
    return D.memories(s, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_memories"), F.count_if(F.col("lifecycle") == "active").alias("n_active"), F.max("updated_at").alias("latest"))


@query("SELECT count(*) AS total, count(*) FILTER (status IN ('promoted', 'inbox')) AS created, count(*) FILTER (status = 'duplicate') AS skipped, count(*) FILTER (status IN ('rejected', 'quarantined')) AS rejected FROM memories WHERE source IN ('import', 'bulk_import')")
def e19_import_outcomes(s, d):
    rows = records.find(D.memories(s, d), source=["import", "bulk_import"])
    of = lambda v, n: F.count_if(F.col("status").isin(v)).alias(n)
    return rows.agg(F.count(F.lit(1)).alias("total"), of(["promoted", "inbox"], "created"), of(["duplicate"], "skipped"), of(["rejected", "quarantined"], "rejected"))


@query("SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) <> [] AS has_words, len(list_distinct(regexp_extract_all(lower(title), '[a-z]+'))) AS n FROM memories")
def e22_distinct_tokens(s, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)))
    return D.memories(s, d).select("id", (F.size(words) > 0).alias("has_words"), F.size(words).cast("long").alias("n"))


@query("SELECT id, tenant_id FROM memories WHERE status = 'inbox' ORDER BY id LIMIT 100")
def g9_cycle(s, d):
    return records.find(D.memories(s, d), status="inbox").orderBy("id").limit(100).select("id", "tenant_id")


@query(f"SELECT unnest({RULES}) AS rule EXCEPT SELECT unnest(['secret_detection', 'content_length', 'tenant_match', 'source_trust', 'relevance_score', 'sensitivity_gate', 'content_sanitization'])")
def h6_uncovered_rules(s, d):
    known = F.array(*[F.lit(r) for r in RULES])
    enabled = F.array(*[F.lit(n) for n, _, _ in policy.recommended()])
    return s.range(1).select(F.explode(F.array_sort(F.array_except(known, enabled))).alias("rule"))


@query(plain="SELECT page_id, coalesce(nullif(trim(regexp_replace(CASE WHEN regexp_extract(url, '([^/]*)$', 1) = '' THEN '' ELSE regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]+$', '') END, '[-_]+', ' ', 'g')), ''), url) AS title FROM pages")
def i18_citation_titles(s, d):
    return D.read(s, d, "pages").select("page_id", T.citation_title(F.col("url")).alias("title"))


@query("SELECT id, substr(content, 1, 200) AS snippet FROM memories")
def i24_snippets(s, d):
    return D.memories(s, d).select("id", F.substring("content", 1, 200).alias("snippet"))


@query("SELECT id, tenant_id, length(content) / CAST(max(length(content)) OVER (PARTITION BY tenant_id) AS DOUBLE) AS score FROM memories")
def i25_normalised_scores(s, d):
    rows = D.memories(s, d).select("id", "tenant_id", F.length("content").alias("n"))
    most = rows.groupBy("tenant_id").agg(F.max("n").alias("m"))
    return rows.join(most, "tenant_id").select("id", "tenant_id", (F.col("n") / F.col("m")).alias("score"))


@query("SELECT id, CASE WHEN contains(title, 'the') THEN 0.9 ELSE 0.6 END::DOUBLE AS score FROM memories WHERE lifecycle = 'active' AND (contains(title, 'the') OR contains(content, 'the'))")
def l12_fallback_search(s, d):
    active = records.find(D.memories(s, d), lifecycle="active").where(F.contains("title", F.lit("the")) | F.contains("content", F.lit("the")))
    return active.select("id", F.when(F.contains("title", F.lit("the")), 0.9).otherwise(0.6).alias("score"))


@query("SELECT tenant_id, round(avg(CASE WHEN duplicate THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT c.tenant_id, c.content_hash IN (SELECT content_hash FROM memories m WHERE id % 2 = 0 AND m.tenant_id = c.tenant_id) AS duplicate FROM memories c WHERE id % 2 = 1) GROUP BY tenant_id")
def o9_duplicate_share(s, d):
    rows = D.memories(s, d)
    found = similarity.exact_duplicates(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"))
    return found.groupBy("tenant_id").agg(F.round(F.avg(F.col("duplicate").cast("double")), 6).alias("share"))


@query("SELECT count(*) FILTER (content_hash = sha256(content)) AS n_intact, count(*) FILTER (source IN ('claude_session', 'manual', 'import', 'mcp', 'bulk_import')) AS n_sourced, count(*) AS n FROM memories")
def o10_provenance(s, d):
    intact = F.col("content_hash") == F.sha2(F.col("content").cast("binary"), 256)
    return D.memories(s, d).agg(F.count_if(intact).alias("n_intact"), F.count_if(F.col("source").isin(D.SOURCES)).alias("n_sourced"), counted())


@query(
    plain="""WITH r AS (SELECT CAST(doc_id % 20 AS BIGINT) AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars, doc_id) AS rank FROM documents),
    g AS (SELECT CAST(doc_id % 20 AS BIGINT) AS query_id, doc_id FROM labels WHERE quality = 0)
    SELECT round(avg(coalesce(n_hits, 0) / n_gold), 9) AS recall, round(avg(coalesce(rr, 0)), 9) AS mrr FROM (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1) w
    LEFT JOIN (SELECT r.query_id, count(*) AS n_hits, max(1 / rank) AS rr FROM r JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id WHERE rank <= 10 GROUP BY 1) h ON w.query_id = h.query_id"""
)
def o4_eval_run(s, d):
    docs = D.read(s, d, "documents").withColumn("query_id", F.col("doc_id") % 20)
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n_chars", "doc_id"))).where("rank <= 10")
    gold = D.read(s, d, "labels").where("quality = 0").select((F.col("doc_id") % 20).alias("query_id"), "doc_id")
    return reports.retrieval(ranked, gold).agg(F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("mrr"), 9).alias("mrr"))


@query("SELECT id, updated_at + INTERVAL 30 DAY AS due, updated_at + INTERVAL 30 DAY < TIMESTAMP '2026-01-01 00:00:00' AS overdue FROM memories")
def i52_due_times(s, d):
    due = F.col("updated_at") + F.make_dt_interval(F.lit(30))
    return D.memories(s, d).select("id", due.alias("due"), (due < ts(D.NOW)).alias("overdue"))
