"""Registered queries of writes (B): what is in a table or folder afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions import disclosure
from archivum.functions import text as T
from archivum.operators import anchors, index, records, reports, search
from archivum.plans import domain as D
from archivum.plans import sqltext as S
from archivum.plans.registry import STALE, query, ts
from archivum.plans.scalars import WITH_PLANTS, planted
from archivum.plans.sources import LINES, as_files, numbered
from archivum.sources import files, jsonl
from archivum.sources import records as R
from archivum.storage import fresh_path


@query(WITH_PLANTS + f"SELECT id, CASE WHEN {S.disclosed('content')} IS NOT NULL THEN {S.disclosed('content')} WHEN id % 9 = 0 THEN 'category' WHEN id % 2 = 0 THEN 'exists' ELSE 'inserted' END AS outcome FROM planted")
def b2_insert_candidates(s, d):
    rows = planted(s, d).withColumn("category", F.when(F.col("id") % 9 == 0, "bogus").otherwise(F.col("category")))
    judged = rows.withColumn("found", disclosure.category(disclosure.canonical(F.col("content"))))
    stored = judged.where("id % 2 = 0").select("id").withColumn("there", F.lit(True))
    outcome = F.when(F.col("found").isNotNull(), F.col("found")).when(~F.col("category").isin(D.CATEGORIES), "category").when(F.col("there"), "exists").otherwise("inserted")
    return judged.join(stored, "id", "left").select("id", outcome.alias("outcome"))


@query(f"SELECT tenant_id, CASE WHEN tenant_id IN ('en', 'de') THEN max(updated_at) ELSE TIMESTAMP '{STALE}' END AS last_exported_at FROM memories WHERE tenant_id <> 'es' OR lifecycle = 'active' GROUP BY tenant_id")
def b11_export_watermarks(s, d):
    rows = D.memories(s, d)
    base = rows.select("tenant_id").distinct().withColumn("last_exported_at", ts(STALE))
    changes = rows.where("tenant_id in ('en', 'de')").groupBy("tenant_id").agg(F.max("updated_at").alias("last_exported_at"))
    return records.upsert(base, changes, "tenant_id")


@query(f"SELECT CASE WHEN (id // {LINES}) % 5 = 4 THEN '../evil-' ELSE 'spool-' END || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl' AS name, CASE WHEN (id // {LINES}) % 5 = 4 THEN 'unsafe' ELSE 'written' END AS outcome FROM memories GROUP BY ALL")
def b14_spool_append(s, d):
    lines = D.memories(s, d).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), "title")).alias("line"))
    rows = numbered(lines, "spool-", ".jsonl")
    climbing = F.floor(F.col("id") / LINES) % 5 == 4
    rows = rows.withColumn("name", F.when(climbing, F.regexp_replace("name", "^spool-", "../evil-")).otherwise(F.col("name")))
    return files.write_files(as_files(rows), fresh_path(s, "append")).select("name", "outcome")


@query("SELECT json_object('candidateInput', json_object('id', id, 'category', 'bogus'), 'error', 'category', 'failedAt', '2026-01-01T00:00:00.000Z')::VARCHAR AS line FROM memories WHERE id % 9 = 0")
def b15_failure_bucket(s, d):
    rows = D.memories(s, d).select("id", F.when(F.col("id") % 9 == 0, "bogus").otherwise(F.col("category")).alias("category"))
    _, bad = jsonl.split_valid(rows, F.col("category").isin(D.CATEGORIES))
    path = fresh_path(s, "failures")
    bad.select(F.to_json(F.struct(F.struct("id", "category").alias("candidateInput"), F.lit("category").alias("error"), F.lit("2026-01-01T00:00:00.000Z").alias("failedAt")))).write.text(path)
    return s.read.text(path).withColumnRenamed("value", "line")


FIRST_SQL = " UNION ALL ".join(
    f"SELECT id, '{n}' AS pattern, instr(content, regexp_extract(content, {S.lit(p)})) AS start, length(regexp_extract(content, {S.lit(p)})) AS length FROM planted WHERE {S.matches('content', p)}" for n, p in T.SECRETS.items() if n not in T.CONTEXT
)


@query(WITH_PLANTS + FIRST_SQL)
def b16_redaction_audit(s, d):
    """Where each kind of credential first occurs; never what it is."""
    found = [F.when(F.col("content").rlike(p), F.struct(F.lit(n).alias("pattern"), F.regexp_instr("content", F.lit(p)).cast("long").alias("start"), F.length(F.regexp_extract("content", p, 0)).cast("long").alias("length"))) for n, p in T.SECRETS.items() if n not in T.CONTEXT]
    return planted(s, d).select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("id", "f.*")


@query(f"SELECT CASE WHEN (id // {LINES}) % 3 = 1 THEN 'quarantine' ELSE 'spool' END AS folder, 'spool-' || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl' || e.ext AS name FROM memories, (VALUES (''), ('.tamper.json')) e(ext) WHERE e.ext = '' OR (id // {LINES}) % 3 = 1 GROUP BY ALL")
def b17_quarantine(s, d):
    """Tampered files move away, with a note of the two hashes beside them."""
    lines = D.memories(s, d).select("id", F.col("content_hash").alias("line"))
    folder, away = fresh_path(s, "spool"), fresh_path(s, "quarantine")
    rows = as_files(numbered(lines, "spool-", ".jsonl"))
    written = files.write_files(rows, folder)
    claimed = F.when(F.regexp_extract("name", r"(\d+)", 1).cast("int") % 3 == 1, "0").otherwise(F.col("sha256"))
    state = anchors.verified_files(files.contents(s, folder, "spool-*.jsonl").select(F.col("name").alias("path"), "content"), written.select(F.col("name").alias("path"), claimed.alias("sha256")))
    tampered = state.where("state = 'tampered'").select(F.col("path").alias("name"))
    evidence = tampered.join(written.select("name", "sha256"), "name")
    files.write_files(evidence.select(F.concat("name", F.lit(".tamper.json")).alias("name"), F.to_json(F.struct(F.lit("0").alias("claimed"), F.col("sha256").alias("found"))).alias("content")), away)
    files.move_files(evidence.select("name"), folder, away)
    named = lambda where, label: files.listing(s, where).select(F.lit(label).alias("folder"), "name")
    return named(folder, "spool").unionAll(named(away, "quarantine"))


@query("SELECT CASE WHEN id % 7 = 0 THEN '../' || id ELSE 'm/' || id || '.md' END AS name, CASE WHEN id % 7 = 0 THEN 'unsafe' WHEN id % 3 = 0 THEN 'moved' ELSE 'written' END AS outcome FROM memories")
def b20_write_and_archive(s, d):
    n = F.col("id").cast("string")
    rows = D.memories(s, d).select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("../"), n)).otherwise(F.concat(F.lit("m/"), n, F.lit(".md"))).alias("name"), "content")
    active, archive = fresh_path(s, "active"), fresh_path(s, "archive")
    written = files.write_files(rows, active).select("name", "outcome")
    moved = files.move_files(rows.where("id % 3 = 0").select("name"), active, archive).select("name", F.col("outcome").alias("then"))
    return written.join(moved, "name", "left").select("name", F.coalesce("then", "outcome").alias("outcome"))


BODY_SQL = "json_object('schemaVersion', 1, 'anchoredAt', {at}, 'tenantId', tenant_id, 'chainedRows', n, 'chainHead', head, 'prevAnchorHash', {prev})::VARCHAR"
_OLD = "json_object('schemaVersion', 1, 'anchoredAt', '2025-01-01T00:00:00.000Z', 'tenantId', tenant_id, 'chainedRows', CASE WHEN tenant_id = 't0' THEN n ELSE 1 END, 'chainHead', CASE WHEN tenant_id = 't0' THEN head ELSE 'x' END, 'prevAnchorHash', NULL)::VARCHAR"
_AT = "CASE WHEN tenant_id = 't0' THEN '2025-01-01T00:00:00.000Z' ELSE '2026-01-01T00:00:00.000Z' END"
_PREV = f"CASE WHEN tenant_id IN ('t1', 't2') THEN sha256({_OLD}) END"


@query(f", h AS (SELECT tenant_id, count(*) AS n, CAST(arg_max(id, seq) AS VARCHAR) AS head FROM audit_events GROUP BY tenant_id) SELECT tenant_id AS tenantId, n AS chainedRows, head AS chainHead, tenant_id <> 't0' AS appended, {_PREV} AS prevAnchorHash, sha256({BODY_SQL.format(at=_AT, prev=_PREV)}) AS anchorHash FROM h")
def b21_anchor_append(s, d):
    """Chains whose log is up to date (t0), behind (t1, t2) or empty (t3)."""
    heads = D.audit_events(s, d).groupBy(F.col("tenant_id").alias("tenantId")).agg(F.count(F.lit(1)).alias("chainedRows"), F.max_by("id", "seq").cast("string").alias("chainHead"))
    now = F.col("tenantId") == "t0"
    log = heads.where("tenantId in ('t0', 't1', 't2')").select(F.lit(1).alias("schemaVersion"), F.lit("2025-01-01T00:00:00.000Z").alias("anchoredAt"), "tenantId", F.when(now, F.col("chainedRows")).otherwise(1).alias("chainedRows"), F.when(now, F.col("chainHead")).otherwise("x").alias("chainHead"), F.lit(None).cast("string").alias("prevAnchorHash"), F.lit(0).alias("index"))
    made = anchors.appended(anchors.with_anchor_hash(log, "anchorHash"), heads, "2026-01-01T00:00:00.000Z")
    return made.select("tenantId", "chainedRows", "chainHead", "appended", "prevAnchorHash", "anchorHash")


@query(f"SELECT 'feedback-' || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl' AS name FROM memories WHERE status IN ('rejected', 'flagged') GROUP BY ALL ORDER BY name DESC LIMIT 10")
def b23_feedback_pruned(s, d):
    rows = records.find(D.memories(s, d), status=["rejected", "flagged"]).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("candidateId"), F.col("status").alias("outcome"))).alias("line"))
    folder, gone = fresh_path(s, "feedback"), fresh_path(s, "pruned")
    files.write_files(as_files(numbered(rows, "feedback-", ".jsonl")), folder)
    files.move_files(files.newest(s, folder, "feedback-*.jsonl", 10).where("not kept").select("name"), folder, gone)
    return files.listing(s, folder).select("name")


@query(", r AS (SELECT count(*) AS total, count(*) FILTER (lifecycle = 'active') AS active FROM memories) SELECT 0 AS pos, '# Records' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '- total: ' || total FROM r UNION ALL SELECT 3, '- active: ' || active FROM r UNION ALL SELECT 4, '- active_rate: ' || format('{:.1f}', 100.0 * active / total) || '%' FROM r")
def b24_rendered_report(s, d):
    row = D.memories(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lifecycle") == "active").alias("active"))
    return reports.rendered(row.withColumn("active_rate", reports.rate(F.col("active"), F.col("total"))), "Records")


@query("SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS term FROM memories) GROUP BY ALL")
def b25_postings(s, d):
    return search.postings(D.memories(s, d)).select("id", "term", "tf")


@query(plain="SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def b26_vector_upsert(s, d):
    rows = D.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("m1").alias("model"), F.size("embedding").alias("dims"), "embedding")
    base = rows.where("id % 2 = 0").withColumn("origin", F.lit("old"))
    made = index.upsert_vectors(base, rows.where("id % 3 = 0").withColumn("origin", F.lit("new")))
    wiped = index.upsert_vectors(base, rows.where("id % 3 = 0").withColumn("model", F.lit("m2")).withColumn("origin", F.lit("new")))
    return made.join(wiped.select("id").where("id % 3 <> 0"), "id", "left_anti").select("id", "origin")


@query(f"SELECT id // {LINES} AS file, sha256(json_object('schemaVersion', 1, 'generatedAt', '2026-01-01T00:00:00.000Z', 'entryCount', count(*), 'entries', list({{'id': CAST(id AS VARCHAR), 'reason': status}} ORDER BY id))::VARCHAR) AS manifest_hash FROM memories GROUP BY ALL")
def b28_exception_manifests(s, d):
    entries = D.memories(s, d).select(F.floor(F.col("id") / LINES).alias("file"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.col("status").alias("reason"))
    made = R.manifest_of(entries, "file", "2026-01-01T00:00:00.000Z")
    return made.select("file", F.get_json_object("manifest", "$.manifestHash").alias("manifest_hash"))


@query(plain="SELECT query_id, list_aggregate(list(doc_id ORDER BY rank), 'string_agg', ',') AS top FROM (SELECT CAST(doc_id % 20 AS BIGINT) AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3 GROUP BY query_id")
def b29_eval_artifact(s, d):
    from pyspark.sql import Window

    docs = D.read(s, d, "documents").withColumn("query_id", F.col("doc_id") % 20)
    best = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    path = fresh_path(s, "artifact")
    best.groupBy("query_id").agg(listed.alias("top")).write.json(path)
    return s.read.schema("query_id long, top array<string>").json(path).select("query_id", F.array_join("top", ",").alias("top"))


@query("SELECT unnest(['curated', 'decisions', 'guides', 'archive']) AS name, unnest(['created', 'exists', 'exists', 'created']) AS state")
def b30_collections(s, d):
    listed = D.memories(s, d).select(T.directory(F.lit("active"), F.lit("manual"), F.when(F.col("category") == "decision", "decision").otherwise("reference")).alias("name"))
    return index.collections_to_make(["curated", "decisions", "guides", "archive"], listed)


@query("SELECT check_name, json_object('check', check_name, 'passed', passed, 'n', n)::VARCHAR AS line FROM (SELECT status AS check_name, count(*) > 100 AS passed, count(*) AS n FROM memories GROUP BY status)")
def b31_evidence_rows(s, d):
    rows = D.memories(s, d).groupBy(F.col("status").alias("check_name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("check_name", F.to_json(F.struct(F.col("check_name").alias("check"), (F.col("n") > 100).alias("passed"), "n")).alias("line"))
