"""Registered queries of curation, promotion, merges and lifecycle (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions import hashing
from archivum.operators import curation, index, policy, provenance, records
from archivum.plans import domain as D
from archivum.plans import sqltext as S
from archivum.plans.registry import STALE, query, ts
from archivum.plans.scalars import NOISE_SQL, WITH_PLANTS, planted
from archivum.plans.sources import LINES, as_files, numbered
from archivum.sources import files, jsonl
from archivum.storage import fresh_path

NS, KEY = D.NAMESPACE, b"a key of the tests"
ODD, EVEN = "id % 2 = 1", "id % 2 = 0"


@query(WITH_PLANTS + f"SELECT id, CASE WHEN id % 6 = 0 THEN 'unknown' ELSE tenant_id END AS tenant_id, sha256(content) AS content_hash, {S.has_secret('content')} AS secrets_detected, 'inbox' AS status FROM planted")
def k1_captured(s, d):
    rows = planted(s, d).withColumn("tenant_id", F.when(F.col("id") % 6 > 0, F.col("tenant_id")))
    return curation.captured(rows).select("id", "tenant_id", "content_hash", "secrets_detected", "status")


@query(f"SELECT id, 'spool-' || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl' AS file FROM memories WHERE id % 7 > 0")
def k2_proposed(s, d):
    """Proposals go to the spool and nowhere else; the spool is read back."""
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 > 0, F.col("content")).alias("content")))
    folder = fresh_path(s, "proposed")
    files.write_files(as_files(numbered(D.memories(s, d).select("id", line.alias("line")), "spool-", ".jsonl")), folder)
    return jsonl.spool(s, folder).select(F.col("id").cast("long").alias("id"), "file")


@query(f"SELECT CAST(id AS VARCHAR) AS id, CASE WHEN (id // {LINES}) % 3 = 1 THEN 'tampered' WHEN id % 3 = 0 THEN 'known' WHEN {S.disclosed('content')} IS NOT NULL THEN 'rejected' ELSE 'ingested' END AS outcome FROM memories")
def k3_spool_ingest(s, d):
    """Files whose manifest has another hash stay out; of the others, ids that
    are known are passed over, and what discloses something is rejected."""
    rows = D.memories(s, d)
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("tenant_id").alias("tenantId"), "title", "content"))
    folder = fresh_path(s, "spool")
    written = files.write_files(as_files(numbered(rows.select("id", line.alias("line")), "spool-", ".jsonl")), folder)
    claimed = F.when(F.regexp_extract("name", r"(\d+)", 1).cast("int") % 3 == 1, "0").otherwise(F.col("sha256"))
    return curation.ingested(s, folder, written.select(F.col("name").alias("path"), claimed.alias("sha256")), rows.where("id % 3 = 0").select(F.col("id").cast("string").alias("id")))


@query("SELECT id, 'agent-7' AS author, 'untrusted' AS trust_level, 'de' AS tenant_id, 'inbox' AS status FROM memories")
def k4_intake_overrides(s, d):
    return curation.overridden(D.memories(s, d), "agent-7", "member", ["de"]).select("id", "author", "trust_level", "tenant_id", "status")


@query(
    WITH_PLANTS
    + f"""SELECT p.id, CASE WHEN trim(title) = '' OR id % 11 = 0 THEN 'invalid' WHEN source NOT IN ('manual', 'mcp', 'import') THEN 'channel' WHEN {S.disclosed('title || chr(10) || content')} IS NOT NULL THEN 'disclosure'
    WHEN id % 2 = 0 OR content_hash IN (SELECT content_hash FROM memories m WHERE m.id % 2 = 0 AND m.tenant_id = p.tenant_id) THEN 'already_exists' ELSE 'created' END AS outcome FROM planted p"""
)
def k5_api_intake(s, d):
    rows = planted(s, d).withColumn("title", F.when(F.col("id") % 11 > 0, F.col("title")))
    return curation.intake(rows, D.memories(s, d).where(EVEN), ["manual", "mcp", "import"])


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'unattested' WHEN 1 THEN 'origin_token_invalid' ELSE 'attested' END AS verdict, CASE id % 4 WHEN 0 THEN 'unattested' ELSE 'origin_token_unverifiable' END AS keyless FROM memories")
def k6_origin_gate(s, d):
    rows = D.memories(s, d).withColumn("captured_at", F.lit("2026-01-01T00:00:00.000Z"))
    rows = rows.withColumn("token_hmac", F.when(F.col("id") % 4 == 1, "0").when(F.col("id") % 4 > 1, curation.origin_token(KEY)))
    return rows.select("id", curation.origin_verdict(KEY).alias("verdict"), curation.origin_verdict(None).alias("keyless"))


@query(f"SELECT id, CASE WHEN source IN ('import', 'bulk_import') THEN CASE WHEN id % 6 = 0 THEN 'path' ELSE {NOISE_SQL} END END AS why FROM memories")
def k7_import_exclusion(s, d):
    path = F.when(F.col("id") % 6 == 0, "a/node_modules/b.md").otherwise("a/b.md")
    return D.memories(s, d).select("id", curation.excluded(path).alias("why"))


@query(S.JUDGED + "SELECT j.id, CASE WHEN content_hash IN (SELECT content_hash FROM memories m WHERE m.id % 2 = 0 AND m.tenant_id = j.tenant_id) THEN 'duplicate' WHEN outcome = 'approved' THEN 'promoted' ELSE outcome END AS result FROM judged j WHERE id % 2 = 1 AND id % 10 = 1")
def k8_process_one(s, d):
    """Records taken one at a time: each against what is stored alone."""
    rows = D.memories(s, d)
    one = rows.where("id % 2 = 1 and id % 10 = 1")
    return curation.processed_alone(one, rows.where(EVEN), policy.recommended()).select("id", "result")


@query(S.JUDGED + S.BATCH + "SELECT id, result FROM batch")
def k9_process_batch(s, d):
    rows = D.memories(s, d)
    return curation.processed(rows.where(ODD), rows.where(EVEN), policy.recommended()).select("id", "result")


@query(S.JUDGED + S.BATCH + f"SELECT {S.uuid5(NS, chr(39) + 'deleted' + chr(39) + ' || chr(0) || id')} AS event_id, 'deleted' AS action, CAST(id AS VARCHAR) AS memory_id, tenant_id FROM batch WHERE result IN ('rejected', 'flagged')")
def k10_rejected(s, d):
    rows = D.memories(s, d)
    return curation.rejected(curation.processed(rows.where(ODD), rows.where(EVEN), policy.recommended()), NS)


MADE_ID = S.uuid5(NS, "tenant_id || chr(0) || id || chr(0) || content_hash")
INBOX = "id % 2 = 1"


def promotion(s, d):
    rows = D.memories(s, d)
    return curation.promoted(rows.where(INBOX), rows, NS, D.NOW)


@query(f"SELECT {MADE_ID} AS id, id AS candidate_id, tenant_id, {S.sensitivity('content')} AS sensitivity, 'active' AS lifecycle, content_hash FROM memories WHERE {INBOX}")
def k11_promoted(s, d):
    return promotion(s, d)["memories"].select("id", "candidate_id", "tenant_id", "sensitivity", "lifecycle", "content_hash")


@query(S.titles() + f"SELECT {MADE_ID} AS source_id, CAST(right_id AS VARCHAR) AS target_id, 'supersedes' AS link_type, round(similarity, 9) AS weight FROM best JOIN memories m ON m.id = left_id")
def k11_links(s, d):
    return promotion(s, d)["links"].where("link_type = 'supersedes'").withColumn("weight", F.round("weight", 9))


@query(
    S.titles()
    + f""", made AS (SELECT {MADE_ID} AS id, tenant_id FROM memories WHERE {INBOX}), gone AS (SELECT DISTINCT b.right_id AS id, m.tenant_id FROM best b JOIN memories m ON m.id = b.left_id)
    SELECT {S.uuid5(NS, "'promoted' || chr(0) || id")} AS event_id, 'promoted' AS action, id AS memory_id, tenant_id FROM made
    UNION ALL SELECT {S.uuid5(NS, "'superseded' || chr(0) || id")}, 'superseded', CAST(id AS VARCHAR), tenant_id FROM gone"""
)
def k11_events(s, d):
    return promotion(s, d)["events"]


@query(S.JUDGED + f"SELECT id, CASE WHEN status <> 'inbox' THEN 'not_inbox' WHEN {S.disclosed('content')} IS NOT NULL THEN 'disclosure' WHEN content_hash IN (SELECT content_hash FROM memories m WHERE m.id % 2 = 0 AND m.tenant_id = j.tenant_id) THEN 'duplicate' WHEN outcome = 'approved' THEN 'promoted' ELSE outcome END AS outcome FROM judged j WHERE id % 2 = 1")
def k12_promote_by_request(s, d):
    rows = D.memories(s, d)
    return curation.promotion_outcomes(rows.where(ODD), rows.where(EVEN), policy.recommended())


@query("SELECT id, CASE WHEN status = 'inbox' THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'inbox' THEN 'deleted' END AS action FROM memories")
def k13_reject_by_request(s, d):
    inbox = F.col("status") == "inbox"
    return D.memories(s, d).select("id", F.when(inbox, "rejected").otherwise(F.col("status")).alias("status"), F.when(inbox, "deleted").alias("action"))


ALLOWED_SQL = " OR ".join(f"(lifecycle = '{a}' AND target = '{b}')" for a, b in D.TRANSITIONS)


@query(
    f""", q AS (SELECT id + CASE WHEN id % 13 = 0 THEN 100000000 ELSE 0 END AS id, ['active', 'deprecated', 'superseded', 'archived'][CAST(id % 4 AS INTEGER) + 1] AS target, CASE WHEN id % 3 = 0 THEN 1 END AS successor FROM memories)
    SELECT q.id, CASE WHEN m.id IS NULL THEN 'missing' WHEN target = 'superseded' AND successor IS NULL THEN 'needs_successor' WHEN lifecycle = target THEN 'unchanged' WHEN {ALLOWED_SQL} THEN 'allowed' ELSE 'illegal' END AS outcome,
    CASE WHEN m.id IS NOT NULL AND NOT (target = 'superseded' AND successor IS NULL) AND lifecycle <> target AND ({ALLOWED_SQL}) THEN CASE target WHEN 'active' THEN 'promoted' WHEN 'deprecated' THEN 'demoted' ELSE target END END AS action FROM q LEFT JOIN memories m ON m.id = q.id"""
)
def k14_transitions(s, d):
    rows = D.memories(s, d)
    target = F.element_at(F.array(*map(F.lit, D.LIFECYCLES)), (F.col("id") % 4 + 1).cast("int"))
    asked = rows.select((F.col("id") + F.when(F.col("id") % 13 == 0, 100_000_000).otherwise(0)).alias("id"), target.alias("target"), F.when(F.col("id") % 3 == 0, 1).alias("superseded_by"))
    return curation.transitioned(rows, asked)


@query("SELECT id, CASE WHEN id % 5 > 0 AND category <> 'decision' THEN 'decision' ELSE category END AS category, CASE WHEN id % 5 = 0 THEN 'unknown' WHEN category = 'decision' THEN 'same' ELSE 'recategorized' END AS outcome FROM memories")
def k15_recategorized(s, d):
    rows = D.memories(s, d)
    return curation.recategorized(rows, rows.select("id", F.when(F.col("id") % 5 == 0, "bogus").otherwise("decision").alias("wanted")))


RULES = [("old-words", ["the", "und", "idiot"], True), ("old-name", ["and"], False)]
_FOUND = "list_filter([{0}], lambda x: x IS NOT NULL)"


def _rule_sql(tokens: list[str]) -> str:
    return _FOUND.format(", ".join(f"CASE WHEN regexp_matches(lower(title || chr(10) || content), '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN '{t}' END" for t in tokens))


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS rule, list_aggregate({_rule_sql(ts_)}, 'string_agg', ',') AS matched FROM memories WHERE len({_rule_sql(ts_)}) > 0" + (f" AND NOT {S.historical('title || chr(10) || content')}" if exempt else "") for n, ts_, exempt in RULES))
def k18_fact_staleness(s, d):
    return curation.staleness(D.memories(s, d), RULES).select("id", "rule", F.array_join("matched", ",").alias("matched"))


@query("SELECT n.id, CASE WHEN n.id % 8 = 0 THEN 'skipped_empty' WHEN min(CASE WHEN n.id % 8 > 0 THEN n.id END) OVER (PARTITION BY content_hash) < n.id THEN 'batch' WHEN content_hash IN (SELECT content_hash FROM memories WHERE id % 3 = 0) THEN 'curated' WHEN content_hash IN (SELECT content_hash FROM memories WHERE id % 3 = 1) THEN 'candidate' ELSE 'created' END AS outcome FROM memories n WHERE n.id % 3 = 2 OR n.id % 8 = 0 OR n.id % 10 = 0")
def k19_vault_preview(s, d):
    rows = D.memories(s, d)
    notes = rows.where("id % 3 = 2 or id % 8 = 0 or id % 10 = 0").select("id", F.when(F.col("id") % 8 == 0, " \n").otherwise(F.col("content")).alias("content"))
    return curation.vault_preview(notes, rows.where("id % 3 = 0"), rows.where("id % 3 = 1"))


@query("SELECT 'candidates' AS part, count(*) FILTER (id % 5 <> 2) AS n FROM memories UNION ALL SELECT 'links', count(*) FILTER (source_id % 5 <> 2) FROM links UNION ALL SELECT 'rolled_back', 1")
def k19_vault_rollback(s, d):
    batch = lambda c: F.concat(F.lit("b"), (F.col(c) % 5).cast("string"))
    batches = s.createDataFrame([(f"b{k}", "completed") for k in range(5)], "id string, status string")
    left = curation.rolled_back(D.memories(s, d).withColumn("batch_id", batch("id")), D.links(s, d).withColumn("batch_id", batch("source_id")), batches, "b2")
    n = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n(left["candidates"], "candidates").unionAll(n(left["links"], "links")).unionAll(n(left["batches"].where("status = 'rolled_back'"), "rolled_back"))


ORIGIN_ID = S.uuid5(NS, "tenant_id || chr(0) || id || chr(0) || sha256(content)")
MERGED_SQL = (
    WITH_PLANTS
    + f""", clones AS (SELECT CASE WHEN id % 17 = 0 THEN '0' || substr({ORIGIN_ID}, 2) ELSE {ORIGIN_ID} END AS id, {ORIGIN_ID} AS right_id, id AS origin_id, tenant_id, title, content, content_hash,
      CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS side FROM planted WHERE id % 2 = 0 OR id % 3 = 0),
    clean AS (SELECT *, {S.disclosed('title || chr(10) || content')} AS found FROM clones),
    merged AS (SELECT *, CASE WHEN id <> right_id THEN 'bad_id' WHEN found IS NOT NULL THEN found WHEN min(CASE WHEN id = right_id AND found IS NULL THEN id END) OVER (PARTITION BY sha256(content)) < id THEN 'duplicate' ELSE 'promoted' END AS outcome FROM clean)
    """
)


def clones(s, d):
    """Two clones of the records under derived ids; some ids are wrong."""
    made = hashing.derived_id(NS, F.col("tenant_id"), F.col("id"), hashing.content_hash(F.col("content")))
    rows = planted(s, d).select(F.when(F.col("id") % 17 == 0, F.concat(F.lit("0"), F.substring(made, 2, 35))).otherwise(made).alias("id"), F.col("id").alias("origin_id"), "tenant_id", "title", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "trust_level")
    return [rows.where("origin_id % 2 = 0"), rows.where("origin_id % 3 = 0")]


@query(MERGED_SQL + "SELECT id, side, 'untrusted' AS trust_level, outcome FROM merged")
def k20_merge_gate(s, d):
    return curation.merged(clones(s, d), NS).select("id", "side", "trust_level", "outcome")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 0 WHEN id % 3 = 0 THEN 1 ELSE 2 END AS side FROM memories WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0")
def k21_fold_of_clones(s, d):
    rows = D.memories(s, d).select("id", "content_hash")
    return curation.union_of_clones([rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), rows.where("id % 5 = 0")]).select("id", "side")


@query(MERGED_SQL + "SELECT id, TIMESTAMP '2026-01-01 00:00:00' + to_milliseconds(row_number() OVER (ORDER BY id) - 1) AS at FROM merged WHERE outcome = 'promoted' AND tenant_id = 'en'")
def k22_merge_run(s, d):
    """One tenant of both clones, promoted under the clock of the merge."""
    own = [c.where("tenant_id = 'en'") for c in clones(s, d)]
    promoted = curation.merged(own, NS).where("outcome = 'promoted'").select("id")
    return curation.clocked(promoted, "2026-01-01 00:00:00")


@query(
    f""", r AS (SELECT memory_id, arg_min(id, seq) AS receipt FROM audit_events WHERE action = 'promoted' GROUP BY memory_id)
    SELECT m.id, CASE WHEN m.id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS memory_id_derived, CASE WHEN r.receipt IS NULL THEN 'FAIL' ELSE 'PASS' END AS receipt, CASE WHEN m.id % 5 = 0 THEN 'UNVERIFIABLE' ELSE 'PASS' END AS candidate,
    CASE WHEN m.id % 5 = 0 OR m.id % 3 = 0 THEN 'UNVERIFIABLE' WHEN m.id % 11 = 1 THEN 'FAIL' ELSE 'PASS' END AS manifest, CASE WHEN m.id % 5 = 0 OR m.id % 4 = 0 THEN 'UNVERIFIABLE' ELSE 'PASS' END AS trace,
    CASE WHEN m.id % 7 = 0 OR r.receipt IS NULL OR (m.id % 5 > 0 AND m.id % 3 > 0 AND m.id % 11 = 1) THEN 1 WHEN m.id % 5 = 0 OR m.id % 3 = 0 OR m.id % 4 = 0 THEN 3 ELSE 0 END AS code
    FROM memories m LEFT JOIN r ON r.memory_id = m.id"""
)
def k23_provenance_walk(s, d):
    return provenance.walk(*provenance_tables(s, d), NS).select("id", "memory_id_derived", "receipt", "candidate", "manifest", "trace", "code")


def provenance_tables(s, d):
    """Records whose chains of evidence break in several ways."""
    rows = D.memories(s, d)
    own = hashing.derived_id(NS, F.col("tenant_id"), F.col("id"), F.col("content_hash"))
    made = rows.select("id", F.when(F.col("id") % 7 == 0, "0").otherwise(own).alias("derived_id"), F.col("id").alias("candidate_id"), "tenant_id", "content_hash")
    candidates = rows.where("id % 5 > 0").select(F.col("id").alias("candidate_id"), F.format_string("f%d", F.floor(F.col("id") / LINES)).alias("file"), F.col("id").cast("string").alias("trace_path"))
    manifests = candidates.where("candidate_id % 3 > 0").select("candidate_id", (F.col("candidate_id") % 11 != 1).alias("intact"))
    traces = candidates.where("candidate_id % 4 > 0").select(F.col("trace_path").alias("output"))
    return made, D.audit_events(s, d), candidates, manifests, traces


@query(
    S.JUDGED
    + S.BATCH
    + f"""SELECT 'ingested' AS step, count(*) AS n FROM batch UNION ALL SELECT 'promoted', count(*) FILTER (result = 'promoted') FROM batch UNION ALL SELECT 'swept', count(*) FROM memories WHERE id % 2 = 0 AND lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}'
    UNION ALL SELECT 'exported', (SELECT count(*) FROM memories WHERE id % 2 = 0 AND sensitivity IN ('public', 'internal')) + (SELECT count(*) FROM batch WHERE result = 'promoted' AND sensitivity IN ('public', 'internal')) UNION ALL SELECT 'indexed', (SELECT count(*) FROM batch WHERE result = 'promoted')"""
)
def k25_cycle(s, d):
    """Ingest, curate, sweep, export, index: what each step had to do."""
    rows = D.memories(s, d)
    stored, batch = rows.where(EVEN), rows.where(ODD)
    judged = curation.processed(batch, stored, policy.recommended())
    fresh = judged.where("result = 'promoted'").select(*stored.columns)
    after = stored.unionByName(fresh)
    listed = after.select("id", "content_hash")
    steps = [("ingested", batch), ("promoted", fresh), ("swept", records.stale(stored, ts(STALE))), ("exported", records.exportable(after)), ("indexed", index.delta(listed, stored.select("id", "content_hash"), "id", "content_hash"))]
    return index.health(dict(steps)).select(F.col("part").alias("step"), "n")
