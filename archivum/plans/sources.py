"""Registered queries of sources (A): files are written, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions import ignore
from archivum.operators import index
from archivum.plans import domain as D
from archivum.plans.registry import query, ts
from archivum.sources import files, jsonl, markdown
from archivum.sources import records as R
from archivum.storage import fresh_path

#: Lines of a file that the queries write.
LINES = 50
SPOOL_NAME = f"'spool-' || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl'"


def numbered(rows, prefix: str, suffix: str):
    """Adds the file that a row's line goes to."""
    n = F.floor(F.col("id") / LINES)
    return rows.withColumn("name", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0"), F.lit(suffix)))


def as_files(rows):
    """(name, content) of rows with name, id and line, lines by id."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"])
    return rows.groupBy("name").agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("content"))


def spool(s, d):
    """A folder of spool files. Every third file has a line that isn't JSON;
    every seventh candidate has no content."""
    body = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("tenant_id").alias("tenantId"), "title", F.when(F.col("id") % 7 != 0, F.col("content")).alias("content"), "category"))
    rows = numbered(D.memories(s, d).select("id", body.alias("line")), "spool-", ".jsonl")
    rows = rows.withColumn("line", F.when((F.floor(F.col("id") / LINES) % 3 == 1) & (F.col("id") % LINES == 3), "{ broken").otherwise(F.col("line")))
    folder = fresh_path(s, "spool")
    files.write_files(as_files(rows).union(s.createDataFrame([("notes.txt", "x"), ("spool-000000.jsonl.manifest.json", "{}")], "name string, content string")), folder)
    return folder


@query("SELECT 'memories' AS name, count(*) AS n FROM memories UNION ALL SELECT 'audit_events', count(*) FROM audit_events UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'access_log', count(*) FROM access_log")
def a1_tables(s, d):
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in D.tables(s, d).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


@query("SELECT id, CAST(json_extract(details_json, '$.k') AS BIGINT) AS k FROM audit_events")
def a2_strict_rows(s, d):
    return R.strict(D.audit_events(s, d), "details_json", "k long", "id").select("id", "details_json.k")


@query("SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 9 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'not JSON' ELSE 'k ' || CAST(json_extract(details_json, '$.k') AS VARCHAR) END AS state FROM audit_events")
def a3_resilient_rows(s, d):
    rows = D.audit_events(s, d).withColumn("details_json", F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.substring("details_json", 1, 3)).otherwise(F.col("details_json")))
    good, bad = R.resilient(rows, "details_json", "k long", "id")
    return good.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("k "), F.col("details_json.k").cast("string")).alias("state")).unionAll(bad.select("id", F.col("reason").alias("state")))


@query("SELECT id FROM audit_events WHERE id % 7 > 0")
def a4_rows_without_bad(s, d):
    rows = D.audit_events(s, d).withColumn("details_json", F.when(F.col("id") % 7 == 0, "{").otherwise(F.col("details_json")))
    return R.resilient(rows, "details_json", "k long", "id")[0].select("id")


@query(f"SELECT DISTINCT {SPOOL_NAME} AS name FROM memories")
def a5_spool_files(s, d):
    return files.listing(s, spool(s, d), "spool-*.jsonl").select("name").orderBy("name")


@query(f"SELECT CAST(id AS VARCHAR) AS id, tenant_id, content FROM memories m WHERE id % 7 > 0 AND NOT ((id // {LINES}) % 3 = 1 AND EXISTS (SELECT 1 FROM memories b WHERE b.id // {LINES} = m.id // {LINES} AND b.id % {LINES} = 3))")
def a6_spool_lines(s, d):
    return jsonl.spool(s, spool(s, d)).select("id", F.col("tenantId").alias("tenant_id"), "content")


def vault(s, d):
    """Notes of five kinds of names, every tenth one blank."""
    k = F.col("id") % 5
    n = F.col("id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("notes/"), n, F.lit(".md"))).when(k == 1, F.concat(F.lit("notes/deep/"), n, F.lit(".MARKDOWN"))).when(k == 2, F.concat(F.lit(".obsidian/"), n, F.lit(".md"))).when(k == 3, F.concat(F.lit("notes/"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("more/"), n, F.lit(".mdx")))
    folder = fresh_path(s, "vault")
    files.write_files(D.memories(s, d).select(name.alias("name"), F.when(F.col("id") % 10 == 4, " \n ").otherwise(F.col("content")).alias("content")), folder)
    return folder


@query("SELECT id, content AS text FROM memories WHERE id % 5 IN (0, 1) OR (id % 5 = 4 AND id % 10 <> 4)")
def a8_vault_walk(s, d):
    return markdown.vault(s, vault(s, d)).select(F.regexp_extract("path", r"(\d+)\.[^.]*$", 1).cast("long").alias("id"), "text")


@query("SELECT count(*) AS n FROM memories WHERE id % 5 IN (0, 1, 4)")
def a9_vault_count(s, d):
    return s.createDataFrame([(markdown.vault_count(s, vault(s, d)),)], "n long")


@query(
    """SELECT CASE id % 3 WHEN 0 THEN 'decisions' WHEN 1 THEN 'debug' ELSE 'misc' END || '/' || id || '.md' AS path, CASE id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'troubleshooting' ELSE 'reference' END AS category,
    CASE WHEN id % 11 = 0 THEN '' ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END AS content, 'import' AS source, CASE WHEN id % 11 = 0 THEN 'failed' ELSE 'queued' END AS outcome FROM memories"""
)
def a10_glob_import(s, d):
    folder = F.when(F.col("id") % 3 == 0, "decisions").when(F.col("id") % 3 == 1, "debug").otherwise("misc")
    rows = D.memories(s, d).select(F.concat(folder, F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("name"), F.when(F.col("id") % 11 == 0, " \n").otherwise(F.concat(F.lit("  "), "content", F.lit("\n"))).alias("content"))
    base = fresh_path(s, "import")
    files.write_files(rows, base)
    return markdown.imported(s, f"{base}/*/*.md", base)


@query("SELECT id, tenant_id AS tenant, category, regexp_replace('# ' || title || chr(10) || chr(10) || content, '^\\s+|\\s+$', '', 'g') AS body FROM memories")
def a11_front_matter(s, d):
    made = D.memories(s, d).select("id", markdown.parsed(markdown.rendered(["tenant_id", "category"])).alias("p"))
    return made.select("id", F.try_element_at("p.front", F.lit("tenant_id")).alias("tenant"), F.try_element_at("p.front", F.lit("category")).alias("category"), "p.body")


@query(
    """SELECT id, CASE id % 8 WHEN 2 THEN 'boolean' WHEN 3 THEN 'list' WHEN 4 THEN 'number' WHEN 5 THEN 'number' ELSE 'string' END AS kind,
    CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'true' WHEN 3 THEN 'a|' || id || '|b c' WHEN 4 THEN CAST(id AS VARCHAR) WHEN 5 THEN '-1.5e3' WHEN 6 THEN 'quoted ' || id ELSE 'plain: ' || id END AS text,
    CASE id % 8 WHEN 4 THEN CAST(id AS DOUBLE) WHEN 5 THEN -1500.0 END::DOUBLE AS number FROM memories"""
)
def a12_coerced_values(s, d):
    k, n = F.col("id") % 8, F.col("id").cast("string")
    raw = F.when(k == 0, "null").when(k == 1, " ~ ").when(k == 2, "true").when(k == 3, F.concat(F.lit("[a, '"), n, F.lit("', \"b c\"]"))).when(k == 4, n).when(k == 5, "-1.5e3").when(k == 6, F.concat(F.lit('"quoted '), n, F.lit('"'))).otherwise(F.concat(F.lit("plain: "), n))
    return D.memories(s, d).select("id", markdown.coerced(raw).alias("v")).select("id", "v.*")


def access_lines(s, d):
    """Lines of a query log: good ones, ones without an actor, with mixed
    citations, of another event, and broken ones."""
    rows = D.read(s, d, "events").select("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), F.col("event_id").alias("n"))
    line = F.when(F.col("event_type") == "click", F.format_string('{"event":"query-access","actor":"%s","time":%d,"citations":["a","b"]}', "u", F.col("n") + 1000))
    line = line.when(F.col("event_type") == "view", F.format_string('{"event":"query-access","time":%d,"citations":[]}', "n"))
    line = line.when(F.col("event_type") == "signup", F.format_string('{"event":"query-access","actor":"%s","time":%d,"citations":[1,"x"]}', "u", F.col("n") + 1000))
    line = line.when(F.col("event_type") == "purchase", F.format_string('{"event":"other","actor":"%s","time":%d}', "u", "n"))
    return rows.select(F.coalesce(line, F.lit("{ broken")).alias("value"))


ACCESS_SQL = "SELECT 'u' || user_id AS actor, event_id + 1000 AS time, CASE event_type WHEN 'click' THEN 'a,b' ELSE 'x' END AS citations FROM events WHERE event_type IN ('click', 'signup')"


@query(plain=ACCESS_SQL)
def a13_access_lines(s, d):
    return R.query_access(access_lines(s, d)).select("actor", "time", F.array_join("citations", ",").alias("citations"))


@query(plain=ACCESS_SQL)
def a14_access_landing(s, d):
    """The log lines as they land in a folder, read by a stream that takes
    what is there and ends."""
    landing, out, state = (fresh_path(s, x) for x in ("landing", "access", "access-state"))
    access_lines(s, d).write.text(landing)
    lines = s.readStream.text(landing)
    made = R.query_access(lines).select("actor", "time", F.array_join("citations", ",").alias("citations"))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("actor string, time long, citations string").parquet(out)


ANCHOR = "schemaVersion int, anchoredAt string, tenantId string, chainedRows long, chainHead string"


@query("SELECT 1 AS schemaVersion, '2026-01-01T00:00:00.000Z' AS anchoredAt, tenant_id AS tenantId, count(*) AS chainedRows, CAST(arg_max(id, seq) AS VARCHAR) AS chainHead FROM audit_events GROUP BY tenant_id")
def a15_anchor_log(s, d):
    heads = D.audit_events(s, d).groupBy(F.col("tenant_id").alias("tenantId")).agg(F.count(F.lit(1)).alias("chainedRows"), F.max_by("id", "seq").cast("string").alias("chainHead"))
    path = fresh_path(s, "anchors")
    heads.select(F.lit(1).alias("schemaVersion"), F.lit("2026-01-01T00:00:00.000Z").alias("anchoredAt"), "tenantId", "chainedRows", "chainHead").write.json(path)
    return R.json_lines(s, path, ANCHOR).unionAll(R.json_lines(s, path + "-absent", ANCHOR))


@query(f"SELECT id // {LINES} AS file, (id // {LINES}) % 4 < 2 AS valid FROM memories GROUP BY ALL")
def a16_manifests(s, d):
    entries = D.memories(s, d).select(F.floor(F.col("id") / LINES).alias("file"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.col("status").alias("reason"))
    made = R.manifest_of(entries, "file", "2026-01-01T00:00:00.000Z")
    spoiled = F.when(F.col("file") % 4 == 2, F.regexp_replace("manifest", r'"entryCount":\d+', '"entryCount":1000')).when(F.col("file") % 4 == 3, F.regexp_replace("manifest", '"reason":"', '"reason":"x')).otherwise(F.col("manifest"))
    return R.verified_manifest(made.withColumn("manifest", spoiled), "manifest").select("file", "valid")


@query(
    plain="""SELECT page_id, CASE WHEN regexp_matches(base, '^1[^/]*\\.html$', 'i') THEN false WHEN regexp_matches(base, '^[^/]*\\.html$', 'i') THEN true ELSE regexp_matches(lower(url), '(^|/)(vendor|dist|build|coverage)/') END AS ignored
    FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)"""
)
def a17_ignore_overrides(s, d):
    rules = [*ignore.DEFAULTS, "# our own", "*.html", "!1*.html"]
    return D.read(s, d, "pages").select("page_id", ignore.ignored(F.regexp_replace("url", "^https?://", ""), rules).alias("ignored"))


@query(f"SELECT 'feedback-' || lpad(CAST(id // {LINES} AS VARCHAR), 6, '0') || '.jsonl' AS file, id FROM memories m WHERE id % {LINES} < 40 OR NOT EXISTS (SELECT 1 FROM memories b WHERE b.id // {LINES} = m.id // {LINES} AND b.id % {LINES} = 40) ORDER BY file DESC, id LIMIT 10")
def a18_recent_feedback(s, d):
    line = F.when(F.col("id") % LINES == 40, "oops").otherwise(F.format_string('{"candidateId":"%d","outcome":"rejected"}', "id"))
    folder = fresh_path(s, "feedback")
    files.write_files(as_files(numbered(D.memories(s, d).select("id", line.alias("line")), "feedback-", ".jsonl")), folder)
    recent = R.until_broken(files.lines(s, folder, "feedback-*.jsonl"), 10)
    return recent.select("file", F.get_json_object("value", "$.candidateId").cast("long").alias("id"))


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'remove' ELSE 'replace' END AS change FROM (SELECT id, id % 3 AS v FROM memories WHERE id % 5 > 0) a FULL JOIN (SELECT id, id % 2 AS v FROM memories WHERE id % 7 > 0) b ON a.id = b.id WHERE a.v IS DISTINCT FROM b.v")
def a19_index_sweep(s, d):
    rows = D.memories(s, d).select("id")
    return index.delta(rows.where("id % 5 > 0").withColumn("v", F.col("id") % 3), rows.where("id % 7 > 0").withColumn("v", F.col("id") % 2), "id", "v")


@query("SELECT id, coalesce(event, -1) AS event FROM memories m LEFT JOIN (SELECT memory_id, arg_min(id, (id // 50, id)) AS event FROM audit_events WHERE action = 'promoted' GROUP BY memory_id) e ON e.memory_id = m.id")
def a20_first_trace(s, d):
    rows = D.audit_events(s, d).where("action = 'promoted'")
    events = rows.select(F.floor(F.col("id") / LINES).alias("file"), "id", F.concat(F.lit("out/"), F.col("memory_id").cast("string")).alias("output"))
    wanted = D.memories(s, d).select("id", F.concat(F.lit("out/"), F.col("id").cast("string")).alias("path"))
    return R.first_trace(wanted, events).select("id", F.coalesce("event", F.lit(-1)).alias("event"))


@query(
    f"""SELECT id, regexp_replace(md5(CAST(id AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS uuid
    FROM memories m WHERE id % 10 <> 9 AND NOT ((id // {LINES}) % 4 = 3 AND EXISTS (SELECT 1 FROM memories b WHERE b.id // {LINES} = m.id // {LINES} AND b.id % {LINES} = 5))"""
)
def a21_ids_files(s, d):
    uuid = F.regexp_replace(F.md5(F.col("id").cast("string").cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    line = F.when((F.floor(F.col("id") / LINES) % 4 == 3) & (F.col("id") % LINES == 5), "oops").when(F.col("id") % 10 == 9, "# a comment").otherwise(F.upper(uuid))
    rows = D.memories(s, d).select("id", uuid.alias("uuid"), line.alias("line"))
    folder = fresh_path(s, "ids")
    files.write_files(as_files(numbered(rows, "ids-", ".txt")), folder)
    found, _ = R.ids_of_files(files.lines(s, folder, "ids-*.txt"))
    return rows.select("id", "uuid").join(found.select(F.col("id").alias("uuid")), "uuid", "left_semi").select("id", "uuid")


@query(
    """SELECT 't' || id AS token, tenant_id AS actor, CASE id % 3 WHEN 0 THEN 'admin' ELSE 'member' END AS role,
    CASE WHEN id % 7 = 0 THEN 'revoked' WHEN updated_at <= TIMESTAMP '2025-10-01 00:00:00' THEN 'expired' ELSE 'valid' END AS state FROM memories WHERE id % 5 > 0"""
)
def a22_tokens(s, d):
    role = F.when(F.col("id") % 3 == 0, "admin").when(F.col("id") % 3 == 1, "member").otherwise("owner")
    rows = D.memories(s, d).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("token"), F.col("tenant_id").alias("actor"), role.alias("role"), F.col("updated_at").alias("expires"), (F.col("id") % 7 == 0).alias("revoked"))
    return R.tokens(rows, ts("2025-10-01 00:00:00"))


@query("SELECT 'w/' || id AS name, CASE id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'size-mismatch' WHEN 2 THEN 'hash-mismatch' ELSE 'ok' END AS state FROM memories")
def a23_pinned_files(s, d):
    rows = D.memories(s, d).select(F.concat(F.lit("w/"), F.col("id").cast("string")).alias("name"), "id", "content_hash", F.col("content").cast("binary").alias("content"))
    size = F.length("content").cast("long")
    manifest = rows.select("name", F.when(F.col("id") % 4 == 1, size + 1).otherwise(size).alias("bytes"), F.when(F.col("id") % 4 == 2, "0").otherwise(F.col("content_hash")).alias("sha256"))
    return files.pinned(manifest, rows.where("id % 4 > 0").select("name", "content"))


@query("SELECT id, 'c/' || id || '.md' AS file, CASE WHEN id % 4 = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM memories WHERE id % 4 IN (0, 2)")
def a24_search_output(s, d):
    k = F.col("id") % 4
    out = F.when(k == 0, F.format_string('[{"file":"c/%d.md","score":0.5},{"score":0.9}]', "id")).when(k == 1, "no results").when(k == 2, F.format_string('[{"file":"c/%d.md","score":"NaN"}]', "id")).otherwise("[]")
    return R.hits(D.memories(s, d).select("id", out.alias("output")), "output")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN category ELSE 'convention' END AS category, CASE WHEN id % 3 = 0 THEN trust_level ELSE 'medium' END AS trust_level FROM memories")
def a25_case_defaults(s, d):
    rows = D.memories(s, d).select("id", F.when(F.col("id") % 2 == 0, F.col("category")).alias("category"), F.when(F.col("id") % 3 == 0, F.col("trust_level")).alias("trust_level"))
    return R.with_defaults(rows, {"category": "convention", "trust_level": "medium"})


@query(
    plain="""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
    m AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS folder FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/(?:en|de))/', 1) FROM p WHERE regexp_matches(path, '^[^/]+/(en|de)/'))
    SELECT path, arg_max(folder, length(folder)) AS folder, upper(arg_max(folder, length(folder))) AS name FROM p JOIN m ON starts_with(path, folder || '/') GROUP BY path"""
)
def a27_nearest_package(s, d):
    paths = D.read(s, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    hosts = paths.select(F.substring_index("path", "/", 1).alias("folder"))
    packages = paths.select(F.regexp_extract("path", "^([^/]+/(?:en|de))/", 1).alias("folder")).where("folder <> ''")
    manifests = hosts.unionAll(packages).distinct().withColumn("name", F.upper("folder"))
    return R.nearest_package(paths, manifests)


@query(plain="SELECT CAST(n_nationkey AS BIGINT) AS version, n_name AS name FROM nation WHERE n_nationkey > (SELECT coalesce(max(r_regionkey), 0) FROM region)")
def a28_pending_migrations(s, d):
    migrations = D.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("version"), F.col("n_name").alias("name"))
    return R.pending(migrations, D.read(s, d, "region").select(F.col("r_regionkey").cast("long").alias("version")))
