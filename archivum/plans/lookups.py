"""Registered queries of filters, joins, aggregates, windows, order and sets
(C to H) beyond the first ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.functions import ignore
from archivum.functions import text as T
from archivum.operators import audit, graph, records, reports, search
from archivum.plans import domain as D
from archivum.plans import sqltext as S
from archivum.plans.registry import QUERY, STALE, query, ts


def counted():
    return F.count(F.lit(1)).alias("n")


# C.


@query("SELECT c.id, min(m.id) AS found FROM memories c JOIN memories m ON m.content_hash = c.content_hash AND m.tenant_id = c.tenant_id GROUP BY c.id")
def c4_by_hash_and_tenant(s, d):
    rows = D.memories(s, d).select("id", "content_hash", "tenant_id")
    least = rows.groupBy("content_hash", "tenant_id").agg(F.min("id").alias("found"))
    return rows.join(least, ["content_hash", "tenant_id"]).select("id", "found")


@query(plain="SELECT count(*) FILTER (page_id % 3 > 0 AND regexp_extract(url, '^https?://([^/]+)', 1) = (SELECT min(regexp_extract(url, '^https?://([^/]+)', 1)) FROM pages)) AS kept, count(*) FILTER (page_id % 3 > 0 AND regexp_extract(url, '^https?://([^/]+)', 1) <> (SELECT min(regexp_extract(url, '^https?://([^/]+)', 1)) FROM pages)) AS skipped, count(*) FILTER (page_id % 3 = 0) AS unscoped FROM pages")
def c20_repo_scope(s, d):
    rows = D.read(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id")
    wanted = rows.agg(F.min("host")).first()[0]
    named = rows.select(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit(" https://"), F.upper("host"), F.lit(".git"))).alias("repo_url"))
    return records.repo_scope(named, f"https://{wanted}")


@query("SELECT m.id, m.tenant_id FROM memories m WHERE m.tenant_id IN ('en', 'fr')")
def c21_tenant_visibility(s, d):
    return records.visible_to(D.memories(s, d).select("id", "tenant_id"), ["en", "fr"])


# D.


@query(plain="SELECT query_id, id, rank, label FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def d2_vector_metadata(s, d):
    rows = D.read(s, d, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "collection", F.col("vector").alias("query"))
    near = search.knn(vectors, queries, 5)
    return near.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "id", "rank", "label")


WALK_SQL = """, walk AS (SELECT target_id AS id, max(weight) AS weight, 1 AS depth FROM links WHERE source_id = 7 GROUP BY 1),
    two AS (SELECT l.target_id AS id, max(l.weight) AS weight, 2 AS depth FROM (SELECT DISTINCT id FROM walk) w JOIN links l ON l.source_id = w.id GROUP BY 1),
    three AS (SELECT l.target_id AS id, max(l.weight) AS weight, 3 AS depth FROM (SELECT DISTINCT id FROM two) w JOIN links l ON l.source_id = w.id GROUP BY 1),
    steps AS (SELECT * FROM walk UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) """


@query(WALK_SQL + "SELECT depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM steps WHERE id <> 7 GROUP BY id) GROUP BY depth")
def d3_edge_self_join(s, d):
    return graph.traverse(D.links(s, d), 7, 3).groupBy("depth").agg(counted())


@query(WALK_SQL + "SELECT id, depth, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, weight DESC) AS n FROM steps WHERE id <> 7) WHERE n = 1")
def f1_first_path(s, d):
    return graph.traverse(D.links(s, d), 7, 3)


@query("SELECT depth, count(*) AS n FROM (SELECT target_id, 1 AS depth FROM links WHERE source_id = 7 UNION ALL SELECT b.target_id, 2 FROM links a JOIN links b ON b.source_id = a.target_id WHERE a.source_id = 7) GROUP BY depth")
def h2_recursive_bag(s, d):
    """Paths, not nodes: every way to a node counts."""
    return graph.paths(D.links(s, d), 7, 2).groupBy("depth").agg(F.sum("n").alias("n"))


@query(plain="SELECT e.vec_id FROM embeddings e LEFT JOIN documents m ON m.doc_id = e.vec_id WHERE m.doc_id IS NULL OR m.doc_id % 4 < 2")
def d10_sensitive_hits(s, d):
    hits = D.read(s, d, "embeddings").select("vec_id", F.col("vec_id").alias("id"))
    return records.visible(hits.join(D.memories(s, d).select("id", "sensitivity"), "id", "left")).select("vec_id")


FUSED_SQL = """, a AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS rank FROM memories QUALIFY rank <= 50), b AS (SELECT id, row_number() OVER (ORDER BY length(content) DESC, id) AS rank FROM memories QUALIFY rank <= 50),
    fused AS (SELECT id, sum(1 / (60 + rank)) AS score, min(rank) AS best_rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) """


def lists(s, d):
    """The fifty newest and the fifty longest records, ranked."""
    rows = D.memories(s, d).withColumn("n", F.length("content"))

    def ranked(*order):
        top = rows.orderBy(*order).limit(50).select("id", "updated_at", "n")
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # 50 rows

    return ranked(F.desc("updated_at"), "id"), ranked(F.desc("n"), "id")


@query(FUSED_SQL + "SELECT coalesce(a.id, b.id) AS id, coalesce(a.rank, 0) AS newest, coalesce(b.rank, 0) AS longest FROM a FULL JOIN b ON a.id = b.id")
def d11_rank_lists(s, d):
    one, two = lists(s, d)
    both = one.select("id", F.col("rank").alias("a")).join(two.select("id", F.col("rank").alias("b")), "id", "full_outer")
    return both.select("id", F.coalesce("a", F.lit(0)).alias("newest"), F.coalesce("b", F.lit(0)).alias("longest"))


@query(FUSED_SQL + "SELECT id, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, best_rank, id) AS INTEGER) AS place FROM fused")
def g5_fused_order(s, d):
    fused = search.fuse(*lists(s, d)).withColumn("score", F.round("score", 12))
    return fused.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "best_rank", "id")).alias("place"))  # 100 rows


@query(FUSED_SQL + "SELECT id FROM (SELECT id, updated_at FROM fused JOIN memories USING (id) ORDER BY round(score, 12) DESC, best_rank, id LIMIT 20) ORDER BY updated_at DESC, id LIMIT 8")
def g6_rerank_top(s, d):
    """A window of 20 of the fused list, reranked (here by age), cut to 8."""
    fused = search.fuse(*lists(s, d)).withColumn("score", F.round("score", 12))
    window = fused.orderBy(F.desc("score"), "best_rank", "id").limit(20)
    return window.join(D.memories(s, d).select("id", "updated_at"), "id").orderBy(F.desc("updated_at"), "id").limit(8).select("id")


@query("SELECT a.id AS source_id, b.id AS target_id FROM memories a JOIN memories b ON lower(b.title) = lower(a.title) AND b.tenant_id = a.tenant_id AND a.id <> b.id WHERE a.id % 10 = 0 AND b.id % 2 = 1")
def d12_wiki_link_targets(s, d):
    """Every tenth record links, by its own title, to the odd records so named.
    Titles are percent-encoded in the links, as they may hold what ends one."""
    rows = D.memories(s, d)
    linking = rows.where("id % 10 = 0").select("id", "tenant_id", F.concat(F.lit("[[title:"), F.url_encode("title"), F.lit("]]")).alias("content"))
    links = linking.select("id", "tenant_id", F.explode(T.wiki_links(F.col("content"))).alias("link"))
    slugs = links.select("id", "tenant_id", F.url_decode(F.substring_index("link", ":", -1)).alias("slug"))
    named = rows.where("id % 2 = 1").select(F.col("id").alias("target_id"), "tenant_id", F.lower("title").alias("slug"))
    return slugs.withColumn("slug", F.lower("slug")).join(named, ["tenant_id", "slug"]).where("id <> target_id").select(F.col("id").alias("source_id"), "target_id").distinct()


@query("SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS receipts, coalesce(first, 'none') AS first_receipt, length(content) = 0 AS empty FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n, arg_min(action, seq) AS first FROM audit_events GROUP BY memory_id) e ON e.memory_id = m.id")
def d16_receipts(s, d):
    events = D.audit_events(s, d).groupBy(F.col("memory_id").alias("id")).agg(counted(), F.min_by("action", "seq").alias("first"))
    joined = D.memories(s, d).join(events, "id", "left")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("receipts"), F.coalesce("first", F.lit("none")).alias("first_receipt"), (F.length("content") == 0).alias("empty"))


RETRIEVED_SQL = """WITH r AS (SELECT CAST(doc_id % 20 AS BIGINT) AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    g AS (SELECT CAST(doc_id % 20 AS BIGINT) AS query_id, doc_id FROM labels WHERE toxic = 1)"""


def retrieved(s, d):
    """The ten longest documents of each of 20 queries, and the toxic ones as
    what should be found."""
    docs = D.read(s, d, "documents").withColumn("query_id", F.col("doc_id") % 20)
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10")
    return ranked.select("query_id", "doc_id", "rank"), D.read(s, d, "labels").where("toxic = 1").select((F.col("doc_id") % 20).alias("query_id"), "doc_id")


@query(plain=RETRIEVED_SQL + " SELECT r.query_id, r.doc_id, CAST(r.rank AS INTEGER) AS rank, g.doc_id IS NOT NULL AS wanted FROM r LEFT JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id WHERE rank <= 10")
def d17_query_gold(s, d):
    results, gold = retrieved(s, d)
    return results.join(gold.withColumn("w", F.lit(True)), ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("w", F.lit(False)).alias("wanted"))


def chain(s, d):
    """The events with their ids in the place of hashes; each links to the one
    before in its tenant."""
    rows = D.audit_events(s, d).select("tenant_id", "seq", F.col("id").cast("string").alias("entry_hash"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("tenant_id").orderBy("seq")))


@query("SELECT tenant_id, position, CAST(id AS VARCHAR) AS head, position % 20 > 0 AS holds FROM (SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS position FROM audit_events) WHERE position % 10 = 0")
def d18_anchored_positions(s, d):
    rows = D.audit_events(s, d).select("tenant_id", "seq", F.col("id").cast("string").alias("head"))
    placed = audit.with_position(rows, by=["tenant_id"]).where("position % 10 = 0")
    claims = placed.select("tenant_id", "position", F.when(F.col("position") % 20 == 0, "x").otherwise(F.col("head")).alias("claimed"))
    return claims.join(placed, ["tenant_id", "position"]).select("tenant_id", "position", "head", (F.col("head") == F.col("claimed")).alias("holds"))


@query("SELECT v.id AS event_id, CASE WHEN m.id IS NULL THEN 'not-found' WHEN m.lifecycle <> 'active' THEN 'criteria-excluded' ELSE 'matched' END AS bucket FROM audit_events v LEFT JOIN memories m ON m.id = v.id")
def d20_id_buckets(s, d):
    wanted = D.audit_events(s, d).select(F.col("id").alias("event_id"), "id")
    joined = wanted.join(D.memories(s, d).select("id", "lifecycle"), "id", "left")
    return joined.select("event_id", F.when(F.col("lifecycle").isNull(), "not-found").when(F.col("lifecycle") != "active", "criteria-excluded").otherwise("matched").alias("bucket"))


# E.


@query("SELECT tenant_id, CAST(coalesce(m, 0) AS BIGINT) AS n_memories, CAST(coalesce(c, 0) AS BIGINT) AS n_candidates, CAST(coalesce(a, 0) AS BIGINT) AS n_actions FROM (SELECT tenant_id, count(*) FILTER (id % 2 = 0) AS m, count(*) FILTER (id % 2 = 1) AS c FROM memories GROUP BY 1) FULL JOIN (SELECT tenant_id, count(DISTINCT action) AS a FROM audit_events GROUP BY 1) USING (tenant_id)")
def e10_tenant_summary(s, d):
    rows = D.memories(s, d)
    made = reports.tenant_summary(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), D.audit_events(s, d))
    return made.select("tenant_id", "n_memories", "n_candidates", F.coalesce(F.size("actions"), F.lit(0)).cast("long").alias("n_actions"))


@query(
    f"""SELECT n_active, n_memories, n_active / n_memories AS active_rate, promoted, rejected, promoted / (promoted + rejected) AS promotion_rate, stale, 1 - stale / n_active AS freshness, n_tenants FROM
    (SELECT count(*) FILTER (lifecycle = 'active') AS n_active, count(*) AS n_memories, count(*) FILTER (lifecycle = 'active' AND updated_at < TIMESTAMP '{STALE}') AS stale, count(DISTINCT tenant_id) AS n_tenants FROM memories),
    (SELECT count(*) FILTER (action = 'promoted') AS promoted, count(*) FILTER (action = 'demoted') AS rejected FROM audit_events)"""
)
def e11_system_report(s, d):
    rows = D.memories(s, d)
    return reports.system(rows, rows, D.audit_events(s, d), ts(STALE))


@query("SELECT count(*) AS total, count(*) FILTER (id % 10 = 0) AS unverified, CAST(count(*) FILTER (id % 10 > 0) AS BIGINT) AS clean, CAST(0 AS BIGINT) AS breaks FROM audit_events")
def e24_chain_totals(s, d):
    """Every tenth event has no hash and is passed over by the chain."""
    from archivum.plans.chains import events

    rows = events(s, d)
    made = audit.chained(rows.where("cast(id as long) % 10 > 0"), "tenant_id")
    bare = rows.where("cast(id as long) % 10 = 0").withColumns({"actor_json": F.lit("{}"), "reason": F.lit(""), "prev_entry_hash": F.lit(None).cast("string"), "entry_hash": F.lit(None).cast("string")})
    return audit.totals(made.unionByName(bare), audit.verify_chain(made, by=["tenant_id"]))


# F and G.


@query("SELECT e.id, coalesce(min(b.id), -1) AS earlier FROM audit_events e LEFT JOIN audit_events b ON b.memory_id = e.memory_id AND b.seq < e.seq GROUP BY e.id")
def f3_seen_before(s, d):
    """The first earlier event about the same record, by an aggregate and an
    equality, not by a growing frame."""
    rows = D.audit_events(s, d).select("id", "seq", "memory_id")
    first = rows.groupBy("memory_id").agg(F.min(F.struct("seq", "id")).alias("first"))
    joined = rows.join(first, "memory_id")
    return joined.select("id", F.when(F.col("first.seq") < F.col("seq"), F.col("first.id")).otherwise(-1).alias("earlier"))


@query(plain="SELECT page_id, CASE WHEN regexp_matches(base, '\\.html$') THEN page_id % 2 = 0 ELSE page_id % 2 = 0 END AS kept FROM (SELECT page_id, url AS base FROM pages)")
def f8_last_rule_wins(s, d):
    """All is ignored, then what has an even number is taken back."""
    path = F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.lit(".md"))
    return D.read(s, d, "pages").select("page_id", (~ignore.ignored(path, ["*", "!*0.md", "!*2.md", "!*4.md", "!*6.md", "!*8.md"])).alias("kept"))


@query("SELECT tenant_id, position, position % 30 = 0 AS broken FROM (SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS position FROM audit_events) WHERE position % 10 = 0 AND position > 10")
def f9_anchor_links(s, d):
    """Anchors every ten rows, of which those at 30, 60, ... link wrongly."""
    rows = chain(s, d).where("position % 10 = 0").select("tenant_id", "position", "entry_hash")
    before = F.lag("entry_hash").over(Window.partitionBy("tenant_id").orderBy("position"))
    linked = rows.withColumn("prev", F.when(F.col("position") % 30 == 0, "x").otherwise(before))
    return linked.withColumn("expected", before).where("position > 10").select("tenant_id", "position", (~F.col("prev").eqNullSafe(F.col("expected"))).alias("broken"))


@query(S.bm25() + "SELECT id FROM hits ORDER BY round(score, 9) DESC, id LIMIT 10")
def g2_text_top(s, d):
    scored = search.bm25(D.memories(s, d), QUERY).select("id", F.round("score", 9).alias("score"))
    return search.top(scored, 10).select("id")


@query(plain="SELECT query_id, id FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 3")
def g3_nearest_top(s, d):
    vectors = D.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "collection", F.col("vector").alias("query"))
    return search.knn(vectors, queries, 3).select("query_id", "id")


@query(f"SELECT id, final FROM (SELECT id, {S.FINAL} AS final FROM (SELECT *, 1.0 + id % 5 AS score FROM memories)) ORDER BY final DESC, id LIMIT 50")
def g4_fresh_order(s, d):
    rows = D.memories(s, d)
    hits = rows.select("id", (1.0 + F.col("id") % 5).alias("score"))
    ranked = search.rerank(hits, rows, ts(D.NOW)).select("id", F.col("final_score").alias("final"))
    return ranked.orderBy(F.desc("final"), "id").limit(50)


@query("SELECT id FROM memories WHERE sensitivity IN ('public', 'internal') ORDER BY updated_at DESC, id LIMIT 10")
def g8_client_limit(s, d):
    return search.page(records.visible(D.memories(s, d)), 1, 10, [F.desc("updated_at"), F.asc("id")]).select("id")


@query(plain="SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS place FROM nation")
def g11_collated_order(s, d):
    rows = D.read(s, d, "nation").select("n_name")
    return rows.select("n_name", F.row_number().over(Window.orderBy(F.collate("n_name", "UNICODE"))).alias("place"))  # a report's rows


# H.


@query("SELECT a.id, list_sort(a.w) = list_sort(b.w) AS same FROM (SELECT id, regexp_extract_all(lower(title), '[a-z]+') AS w FROM memories) a JOIN (SELECT id, list_reverse(regexp_extract_all(lower(title), '[a-z]+')) || CASE WHEN id % 4 = 0 THEN ['x'] ELSE [] END AS w FROM memories) b ON a.id = b.id")
def h8_set_equality(s, d):
    """The words of a title against the same in another order, some with one more."""
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))
    other = F.concat(F.reverse(words), F.when(F.col("id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return D.memories(s, d).select("id", (F.array_sort(words) == F.array_sort(other)).alias("same"))


@query("SELECT id, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(content, '\\d+'), lambda x: NOT list_contains(regexp_extract_all(title, '\\d+'), x)))), 'string_agg', ',') AS new_numbers FROM memories")
def h10_number_difference(s, d):
    of = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    found = F.array_join(F.array_sort(F.array_except(of("content"), of("title"))), ",")
    return D.memories(s, d).select("id", F.nullif(found, F.lit("")).alias("new_numbers"))


@query(f"SELECT a.id, CAST(len(list_intersect(a.w, b.w)) AS BIGINT) AS common FROM (SELECT id, {S.WORDS.format('title')} AS w FROM memories) a JOIN (SELECT id - 1 AS id, {S.WORDS.format('title')} AS w FROM memories) b ON a.id = b.id")
def h11_common_words(s, d):
    rows = D.memories(s, d).select("id", T.title_tokens(F.col("title")).alias("w"))
    return rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("w").alias("v")), "id").select("id", F.size(F.array_intersect("w", "v")).cast("long").alias("common"))


# Beyond the surveyed ones.


@query("SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM links UNION ALL SELECT target_id, 0, 1 FROM links) GROUP BY id")
def x1_degrees(s, d):
    return graph.degrees(D.links(s, d))


@query("SELECT link_type, count(*) AS n, max(weight) AS most FROM links WHERE source_id <> target_id GROUP BY link_type")
def x2_link_types(s, d):
    return D.links(s, d).where("source_id <> target_id").groupBy("link_type").agg(counted(), F.max("weight").alias("most"))
