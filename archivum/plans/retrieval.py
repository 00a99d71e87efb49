"""Registered queries of search, the index and the graph (L, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.operators import graph, index, records, search
from archivum.plans import domain as D
from archivum.plans import sqltext as S
from archivum.plans.lookups import FUSED_SQL, lists
from archivum.plans.registry import QUERY, query, ts
from archivum.sources import files
from archivum.storage import fresh_path

FUSED_TEXTS = FUSED_SQL + """SELECT id, score FROM (SELECT f.id, row_number() OVER (ORDER BY round(f.score, 12) DESC, best_rank, f.id) AS place,
    CASE WHEN f.id % 4 = 0 THEN 1000 + f.id ELSE length(substr(content, 1, 1500)) END::DOUBLE AS score FROM fused f JOIN memories m ON m.id = f.id) WHERE place <= 50 ORDER BY score DESC, place LIMIT 8"""


def rounded():
    return F.round("score", 9).alias("score")


@query(", texts AS (SELECT id, title || chr(10) || content AS body FROM memories WHERE lifecycle = 'active')" + S.bm25("texts", "body") + "SELECT id, round(score, 9) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 100")
def l2_record_search(s, d):
    """Active records by title and content together."""
    rows = records.find(D.memories(s, d), lifecycle="active").select("id", F.concat_ws("\n", "title", "content").alias("content"))
    return search.top(search.bm25(rows, QUERY).select("id", rounded()), 100)


@query(S.bm25() + "SELECT id, score FROM (SELECT id, round(score, 9) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 100) WHERE id IN (SELECT id FROM memories WHERE source = 'bulk_import')")
def l3_scoped_search(s, d):
    """The best hundred of all, then those of one scope."""
    rows = D.memories(s, d)
    best = search.top(search.bm25(rows, QUERY).select("id", rounded()), 100)
    return best.join(records.in_scope(rows, "bulk").select("id"), "id", "left_semi")


@query(S.bm25() + "SELECT id, round(score, 9) AS score FROM hits")
def l4_stored_index(s, d):
    """The same search out of postings that were written once."""
    rows = D.memories(s, d)
    path = fresh_path(s, "postings")
    index.write_postings(search.postings(rows), path, 8)
    postings = s.read.parquet(path)
    stats = postings.groupBy("id").agg(F.first("length").alias("length")).agg(F.sum("length").alias("n")).first()
    documents = rows.count()
    return index.search_postings(postings, QUERY, documents, stats.n / documents).select("id", rounded())


@query(plain="SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def l5_knn(s, d):
    vectors = D.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "collection", F.col("vector").alias("query"))
    return search.knn(vectors, queries).select("query_id", "id", "rank")


HYBRID_SQL = """, lexical AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM hits QUALIFY rank <= 50),
    dense AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) AS rank FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) QUALIFY rank <= 50),
    fused AS (SELECT id, round(sum(1 / (60 + rank)), 12) AS score, min(rank) AS best_rank FROM (SELECT * FROM lexical UNION ALL SELECT * FROM dense) GROUP BY id)
    """


def hybrid(s, d, tenant: str | None):
    """Both arms for the fixed query, whose vector is that of number 0."""
    vectors = D.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))
    query_vector = vectors.where("id = 0").select(F.col("id").alias("query_id"), "collection", F.col("vector").alias("query"))
    return search.hybrid(D.memories(s, d), QUERY, vectors, query_vector, bound_tenant=tenant, tenant=tenant)


@query(S.bm25() + HYBRID_SQL + "SELECT id, score, best_rank FROM fused")
def l7_hybrid_query(s, d):
    return hybrid(s, d, None).select("id", F.round("score", 12).alias("score"), "best_rank")


def reranked_sql(where: str) -> str:
    rows = f", seen AS (SELECT * FROM memories WHERE {where})"
    best = ", best AS (SELECT id, round(score, 9) AS score FROM hits ORDER BY round(score, 9) DESC, id LIMIT 100)"
    return rows + S.bm25("seen") + best + f", final AS (SELECT b.id, b.score, {S.FINAL.replace('score', 'b.score', 1)} AS final_score FROM best b JOIN memories m ON m.id = b.id) "


@query(reranked_sql("true") + "SELECT id, score, final_score FROM final")
def l9_fresh_rerank(s, d):
    rows = D.memories(s, d)
    hits = search.top(search.bm25(rows, QUERY).select("id", rounded()), 100)
    return search.rerank(hits, rows, ts(D.NOW))


@query(reranked_sql("sensitivity NOT IN ('confidential', 'restricted') AND source <> 'bulk_import'") + "SELECT id, score, final_score FROM final")
def l10_cited_rerank(s, d):
    rows = records.visible(records.in_scope(D.memories(s, d), "curated"))
    hits = search.top(search.bm25(rows, QUERY).select("id", rounded()), 100)
    return search.rerank(hits, rows, ts(D.NOW)).orderBy(F.desc("final_score"), "id")


@query(reranked_sql("sensitivity NOT IN ('confidential', 'restricted')") + "SELECT id, score, final_score FROM final ORDER BY final_score DESC, id LIMIT 20 OFFSET 20")
def l11_governed_page(s, d):
    rows = records.visible(D.memories(s, d))
    ranked = search.rerank(search.top(search.bm25(rows, QUERY).select("id", rounded()), 100), rows, ts(D.NOW))
    return search.page(ranked, 2, 20, [F.desc("final_score"), F.asc("id")])


@query(S.bm25() + "SELECT id FROM (SELECT id, round(score, 9) AS score FROM hits) JOIN memories USING (id) WHERE sensitivity IN ('public', 'internal') AND tenant_id = 'en' ORDER BY score DESC, id LIMIT 10")
def l13_tool_search(s, d):
    """Sensitive records and other tenants go first, then the limit cuts."""
    rows = D.memories(s, d)
    seen = records.visible_to(records.visible(rows), ["en"]).select("id")
    return search.top(search.bm25(rows, QUERY).select("id", rounded()).join(seen, "id", "left_semi"), 10).select("id")


@query("SELECT id, CASE WHEN id % 10 = 3 THEN NULL ELSE CAST(length(content) AS DOUBLE) END AS first FROM memories")
def l14_embedded(s, d):
    """A stand-in for a model: it gives lengths, and fails on marked texts."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(t.startswith("BAD ") for t in texts):
            raise ValueError("a text that can't be embedded")
        return [[float(len(t)), 1.0] for t in texts]

    rows = D.memories(s, d).select("id", F.when(F.col("id") % 10 == 3, F.concat(F.lit("BAD "), "content")).otherwise(F.col("content")).alias("content"))
    return index.embedded(rows, embed).select("id", F.get("vector", F.lit(0)).alias("first"))


@query("SELECT id, 'embed' AS change FROM memories WHERE id % 5 > 0 AND (id % 7 = 0 OR id % 3 = 0) UNION ALL SELECT id, 'remove' FROM memories WHERE id % 5 = 0 AND id % 7 > 0")
def l15_dense_sync(s, d):
    rows = D.memories(s, d)
    stored = rows.where("id % 7 > 0").select("id", F.when(F.col("id") % 3 == 0, "0").otherwise(F.sha2(F.substring("content", 1, 2000).cast("binary"), 256)).alias("hash"))
    return index.sync(rows.where("id % 5 > 0"), stored)


@query("SELECT q AS query_id, count(m.id) AS n, count(m.id) >= 1 AS ok FROM (VALUES ('the'), ('und'), ('zzzz')) t(q) LEFT JOIN memories m ON contains(m.content, q) GROUP BY q")
def l16_canary(s, d):
    controls = s.createDataFrame([("the",), ("und",), ("zzzz",)], "query_id string")
    found = F.array(*[F.when(F.contains("content", F.lit(q)), F.lit(q)) for q in ("the", "und", "zzzz")])
    hits = D.memories(s, d).select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("query_id"))
    return index.canary(hits, controls)


@query("SELECT id, CASE WHEN id % 2 = 1 THEN 'indexed' ELSE 'kept' END AS state FROM memories WHERE sensitivity IN ('public', 'internal')")
def l17_refresh(s, d):
    """What was promoted since the mark is exported, then indexed; the mark is
    set before, so that later rows aren't missed."""
    rows = records.exportable(D.memories(s, d)).select("id", "content")
    before, folder = rows.where("id % 2 = 0"), fresh_path(s, "export")
    fresh = rows.where("id % 2 = 1").select(F.concat("id", F.lit(".md")).alias("name"), "content")
    files.write_files(fresh, folder)
    listed = files.listing(s, folder, "*.md").select(F.substring_index("name", ".", 1).cast("long").alias("id"), F.lit(1).alias("v"))
    changes = index.delta(listed.unionAll(before.select("id", F.lit(0).alias("v"))), before.select("id", F.lit(0).alias("v")), "id", "v")
    done = index.applied(before.select("id"), changes, listed.select("id"), "id")
    return done.join(changes, "id", "left").select("id", F.when(F.col("change") == "insert", "indexed").otherwise("kept").alias("state"))


@query("SELECT 'documents' AS part, count(*) AS n, count(*) > 0 AS ok FROM memories UNION ALL SELECT 'vectors', count(*), count(*) > 0 FROM embeddings UNION ALL SELECT 'empty', 0, false")
def l18_index_health(s, d):
    rows = D.memories(s, d)
    return index.health({"documents": rows, "vectors": D.read(s, d, "embeddings"), "empty": rows.where("id < 0")})


@query("SELECT id, link_type, weight, direction FROM (SELECT target_id AS id, link_type, weight, 'outgoing' AS direction FROM links WHERE source_id = 3 UNION ALL SELECT source_id, link_type, weight, 'incoming' FROM links WHERE target_id = 3)")
def m1_neighbours(s, d):
    return graph.neighbours(D.links(s, d), 3).orderBy(F.desc("weight"), "id", "direction")


@query("SELECT source_id, target_id, link_type FROM links WHERE link_type <> 'part_of' UNION SELECT source_id, target_id, 'depends_on' FROM links WHERE source_id % 2 = 0")
def m3_link_insert(s, d):
    """Links of known types alone, each once."""
    rows = D.links(s, d).select("source_id", "target_id", "link_type")
    fresh = rows.where("source_id % 2 = 0").withColumn("link_type", F.lit("depends_on")).unionAll(rows.where("target_id % 2 = 0").withColumn("link_type", F.lit("bogus")))
    return records.insert_new(rows.where("link_type <> 'part_of'"), fresh.where(F.col("link_type").isin(D.LINK_TYPES)), ["source_id", "target_id", "link_type"])


@query(FUSED_TEXTS)
def l8_cross_rerank(s, d):
    """The eight longest of the first fifty of the fused list, by a stand-in
    for a model; every fourth score comes from a cache."""
    one, two = lists(s, d)
    fused = search.fuse(one, two).withColumn("score", F.round("score", 12))
    placed = fused.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "best_rank", "id")).alias("place"))  # 100 rows
    texts = D.memories(s, d).select("id", "content")
    cache = texts.where("id % 4 = 0").select("id", (1000 + F.col("id")).cast("double").alias("cached"))
    return search.cross_reranked(placed, texts, F.length("text").cast("double"), cache)
