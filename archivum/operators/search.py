"""Ranked search: BM25 over postings, exact vector search, rank fusion."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions import text as T

#: The weights of BM25 and of rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame) -> DataFrame:
    """id, term, tf and length: runs of letters and digits in lower case."""
    words = docs.select("id", F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    return words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """id and score of the documents that have every word of the query.

    Only the query's terms are counted; what is needed of the corpus is its
    size and mean length. Texts are read for that and again for the hits; for
    many queries, ``operators.index`` searches stored postings."""
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    words = docs.select("id", F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    counts = [F.size(F.filter("w", _equals(t))).alias(f"tf{k}") for k, t in enumerate(terms)]
    tf = words.select("id", F.size("w").alias("length"), *counts)
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    hits = tf.where(reduce(lambda a, b: a & b, [F.col(f"tf{k}") > 0 for k in range(len(terms))], F.lit(bool(terms))))
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = max(math.log((stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)), 1e-6)
        score = score + F.lit(idf) * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"])))
    return hits.select("id", score.alias("score"))


def _equals(term: str):
    return lambda w: w == term


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id and cosine of the ``k`` nearest of each query's own
    collection, itself included; ``vectors`` has id, collection and vector,
    and ``queries`` (a stated set) query_id, collection and query."""
    dot = F.aggregate(F.zip_with("vector", "query", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(queries, "collection").select("query_id", "id", dot.alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (id, rank): id, score, best_rank."""
    rows = reduce(lambda a, b: a.unionByName(b), [x.select("id", "rank") for x in lists])
    return rows.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))


def ranked(hits: DataFrame, most: int) -> DataFrame:
    """id and rank of the ``most`` best hits (id, score)."""
    best = top(hits, most)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # ``most`` rows


def hybrid(docs: DataFrame, query: str, vectors: DataFrame, query_vector: DataFrame, bound_tenant: str | None = None, tenant: str | None = None, most: int = 50) -> DataFrame:
    """The best ``most`` by words and by vectors, fused: id, score, best_rank.

    An index that is bound to a tenant answers others with nothing. A query
    without a vector (none in ``query_vector``) is answered by words alone."""
    if bound_tenant is not None and tenant != bound_tenant:
        docs, vectors = docs.limit(0), vectors.limit(0)
    lexical = ranked(bm25(docs, query).select("id", F.round("score", 9).alias("score")), most)
    return fuse(lexical, knn(vectors, query_vector, most).select("id", "rank"))


def cross_reranked(fused: DataFrame, texts: DataFrame, score, cache: DataFrame, window: int = 50, top_n: int = 8, chars: int = 1500) -> DataFrame:
    """The ``top_n`` of the first ``window`` of a fused list (id, place) by
    ``score``, a column over ``text`` (the first ``chars``); scores that the
    cache (id, cached) has aren't computed again. Without texts the list
    stays as it is."""
    head = fused.orderBy("place").limit(window).join(texts.select("id", F.substring("content", 1, chars).alias("text")), "id", "left").join(cache, "id", "left")
    made = F.coalesce(F.col("cached"), F.when(F.col("text").isNotNull(), score))
    return head.withColumn("score", made).orderBy(F.desc_nulls_last("score"), "place").limit(top_n).select("id", "score")


def rerank(hits: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Hits (id, score) with final_score = score x freshness x category boost."""
    known = hits.join(memories.select("id", "category", "updated_at"), "id", "left")
    final = F.col("score") * T.freshness(F.coalesce("updated_at", now), now) * T.category_boost(F.coalesce("category", F.lit("")))
    return known.withColumn("final_score", T.round3(final)).select("id", "score", "final_score")


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
