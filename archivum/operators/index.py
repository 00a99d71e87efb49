"""Index maintenance: deltas, postings, vectors, watermarks, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import text as T


def delta(listed: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """key and change (insert, replace or remove) that bring ``stored`` to
    what is listed; rows of the same version need none."""
    a, b = listed.select(key, F.col(version).alias("__a"), F.lit(True).alias("__in")), stored.select(key, F.col(version).alias("__b"), F.lit(True).alias("__had"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("__had").isNull(), "insert").when(F.col("__in").isNull(), "remove").when(~F.col("__a").eqNullSafe(F.col("__b")), "replace")
    return both.select(key, change.alias("change")).where("change is not null")


def applied(base: DataFrame, changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` after a delta: removed and replaced keys go, inserted and
    replaced ones come from ``rows``."""
    kept = base.join(changes.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(rows.join(changes.where("change <> 'remove'").select(key), key, "left_semi").select(*base.columns))


def write_postings(postings: DataFrame, path: str, files: int) -> None:
    """Postings (id, term, tf, length) sorted by term in ``files`` parts by its
    hash, so that a search reads the row groups of its own terms alone."""
    postings.repartition(files, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def search_postings(postings: DataFrame, query: str, documents: int, mean_length: float) -> DataFrame:
    """id and BM25 score of the documents that have every term of the query,
    out of stored postings: the terms reach the scan, and texts aren't read."""
    from archivum.operators.search import K1, B

    terms = list(dict.fromkeys(t.lower() for t in T.query_terms(query)))
    found = postings.where(F.col("term").isin(terms))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((documents - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    one = found.join(F.broadcast(counts.select("term", idf.alias("idf"))), "term")  # a row for each term of the query
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    scored = one.select("id", score.alias("s")).groupBy("id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n"))
    return scored.where(F.col("n") == len(terms)).select("id", "score")


def upsert_vectors(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with vectors of ``rows`` in the place of their keys'. Where the
    model, its version or the dimensions of ``rows`` are others than the
    base's, nothing of the base stays. Both have model, dims and the key."""
    now = rows.select("model", "dims").distinct()
    same = base.join(now, ["model", "dims"], "left_semi")
    return same.join(rows.select(key), key, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def sync(docs: DataFrame, stored: DataFrame, chars: int = 2000) -> DataFrame:
    """id and change (embed or remove): documents whose first ``chars``
    characters hash otherwise than what is stored (id, hash) are embedded."""
    own = docs.select("id", F.sha2(F.substring("content", 1, chars).cast("binary"), 256).alias("hash"))
    changes = delta(own, stored, "id", "hash")
    return changes.select("id", F.when(F.col("change") == "remove", "remove").otherwise("embed").alias("change"))


def embedded(docs: DataFrame, embed, text: str = "content", batch: int = 16) -> DataFrame:
    """Adds ``vector``: ``embed`` gets lists of at most ``batch`` texts and
    gives a list of vectors, or raises; then its texts are tried one by one,
    and one that can't be embedded has null."""
    import pandas as pd

    def run(batches):
        for rows in batches:
            texts, made = rows[text].tolist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    made += embed(part)
                except Exception:
                    for one in part:
                        try:
                            made += embed([one])
                        except Exception:
                            made.append(None)
            yield rows.assign(vector=pd.Series(made, index=rows.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", vector array<double>"
    return docs.mapInPandas(run, schema)


def canary(hits: DataFrame, controls: DataFrame, least: int = 1) -> DataFrame:
    """query_id, n and ok of the control queries (query_id): whether each has
    ``least`` hits (query_id, id)."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return controls.join(counts, "query_id", "left").select("query_id", n.alias("n"), (n >= least).alias("ok"))


def stale_seconds(rows: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """tenant_id and how long its oldest unindexed row (tenant_id, at) waits:
    null for a tenant that was never indexed (marks: tenant_id, indexed_at), 0
    if nothing waits."""
    joined = rows.join(F.broadcast(marks), "tenant_id", "left")
    oldest = F.min(F.when(F.col("at") > F.col("indexed_at"), F.col("at")))
    made = joined.groupBy("tenant_id").agg(oldest.alias("oldest"), F.max("indexed_at").alias("mark"))
    waits = F.greatest(F.floor((F.unix_millis(now) - F.unix_millis("oldest")) / 1000), F.lit(0))
    return made.select("tenant_id", F.when(F.col("mark").isNotNull(), F.coalesce(waits, F.lit(0))).cast("long").alias("seconds"))


def collections_to_make(wanted: list[str], listed: DataFrame) -> DataFrame:
    """name and state (exists or created) of the wanted collections; ``listed``
    has name."""
    spark = listed.sparkSession
    rows = spark.createDataFrame([(n,) for n in wanted], "name string")
    there = listed.select("name").distinct().withColumn("__there", F.lit(True))
    return rows.join(there, "name", "left").select("name", F.when(F.col("__there"), "exists").otherwise("created").alias("state"))


def health(counts: dict[str, DataFrame]) -> DataFrame:
    """part, n and ok (anything there) of the parts of an index."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n", (F.col("n") > 0).alias("ok")) for name, df in counts.items()]
    return reduce(lambda a, b: a.unionAll(b), parts)
