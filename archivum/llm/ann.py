"""Approximate nearest neighbours by largest inner product (IVF-PQ).

An inverted file of coarse centroids, product-quantised residuals (in units
of their list's spread), asymmetric
distance tables, and exact reranking. Centroids and codebooks are fitted on a
bounded sample; every vector is indexed. How many lists a query probes is
chosen on the sample, so that they hold TARGET of its true neighbours.

Lists are gathered into shards of bounded size (a large list is spread over
several), and queries into blocks; a group is one shard and one block, gives a
bounded number of candidates for each query, and never needs more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.llm._shared import for_python, stored

#: Vectors that centroids and codebooks are fitted on, at most.
SAMPLE = 20_000
LISTS, CODES, SUBSPACE = 1024, 256, 2
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET, TRIALS = 0.99, 256
#: Candidates of a query that are reranked exactly.
RERANK = 160
SHARD_ROWS, BLOCK_QUERIES, LEAST_BLOCK, GROUPS = 131_072, 65_536, 512, 64
#: Numbers in the score matrix that a group holds at once.
MATRIX = 4_000_000


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def inner_product(one: Column, two: Column) -> Column:
    """In double precision, components in order."""
    return F.aggregate(F.zip_with(one, two, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def cluster(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


class Index:
    """Centroids, codebooks, and how many lists to probe."""

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        self.dim = sample.shape[1]
        self.parts = -(-self.dim // SUBSPACE)
        n = len(sample)
        self.lists = max(1, min(LISTS, int(total**0.5), n))
        self.centres = cluster(sample, self.lists, rng)
        own = nearest(sample, self.centres)
        residuals = self.padded(sample - self.centres[own])
        # Residuals in units of their list's mean square, so that the codes of
        # a dense list are as fine as it needs.
        square = np.bincount(own, (residuals**2).sum(axis=(1, 2)), self.lists) / np.maximum(np.bincount(own, minlength=self.lists), 1)
        self.scales = np.sqrt(np.maximum(square, 1e-12)).astype(np.float32)
        residuals /= self.scales[own][:, None, None]
        self.books = np.stack([cluster(np.ascontiguousarray(residuals[:, p]), min(CODES, n), rng, 6) for p in range(self.parts)])
        self.probes = self.lists
        if n > 4 * k:
            # Different vectors that are not themselves among their neighbours,
            # or a vector that many rows share would speak for the rest.
            tried = np.unique(sample[rng.choice(n, min(4 * TRIALS, n), replace=False)], axis=0)
            tried = tried[rng.permutation(len(tried))[:TRIALS]]
            near = tried @ sample.T
            near[(tried[:, None, 0] == sample[None, :, 0]) & (near >= near.max(axis=1, keepdims=True))] = -np.inf
            best = np.argpartition(-near, k, axis=1)[:, :k]
            order = np.argsort(-(tried @ self.centres.T), axis=1)
            place = np.argsort(order, axis=1)
            self.probes = int(np.quantile(np.take_along_axis(place, own[best], axis=1), TARGET)) + 1

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * SUBSPACE), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, SUBSPACE)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        own = nearest(x, self.centres)
        residuals = self.padded(x - self.centres[own]) / self.scales[own][:, None, None]
        return own, np.stack([nearest(residuals[:, p], self.books[p]) for p in range(self.parts)], axis=1).astype(np.uint8)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        scores = queries @ self.centres.T
        return np.argpartition(-scores, self.probes - 1, axis=1)[:, : self.probes] if self.probes < self.lists else np.tile(np.arange(self.lists), (len(queries), 1))

    def search(self, lists: np.ndarray, codes: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, keep: int):
        """(row of query, id, score) of each query's best candidates among
        these rows: largest first, ties to the smaller id. Rows are by id."""
        coarse = queries @ self.centres.T
        may = np.zeros((len(queries), self.lists), bool)
        np.put_along_axis(may, self.probed(queries), True, 1)
        parts = self.padded(queries)
        members = [(int(k), np.flatnonzero(lists == k)) for k in np.unique(lists)]
        out = []
        block = max(1, MATRIX // max(1, len(ids)))
        for at in range(0, len(queries), block):
            stop = min(at + block, len(queries))
            tables = np.einsum("qpd,pcd->pqc", parts[at:stop], self.books)
            scores = np.full((stop - at, len(ids)), -np.inf, np.float32)
            for k, rows in members:
                asking = np.flatnonzero(may[at:stop, k])
                if len(asking):
                    sums = np.zeros((len(asking), len(rows)), np.float32)
                    for p in range(self.parts):
                        sums += tables[p][asking][:, codes[rows, p]]
                    scores[asking[:, None], rows[None]] = coarse[at:stop][asking, k][:, None] + self.scales[k] * sums
            scores[query_ids[at:stop, None] == ids[None]] = -np.inf
            n = min(keep, len(ids))
            least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
            for i in range(stop - at):
                own = scores[i]
                above = np.flatnonzero(own > least[i])
                level = np.flatnonzero(own == least[i])[: n - len(above)] if least[i] > -np.inf else np.zeros(0, np.int64)
                found = np.concatenate((above, level))
                found = found[own[found] > -np.inf]
                out.append((np.full(len(found), at + i), ids[found], own[found]))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]


def shards_of(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(list, first shard, shards it is spread over). Small lists share a
    shard up to SHARD_ROWS; the plan has a line for each list, no more."""
    plan, shard, room = [], 0, SHARD_ROWS
    for key in sorted(sizes):
        n = sizes[key]
        if n > SHARD_ROWS:
            if room < SHARD_ROWS:
                shard += 1
            wide = -(-n // SHARD_ROWS)
            plan.append((key, shard, wide))
            shard, room = shard + wide, SHARD_ROWS
            continue
        if n > room:
            shard, room = shard + 1, SHARD_ROWS
        plan.append((key, shard, 1))
        room -= n
    return plan


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest
    found, by largest inner product, ties to the smaller id.

    Rows whose vector is null, zero or has null or non-finite components, or
    another length than most of the sample, take no part, nor do null ids. A
    query never finds its own id; where fewer than ``k`` others are found, it
    has fewer rows, and none in an empty table. Rows that repeat an id with
    the same vector count once. Other columns don't matter.
    """
    spark = vectors.sparkSession
    for_python(spark)
    all_rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), is_query.alias("asks"))
    taken = all_rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not taken:
        return empty
    dims = [len(r.v) for r in taken]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    valid = all_rows.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    total = valid.count()
    index = Index(np.array([r.v for r in taken if len(r.v) == dim]), total, k)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = shared.value.encode(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "codes"])

    coded = stored(valid.select("id", "v").mapInArrow(encode, "id long, list int, codes binary"), "codes")
    plan = shards_of({r.list: r["count"] for r in coded.groupBy("list").count().collect()})  # LISTS rows at most
    lists = F.broadcast(spark.createDataFrame(plan, "list int, first int, wide int"))
    shards = max(first + wide for _, first, wide in plan)
    asked = valid.where("asks").select("id", "v")
    queries = asked.count()
    blocks = max(-(-queries // BLOCK_QUERIES), min(-(-queries // LEAST_BLOCK), -(-GROUPS // shards)), 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {key: (first, wide) for key, first, wide in plan}
        for batch in batches:
            rows, at = [], []
            for i, probed in enumerate(shared.value.probed(_matrix(batch.column(1), dim))):
                own = {first + j for first, wide in (where.get(int(x), (0, 0)) for x in probed) for j in range(wide)}
                rows += [i] * len(own)
                at += sorted(own)
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), picked.column(0), picked.column(1)], names=["shard", "id", "v"])

    sent = asked.mapInArrow(probe, "shard int, id long, v array<float>").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    placed = coded.join(lists, "list").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("wide").cast("long"))).cast("int").alias("shard"), "id", "list", "codes")
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "near": np.zeros(0, np.float32)})
        rows, asking = rows.sort_values("id"), asking.sort_values("id")
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        at, ids, near = shared.value.search(rows["list"].to_numpy(), codes, rows["id"].to_numpy(), asking["id"].to_numpy(), np.stack(asking["v"].to_numpy()).astype(np.float32), RERANK)
        return pd.DataFrame({"query_id": asking["id"].to_numpy()[at], "vec_id": ids, "near": near})

    found = placed.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(compare, "query_id long, vec_id long, near float")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("n") <= RERANK).select("query_id", "vec_id")
    best = best.join(valid.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = best.select("query_id", "vec_id", inner_product(F.col("q"), F.col("x")).alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
