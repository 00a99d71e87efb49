"""Connected components as DataFrames, by alternating large and small stars.

Every round's edges are written to the shared folder, so lineage stays short
and nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import discard, stored

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(edges: DataFrame, upper: bool) -> DataFrame:
    """Large star (upper) links a node's larger neighbours to the least of
    its neighbourhood; small star links the node and its smaller ones."""
    near = _both_ways(edges) if upper else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if upper:
        linked = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the undirected edges (a, b): root is the
    smallest node that can be reached. Loops, repeats and rows with a null
    don't matter; no edges give no rows."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        old, edges = edges, stored(_to_least(_to_least(edges, True), False), "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
