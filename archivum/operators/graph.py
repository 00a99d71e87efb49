"""The link graph: neighbours, bounded traversal, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(links: DataFrame, node: int) -> DataFrame:
    """Outgoing and incoming links of a node; a loop is both."""
    out = links.where(F.col("source_id") == node).select(F.col("target_id").alias("id"), "link_type", "weight", F.lit("outgoing").alias("direction"))
    into = links.where(F.col("target_id") == node).select(F.col("source_id").alias("id"), "link_type", "weight", F.lit("incoming").alias("direction"))
    return out.unionAll(into)


def traverse(links: DataFrame, start: int, max_depth: int = 2) -> DataFrame:
    """Nodes that links lead to within ``max_depth`` steps, the start left out:
    id, depth (the least) and weight (the largest at that depth).

    Each step joins the frontier with the links and keeps a node once, so the
    frontier never outgrows the nodes."""
    frontier = links.where(F.col("source_id") == start).groupBy(F.col("target_id").alias("id")).agg(F.max("weight").alias("weight")).withColumn("depth", F.lit(1))
    found = frontier
    for depth in range(2, max_depth + 1):
        step = frontier.select(F.col("id").alias("source_id")).join(links, "source_id")
        frontier = step.groupBy(F.col("target_id").alias("id")).agg(F.max("weight").alias("weight")).withColumn("depth", F.lit(depth))
        found = found.unionByName(frontier)
    first = F.row_number().over(Window.partitionBy("id").orderBy("depth", F.desc("weight")))
    return found.where(F.col("id") != start).withColumn("n", first).where("n = 1").select("id", "depth", "weight")


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(links.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def paths(links: DataFrame, start: int, max_depth: int) -> DataFrame:
    """id, depth and n: how many paths of that length lead from the start to a
    node. Paths to a node are counted, not kept apart, so that rows never
    outgrow the nodes."""
    step = links.where(F.col("source_id") == start).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(1))
    found = step
    for depth in range(2, max_depth + 1):
        further = step.select(F.col("id").alias("source_id"), "n").join(links, "source_id")
        step = further.groupBy(F.col("target_id").alias("id")).agg(F.sum("n").alias("n")).withColumn("depth", F.lit(depth))
        found = found.unionByName(step)
    return found
