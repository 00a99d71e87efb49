"""Streaming intake: new spool lines become candidates, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.sources.jsonl import CANDIDATE


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of candidates with hash and time of capture. An id that comes
    again within a day of captured time is dropped."""
    lines = spark.readStream.option("pathGlobFilter", "spool-*.jsonl").text(folder)
    rows = lines.select(F.from_json("value", CANDIDATE).alias("c")).select("c.*").where("id is not null and content is not null")
    timed = rows.withColumn("captured", F.to_timestamp("capturedAt")).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    return timed.withWatermark("captured", "1 day").dropDuplicatesWithinWatermark(["id"])


def counts(stream: DataFrame, every: str = "1 hour") -> DataFrame:
    """Candidates by tenant and window of captured time."""
    return stream.groupBy(F.window("captured", every), "tenantId").agg(F.count(F.lit(1)).alias("n"))
