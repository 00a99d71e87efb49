"""From a record back to where it came from, link by link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import hashing

LINKS = ["memory_id_derived", "receipt", "candidate", "manifest", "trace"]


def _state(known: Column, good: Column) -> Column:
    return F.when(~known, "UNVERIFIABLE").when(good, "PASS").otherwise("FAIL")


def walk(memories: DataFrame, events: DataFrame, candidates: DataFrame, manifests: DataFrame, traces: DataFrame, namespace: str) -> DataFrame:
    """id, a status (PASS, FAIL or UNVERIFIABLE) for each link, and code: 1 if
    any fails, 3 if any can't be verified, else 0.

    ``memories`` has id, derived_id, candidate_id, tenant_id and content_hash:
    the derived id must be that of the other three. A first receipt of its
    promotion must exist (events: memory_id, action, seq, id). The candidate
    (candidate_id, trace_path), its manifest (candidate_id, intact) and the
    trace that wrote it (output) can't be verified where they are gone."""
    right = F.col("derived_id") == hashing.derived_id(namespace, F.col("tenant_id"), F.col("candidate_id"), F.col("content_hash"))
    first = events.where("action = 'promoted'").groupBy(F.col("memory_id").alias("id")).agg(F.min_by("id", "seq").alias("__receipt"))
    found = candidates.select("candidate_id", F.col("trace_path").alias("__path"), F.lit(True).alias("__candidate"))
    listed = manifests.select("candidate_id", F.col("intact").alias("__intact"))
    traced = traces.select(F.col("output").alias("__path")).distinct().withColumn("__trace", F.lit(True))
    joined = memories.join(first, "id", "left").join(found, "candidate_id", "left").join(listed, "candidate_id", "left").join(traced, "__path", "left")
    yes = F.lit(True)
    out = joined.select(
        "id",
        _state(yes, right).alias("memory_id_derived"),
        _state(yes, F.col("__receipt").isNotNull()).alias("receipt"),
        _state(F.col("__candidate").isNotNull(), yes).alias("candidate"),
        _state(F.col("__intact").isNotNull(), F.col("__intact")).alias("manifest"),
        _state(F.col("__trace").isNotNull(), yes).alias("trace"),
    )
    states = F.array(*LINKS)
    code = F.when(F.array_contains(states, "FAIL"), 1).when(F.array_contains(states, "UNVERIFIABLE"), 3).otherwise(0)
    return out.withColumn("code", code)
