"""Anchors of the audit chain, and breaks that are documented beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.operators.audit import with_position

BODY = ["schemaVersion", "anchoredAt", "tenantId", "chainedRows", "chainHead", "prevAnchorHash"]
PINNED = ["entry_hash", "prev_entry_hash", "hash_version", "seq", "reason"]


def with_anchor_hash(anchors: DataFrame, name: str = "computed") -> DataFrame:
    """SHA-256 of the body in fixed key order, nulls kept."""
    body = F.to_json(F.struct(*BODY), {"ignoreNullFields": "false"})
    return anchors.withColumn(name, F.sha2(body.cast("binary"), 256))


def anchor_breaks(anchors: DataFrame, rows: DataFrame, chain: str = "tenant_id") -> DataFrame:
    """tenantId, index and reason of every break: an edited anchor, a broken
    link of the log, a chain shorter than anchored, another head at the
    anchored place. ``anchors`` is ordered by ``index`` within a tenant."""
    held = rows.where(F.col("entry_hash").isNotNull())
    placed = with_position(held, by=[chain]).select(F.col(chain).alias("tenantId"), F.col("position").alias("chainedRows"), F.col("entry_hash").alias("head"))
    totals = held.groupBy(F.col(chain).alias("tenantId")).agg(F.count(F.lit(1)).alias("total"))
    before = F.lag("anchorHash").over(Window.partitionBy("tenantId").orderBy("index"))
    judged = with_anchor_hash(anchors).withColumn("before", before).join(placed, ["tenantId", "chainedRows"], "left").join(totals, "tenantId", "left")
    reasons = F.array(
        F.when(F.col("computed") != F.col("anchorHash"), "ANCHOR_HASH_MISMATCH"),
        F.when(~F.col("prevAnchorHash").eqNullSafe(F.col("before")), "ANCHOR_LINK_MISMATCH"),
        F.when(F.col("chainedRows") > F.coalesce("total", F.lit(0)), "HISTORY_TRUNCATED").when((F.col("chainedRows") > 0) & (F.col("head") != F.col("chainHead")), "HISTORY_REWRITTEN"),
    )
    return judged.select("tenantId", "index", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def break_counts(breaks: DataFrame) -> DataFrame:
    """truncated, rewritten and log (hash or link of the log itself)."""
    of = lambda *r: F.count_if(F.col("reason").isin(*r))
    return breaks.agg(of("HISTORY_TRUNCATED").alias("truncated"), of("HISTORY_REWRITTEN").alias("rewritten"), of("ANCHOR_HASH_MISMATCH", "ANCHOR_LINK_MISMATCH").alias("log"))


def appended(log: DataFrame, heads: DataFrame, anchored_at: str) -> DataFrame:
    """The last anchor of every chain after anchoring ``heads`` (tenantId,
    chainedRows, chainHead): the log's own where head and count haven't
    changed (appended is false), else a new one that links to it."""
    last = log.groupBy("tenantId").agg(F.max_by(F.struct(*[c for c in log.columns if c != "tenantId"]), "index").alias("last"))
    both = heads.join(last, "tenantId", "left")
    same = F.coalesce((F.col("last.chainedRows") == F.col("chainedRows")) & (F.col("last.chainHead") == F.col("chainHead")), F.lit(False))
    at = F.when(same, F.col("last.anchoredAt")).otherwise(F.lit(anchored_at))
    link = F.when(same, F.col("last.prevAnchorHash")).otherwise(F.col("last.anchorHash"))
    made = both.select(F.lit(1).alias("schemaVersion"), at.alias("anchoredAt"), "tenantId", "chainedRows", "chainHead", link.alias("prevAnchorHash"), (~same).alias("appended"))
    return with_anchor_hash(made, "anchorHash")


def classified(breaks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``class``: documented (all pinned fields equal the manifest's),
    fork (never documented) or tamper."""
    pinned = manifest.select("id", *[F.col(c).alias(f"__{c}") for c in PINNED])
    same = F.lit(True)
    for c in PINNED:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = breaks.join(pinned.withColumn("__listed", F.lit(True)), "id", "left")
    kind = F.when(F.col("reason") == "fork", "fork").when(F.coalesce("__listed", F.lit(False)) & same, "documented").otherwise("tamper")
    return joined.withColumn("class", kind).select(*breaks.columns, "class")


def verified_files(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """path and state: ``files`` has path and content, ``sidecars`` path and
    sha256 (null if the sidecar can't be read)."""
    listed = sidecars.withColumn("__listed", F.lit(True))
    joined = files.join(listed, "path", "left")
    state = F.when(F.col("__listed").isNull(), "no_manifest").when(F.col("sha256").isNull(), "error").when(F.sha2("content", 256) == F.col("sha256"), "verified").otherwise("tampered")
    return joined.select("path", state.alias("state"))
