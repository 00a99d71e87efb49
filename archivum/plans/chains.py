"""Registered queries of the audit chain and its anchors (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.operators import anchors, audit
from archivum.plans import domain as D
from archivum.plans.registry import query


def events(s, d):
    """The audit events as they are hashed, a chain for each tenant."""
    return D.audit_events(s, d).select("tenant_id", "seq", F.col("id").cast("string").alias("id"), "action", F.col("memory_id").cast("string").alias("memory_id"), "details_json")


def counted():
    return F.count(F.lit(1)).alias("n")


@query("SELECT seq, id, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY seq) - 1 AS BIGINT) AS before FROM audit_events")
def n1_append(s, d):
    """How many rows of its chain each row's hashes lead back to."""
    made = audit.chained(events(s, d), "tenant_id")
    placed = audit.with_position(made.select("tenant_id", "seq", "id", "entry_hash"), by=["tenant_id"])
    prev = placed.select("tenant_id", F.col("entry_hash").alias("prev_entry_hash"), F.col("position").alias("before"))
    joined = made.select("tenant_id", "seq", "id", "prev_entry_hash").join(prev, ["tenant_id", "prev_entry_hash"], "left")
    return joined.select("seq", F.col("id").cast("long").alias("id"), F.coalesce("before", F.lit(0)).cast("long").alias("before"))


FIRST_SQL = ", p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS position, lag(seq) OVER (PARTITION BY tenant_id ORDER BY seq) AS last FROM audit_events) "


@query(FIRST_SQL + "SELECT tenant_id, CASE WHEN position = 2 THEN 'content' END AS reason, count(*) AS n FROM p GROUP BY ALL")
def n2_verify_chain(s, d):
    """The second row of every chain is changed after it was hashed."""
    made = audit.chained(events(s, d), "tenant_id")
    second = audit.with_position(made.select("tenant_id", "seq"), by=["tenant_id"]).where("position = 2").select("tenant_id", "seq").withColumn("edited", F.lit(True))
    changed = made.join(second, ["tenant_id", "seq"], "left").withColumn("action", F.when(F.col("edited"), "deleted!").otherwise(F.col("action"))).drop("edited")
    return audit.verify_chain(changed, by=["tenant_id"]).groupBy("tenant_id", "reason").agg(counted())


GAPS_SQL = FIRST_SQL + ", judged AS (SELECT seq, tenant_id, CASE WHEN last % 97 = 0 THEN 'link' END AS reason FROM p WHERE seq % 97 > 0) "


def with_gaps(s, d):
    """The chains without every row whose seq is a multiple of 97."""
    made = audit.chained(events(s, d), "tenant_id").where("seq % 97 <> 0")
    return audit.verify_chain(made, by=["tenant_id"])


@query(GAPS_SQL + "SELECT coalesce(reason, 'clean') AS reason, count(*) AS n FROM judged GROUP BY 1")
def e25_break_histogram(s, d):
    return with_gaps(s, d).groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(counted())


@query(GAPS_SQL + "SELECT CASE WHEN seq % 2 = 0 THEN 'documented' ELSE 'tamper' END AS class, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def d15_documented_breaks(s, d):
    """Breaks of even rows are in the manifest, with all that is pinned."""
    judged = with_gaps(s, d).where("reason is not null").withColumn("hash_version", F.lit(2))
    return anchors.classified(judged, judged.where("seq % 2 = 0")).groupBy("class").agg(counted())


@query(GAPS_SQL + "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'tamper' WHEN seq % 2 = 0 THEN 'documented' ELSE 'tamper' END AS class FROM judged WHERE reason IS NOT NULL")
def n7_classified_breaks(s, d):
    """A manifest that pins another version for every third row is of no use."""
    judged = with_gaps(s, d).where("reason is not null").withColumn("hash_version", F.lit(2))
    manifest = judged.where("seq % 2 = 0").withColumn("hash_version", F.when(F.col("seq") % 3 == 0, 1).otherwise(2))
    return anchors.classified(judged, manifest).select("seq", "class")


def anchored(s, d):
    """Chains with anchors after 10, 20 and 30 rows; the second names another
    head, the third claims to follow it, and the first is edited."""
    chain = audit.chained(events(s, d), "tenant_id")
    heads = audit.with_position(chain, by=["tenant_id"]).where("position in (10, 20, 30)")
    base = heads.select(
        (F.col("position") / 10 - 1).cast("int").alias("index"), F.lit(1).alias("schemaVersion"), F.lit("2026-01-01T00:00:00.000Z").alias("anchoredAt"), F.col("tenant_id").alias("tenantId"),
        F.col("position").alias("chainedRows"), F.when(F.col("position") == 20, "x").otherwise(F.col("entry_hash")).alias("chainHead"), F.lit(None).cast("string").alias("prevAnchorHash"),
    )
    hashed = anchors.with_anchor_hash(base, "anchorHash")
    return hashed.withColumn("anchoredAt", F.when(F.col("index") == 0, "edited").otherwise(F.col("anchoredAt"))), chain


BREAKS_SQL = """, c AS (SELECT tenant_id, count(*) AS n FROM audit_events GROUP BY 1),
    b AS (SELECT tenant_id AS "tenantId", CAST(i AS INTEGER) AS index, reason FROM c, (VALUES (0, 10, 'ANCHOR_HASH_MISMATCH'), (1, 20, 'ANCHOR_LINK_MISMATCH'), (1, 20, 'HISTORY_REWRITTEN'), (2, 30, 'ANCHOR_LINK_MISMATCH')) r(i, k, reason) WHERE n >= k) """


@query(BREAKS_SQL + 'SELECT "tenantId", index, reason FROM b')
def n3_anchor_breaks(s, d):
    return anchors.anchor_breaks(*anchored(s, d))


@query(BREAKS_SQL + "SELECT count(*) FILTER (reason = 'HISTORY_TRUNCATED') AS truncated, count(*) FILTER (reason = 'HISTORY_REWRITTEN') AS rewritten, count(*) FILTER (reason LIKE 'ANCHOR%') AS log FROM b")
def e26_anchor_break_counts(s, d):
    return anchors.break_counts(anchors.anchor_breaks(*anchored(s, d)))


@query("SELECT side, coalesce(reason, 'clean') AS reason, CAST(n AS BIGINT) AS n FROM (SELECT 'a' AS side, NULL AS reason, count(*) FILTER (seq % 2 = 0) AS n FROM audit_events UNION ALL SELECT 'b', NULL, count(*) FILTER (seq % 3 = 0) FROM audit_events UNION ALL SELECT 'merged', NULL, count(*) FILTER (seq % 2 = 0 OR seq % 3 = 0) FROM audit_events)")
def n5_verify_merge(s, d):
    """Each clone's chain, and that of the merged rows in the order of seq."""
    rows = events(s, d)
    parts = {"a": rows.where("seq % 2 = 0"), "b": rows.where("seq % 3 = 0"), "merged": rows.where("seq % 2 = 0 or seq % 3 = 0")}
    out = None
    for side, part in parts.items():
        judged = audit.verify_chain(audit.chained(part, "tenant_id"), by=["tenant_id"])
        counts = judged.groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(counted()).select(F.lit(side).alias("side"), "reason", "n")
        out = counts if out is None else out.unionAll(counts)
    return out


@query("SELECT tenant_id, count(*) AS n, true AS is_last FROM audit_events GROUP BY tenant_id")
def n6_chain_heads(s, d):
    """The head is the hash that no other row of the chain follows."""
    made = audit.chained(events(s, d), "tenant_id")
    heads = audit.heads(made, ["tenant_id"])
    followed = made.select("tenant_id", F.col("prev_entry_hash").alias("head")).where("head is not null").withColumn("followed", F.lit(True))
    return heads.join(followed, ["tenant_id", "head"], "left").select("tenant_id", "n", F.col("followed").isNull().alias("is_last"))


@query("SELECT 'whole' AS chain, 0 AS code UNION ALL SELECT 'gaps', 2 UNION ALL SELECT 'fork', 1")
def n8_exit_codes(s, d):
    made = audit.chained(events(s, d), "tenant_id")
    # A fork: a second row that follows a chain's first one, with its own hash.
    forked = audit.verify_chain(made.where("tenant_id = 't0'")).withColumn("reason", F.when(F.col("position") == 3, "fork"))
    whole, gaps = audit.verify_chain(made, by=["tenant_id"]), with_gaps(s, d)
    code = lambda judged, name: audit.exit_code(judged).select(F.lit(name).alias("chain"), "code")
    return code(whole, "whole").unionAll(code(gaps, "gaps")).unionAll(code(forked, "fork"))


@query("SELECT tenant_id, id, CAST(seq AS BIGINT) AS seq FROM (SELECT tenant_id, id, seq FROM audit_events WHERE id % 2 = 0 UNION ALL SELECT tenant_id, id, row_number() OVER (ORDER BY id) + (SELECT max(seq) FROM audit_events WHERE id % 2 = 0) AS seq FROM audit_events WHERE id % 2 = 1)")
def p14_append_order(s, d):
    """New rows get the next numbers in the order of writing, not of time."""
    rows = D.audit_events(s, d).select("tenant_id", "id", "seq")
    return audit.appended(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id")
