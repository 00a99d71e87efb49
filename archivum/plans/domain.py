"""The domain tables, projected from the given ones, in Spark and in SQL.

Both sides of a query start from the same projection: ``memories(spark, dir)``
and the CTE of the same name in ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The closed vocabularies, in their order.
CATEGORIES = ["decision", "pattern", "convention", "architecture", "troubleshooting", "onboarding", "reference"]
LIFECYCLES = ["active", "deprecated", "superseded", "archived"]
SOURCES = ["claude_session", "manual", "import", "mcp", "bulk_import"]
TRUST = ["high", "medium", "low", "untrusted"]
SENSITIVITY = ["public", "internal", "confidential", "restricted"]
STATUS = ["inbox", "promoted", "rejected", "flagged", "duplicate", "quarantined"]
LINK_TYPES = ["relates_to", "supersedes", "contradicts", "depends_on", "part_of"]
#: (from, to): the lifecycle changes that are allowed.
TRANSITIONS = [("active", "deprecated"), ("active", "superseded"), ("active", "archived"), ("deprecated", "active"), ("deprecated", "archived"), ("superseded", "archived")]
#: The projection's own.
LIFECYCLE_BY_TEN = ["active"] * 7 + ["deprecated", "superseded", "archived"]
NOW = "2026-01-01 00:00:00"
#: The namespace of derived ids: that of domain names (RFC 4122).
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
ACTION_OF_EVENT = {"signup": "proposed", "error": "demoted", "click": "promoted", "view": "superseded", "purchase": "archived"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    days = F.pmod(F.col("id"), F.lit(365)).cast("int")
    return docs.select(
        "id",
        F.col("lang").alias("tenant_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        _pick(CATEGORIES, "id").alias("category"),
        _pick(LIFECYCLE_BY_TEN, "id").alias("lifecycle"),
        _pick(SOURCES, "id").alias("source"),
        _pick(TRUST, "id").alias("trust_level"),
        _pick(SENSITIVITY, "id").alias("sensitivity"),
        _pick(STATUS, "id").alias("status"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(days)).alias("updated_at"),
        F.lit(1).alias("version"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [F.lit(x) for item in ACTION_OF_EVENT.items() for x in item]
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_id") + 1).alias("seq"),
        F.try_element_at(F.create_map(*pairs), F.col("event_type")).alias("action"),
        F.col("user_id").alias("memory_id"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(4))).alias("tenant_id"),
        F.col("ts").alias("timestamp"),
        F.col("value"),
        F.col("props").alias("details_json"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return rows.select(F.col("user_id").alias("actor"), F.col("ts").alias("time"), F.pmod(F.floor("value").cast("long"), F.lit(3)).alias("citations"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (source, target, type), with the largest weight."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.pmod("l_partkey", F.lit(500)).alias("source_id"),
        F.pmod("l_suppkey", F.lit(500)).alias("target_id"),
        _pick(LINK_TYPES, "l_linenumber").alias("link_type"),
        F.col("l_discount").alias("weight"),
    )
    return rows.groupBy("source_id", "target_id", "link_type").agg(F.max("weight").alias("weight"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"memories": memories(spark, sf_dir), "audit_events": audit_events(spark, sf_dir), "links": links(spark, sf_dir), "access_log": access_log(spark, sf_dir)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick_sql(values: list[str], key: str) -> str:
    return f"({_list(values)})[CAST({key} % {len(values)} AS INTEGER) + 1]"


WITH = f"""WITH RECURSIVE memories AS (
  SELECT doc_id AS id, lang AS tenant_id, split_part(text, chr(10), 1) AS title, text AS content,
    {_pick_sql(CATEGORIES, 'doc_id')} AS category, {_pick_sql(LIFECYCLE_BY_TEN, 'doc_id')} AS lifecycle,
    {_pick_sql(SOURCES, 'doc_id')} AS source, {_pick_sql(TRUST, 'doc_id')} AS trust_level,
    {_pick_sql(SENSITIVITY, 'doc_id')} AS sensitivity, {_pick_sql(STATUS, 'doc_id')} AS status,
    sha256(text) AS content_hash, TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 365 AS INTEGER)) AS updated_at, 1 AS version
  FROM documents
), audit_events AS (
  SELECT event_id AS id, event_id + 1 AS seq,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION_OF_EVENT.items())} END AS action,
    user_id AS memory_id, 't' || (user_id % 4) AS tenant_id, ts AS timestamp, value, props AS details_json
  FROM events
), access_log AS (
  SELECT user_id AS actor, ts AS time, CAST(floor(value) AS BIGINT) % 3 AS citations FROM events WHERE event_type IN ('click', 'view')
), links AS (
  SELECT l_partkey % 500 AS source_id, l_suppkey % 500 AS target_id, {_pick_sql(LINK_TYPES, 'l_linenumber')} AS link_type, max(l_discount) AS weight
  FROM lineitem GROUP BY ALL
)
"""
