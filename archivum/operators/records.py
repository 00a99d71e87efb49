"""Finders, writes and lifecycle changes of governed records (lazy plans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.plans.domain import TRANSITIONS

SENSITIVITY_ORDER = ["public", "internal", "confidential", "restricted"]


def find(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to all given values; a list means any of it, an empty list
    or None no condition. The condition reaches the scan."""
    for column, value in equal.items():
        if value is None or value == []:
            continue
        df = df.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return df


def find_first(df: DataFrame, order: str = "id", **equal) -> DataFrame:
    """The row with the smallest ``order`` among those found, or none."""
    return find(df, **equal).orderBy(order).limit(1)


def stale(df: DataFrame, before: Column) -> DataFrame:
    """Active rows updated strictly before an instant."""
    return df.where((F.col("lifecycle") == "active") & (F.col("updated_at") < before))


def like_search(df: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Title or content contains the query, A-Z in either case; no wildcards."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    needle = fold(F.lit(query))
    return df.where(F.contains(fold(F.col("title")), needle) | F.contains(fold(F.col("content")), needle)).orderBy("id").limit(limit)


def visible(df: DataFrame) -> DataFrame:
    """Without confidential and restricted rows; unknown counts as public."""
    return df.where(~F.coalesce("sensitivity", F.lit("public")).isin("confidential", "restricted"))


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """curated hides bulk imports, bulk shows them alone, others show all."""
    if scope == "curated":
        return df.where("source <> 'bulk_import'")
    return df.where("source = 'bulk_import'") if scope == "bulk" else df


def exportable(df: DataFrame) -> DataFrame:
    """Below confidential in the order of levels; an unknown level passes."""
    level = F.array_position(F.array(*[F.lit(x) for x in SENSITIVITY_ORDER]), F.col("sensitivity"))
    return df.where(level < 3)


def with_transition(df: DataFrame, target: Column) -> DataFrame:
    """Adds ``outcome``: unchanged, allowed or illegal, for a change of
    lifecycle to ``target``."""
    allowed = F.lit(False)
    for old, new in TRANSITIONS:
        allowed = allowed | ((F.col("lifecycle") == old) & (target == new))
    return df.withColumn("target", target).withColumn("outcome", F.when(F.col("lifecycle") == F.col("target"), "unchanged").when(allowed, "allowed").otherwise("illegal"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of the same key replaced and new ones appended."""
    return base.join(changes.select(key), key, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def insert_new(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and those rows whose key it hasn't, each key once."""
    fresh = rows.dropDuplicates(key).join(base.select(*key), key, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti").select(*base.columns)


def repo_scope(df: DataFrame, url: str) -> DataFrame:
    """kept, skipped and unscoped: rows whose ``repo_url`` is the given one
    (trimmed, without ``.git``, in any case), another, or none, which is kept too."""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\.git$", ""))
    same = bare(F.col("repo_url")) == bare(F.lit(url))
    return df.agg(F.count_if(same).alias("kept"), F.count_if(~same).alias("skipped"), F.count_if(F.col("repo_url").isNull()).alias("unscoped"))


def visible_to(df: DataFrame, tenants: list[str]) -> DataFrame:
    """Rows of the tenants that a token is for; all for a token without any."""
    return df.where(F.col("tenant_id").isin(tenants)) if tenants else df


def beyond_mark(df: DataFrame, mark: DataFrame) -> DataFrame:
    """Rows updated strictly after the mark (one row: last_exported_at); all
    where it is null or there is none."""
    last = mark.agg(F.max("last_exported_at").alias("__mark"))
    return df.crossJoin(last).where(F.col("__mark").isNull() | (F.col("updated_at") > F.col("__mark"))).drop("__mark")  # one row
