"""The hash-chained audit log.

A row's link to its predecessor is checked by the order number of the rows
that carry a hash, given by counts per range of ``seq`` and not by one ordered
window over the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.hashing import canonical_audit_json

#: Rows of ``seq`` that one window orders.
RANGE = 100_000


def with_position(df: DataFrame, order: str = "seq", by: list[str] = [], bucket: Column | None = None) -> DataFrame:  # noqa: B006
    """Adds ``position`` (from 1) by ``order`` within ``by``. Ranges of
    ``order`` (``bucket``, which must rise with it; by default a number's
    RANGE) are numbered apart and shifted by the counts of those before; only
    those counts are ordered in one task."""
    ranged = df.withColumn("__range", F.floor(F.col(order) / RANGE) if bucket is None else bucket)
    counts = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order))
    return ranged.join(before.select(*by, "__range", "__before"), [*by, "__range"]).withColumn("position", own + F.col("__before")).drop("__range", "__before")


def chained(rows: DataFrame, chain: str) -> DataFrame:
    """Adds prev_entry_hash and entry_hash to new rows (seq, id, action,
    memory_id, tenant_id, details_json), in the order of ``seq`` within each
    chain. A hash covers the one before, so a chain is written by one task, a
    batch of rows at a time: its rows are ordered, and only the last hash held."""
    import hashlib
    import json

    fields = ["id", "action", "memory_id", "tenant_id", "actor_json", "reason", "details_json"]

    def run(batches):
        last: dict = {}
        for batch in batches:
            prev, own = [], []
            for row in batch.to_dict("records"):
                before = last.get(row[chain])
                body = {f: row.get(f) for f in fields} | {"prev_entry_hash": before}
                digest = hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
                prev.append(before)
                own.append(digest)
                last[row[chain]] = digest
            batch["prev_entry_hash"], batch["entry_hash"] = prev, own
            yield batch

    full = rows.withColumns({"actor_json": F.lit("{}"), "reason": F.lit("")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema) + ", prev_entry_hash string, entry_hash string"
    return full.repartition(chain).sortWithinPartitions(chain, "seq").mapInPandas(run, schema)


def verify_chain(rows: DataFrame, version: int = 2, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows with a hash, each with ``reason``: null, ``content`` (the hash is
    not its content's), ``both`` (nor does it follow any row), ``fork`` (it
    follows an earlier row than the last) or ``link`` (it follows none). Rows
    without a hash are not judged. ``by`` tells chains apart."""
    chained = with_position(rows.where(F.col("entry_hash").isNotNull()), by=by)
    chained = chained.withColumn("content_ok", F.sha2(canonical_audit_json(F.col("prev_entry_hash"), version).cast("binary"), 256) == F.col("entry_hash"))
    last = chained.select(*by, (F.col("position") + 1).alias("position"), F.col("entry_hash").alias("expected"))
    linked = chained.join(last, [*by, "position"], "left")
    seen = chained.where("content_ok").groupBy(*by, F.col("entry_hash").alias("prev_entry_hash")).agg(F.min("position").alias("seen_at"))
    judged = linked.join(seen, [*by, "prev_entry_hash"], "left")
    link_ok = F.col("prev_entry_hash").eqNullSafe(F.col("expected"))
    reason = F.when(~F.col("content_ok") & ~link_ok, "both").when(~F.col("content_ok"), "content").when(~link_ok & (F.col("seen_at") < F.col("position")), "fork").when(~link_ok, "link")
    return judged.withColumn("__why", reason).select(*[c for c in rows.columns if c != "reason"], "position", F.col("__why").alias("reason"))


def totals(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """total, unverified (rows without a hash), clean and breaks."""
    all_rows = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("entry_hash").isNull()).alias("unverified"))
    found = judged.agg(F.count_if(F.col("reason").isNull()).alias("clean"), F.count_if(F.col("reason").isNotNull()).alias("breaks"))
    return all_rows.crossJoin(found)  # a row each


def heads(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n and head: how many rows carry a hash, and the last one's."""
    return rows.where(F.col("entry_hash").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by("entry_hash", "seq").alias("head"))


def exit_code(judged: DataFrame) -> DataFrame:
    """2 if any row is no longer what it was, 1 if there are only forks, 0."""
    tampered = F.count_if(F.col("reason").isin("content", "link", "both")) > 0
    return judged.agg(F.when(tampered, 2).when(F.count_if(F.col("reason") == "fork") > 0, 1).otherwise(0).alias("code"))


def appended(base: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``base`` with ``rows`` after its last ``seq``, in the given order; the
    order of times doesn't matter."""
    last = base.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    placed = with_position(rows.drop("seq"), order).crossJoin(last)  # one row
    return base.unionByName(placed.withColumn("seq", F.col("position") + F.col("__last")).select(*base.columns))
