"""What a caller can ask: one function for each kind of request.

``tables`` are the domain tables by name (``plans.domain.tables`` or a store's
own). Every function is lazy and gives a DataFrame. HTTP, authentication and
body limits are left to the server in front.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import text as T
from archivum.operators import curation, graph, policy, records, search

Tables = dict[str, DataFrame]
#: A retrieval function: documents and a query to (id, score).
Retrieve = Callable[[DataFrame, str], DataFrame]


def search_records(tables: Tables, query: str, now: Column, scope: str = "curated", tenants: list[str] = [], number: int = 1, size: int = 20, retrieve: Retrieve = search.bm25) -> DataFrame:  # noqa: B006
    """A page of cited hits: id, score (1 at most) and total, best first."""
    rows = records.visible_to(records.visible(records.in_scope(tables["memories"], scope)), tenants)
    hits = search.top(retrieve(rows, query).select("id", F.round("score", 9).alias("score")), 100)
    ranked = search.rerank(hits, rows, now).select("id", F.least("final_score", F.lit(1.0)).alias("score"), "final_score")
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    return search.page(ranked, number, size, [F.desc("final_score"), F.asc("id")]).select("id", "score").crossJoin(total)  # one row


def record(tables: Tables, key=None, content_hash: str | None = None, tenants: list[str] = []) -> DataFrame:  # noqa: B006
    """One record by id or by the hash of its content; none that a token's
    tenants may not see."""
    rows = records.visible_to(tables["memories"], tenants)
    return records.find_first(rows, **({"id": key} if key is not None else {"content_hash": content_hash}))


def record_list(tables: Tables, tenant: str | None, lifecycle: str | None = None, category: str | None = None) -> DataFrame:
    """Records of a tenant; without one, none."""
    rows = tables["memories"]
    return records.find(rows, tenant_id=tenant, lifecycle=lifecycle, category=category) if tenant else rows.limit(0)


def neighbours(tables: Tables, key) -> DataFrame:
    return graph.neighbours(tables["links"], key).orderBy(F.desc("weight"), "id", "direction")


def reachable(tables: Tables, key, depth: int = 2) -> DataFrame:
    """Within 1 to 5 steps."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is from 1 to 5")
    return graph.traverse(tables["links"], key, depth)


def candidates(tables: Tables, tenant: str, status: str | None = None) -> DataFrame:
    return records.find(tables["memories"], tenant_id=tenant, status=status)


def submit(tables: Tables, data: DataFrame, actor: str, role: str, tenants: list[str], channels: list[str]) -> DataFrame:
    """id and outcome of candidates that come in."""
    return curation.intake(curation.overridden(data, actor, role, tenants), tables["memories"], channels)


def audit_trail(tables: Tables, tenant: str | None = None, memory: int | None = None, action: str | None = None) -> DataFrame:
    """Events in their order; a record given outranks an action."""
    if memory is not None:
        action = None
    return records.find(tables["audit_events"], tenant_id=tenant, memory_id=memory, action=action).orderBy("timestamp", "seq")


def policy_rules(rules: list[tuple[str, dict, str]], tables: Tables) -> DataFrame:
    """What rules, by name, say of every record."""
    return policy.evaluate(tables["memories"], policy.from_registry(rules))


def import_preview(tables: Tables, notes: DataFrame) -> DataFrame:
    return curation.vault_preview(notes, tables["memories"], tables["memories"].limit(0))


def with_links_resolved(rows: DataFrame, resolver: Callable[[Column], Column]) -> DataFrame:
    """``content`` with wiki links as ``resolver(slug)`` says where they lead;
    null leaves the label alone."""

    def target(slug: Column, label: Column) -> Column:
        place = resolver(slug)
        return F.when(place.isNull(), label).otherwise(F.concat(F.lit("["), label, F.lit("]("), place, F.lit(")")))

    made = T.with_rewritten_links(rows, "content", "__made", target)
    return made.withColumn("content", F.col("__made")).drop("__made")


def with_callbacks(rows: DataFrame, callbacks: dict[str, Callable[[], Column]]) -> DataFrame:
    """Adds a column for each evaluation; one that can't be built is null."""
    for name, build in callbacks.items():
        try:
            made = rows.withColumn(name, build())
            made.schema  # noqa: B018  analysed here, so that a wrong column is found now
            rows = made
        except Exception:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows
