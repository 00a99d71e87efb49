"""Counts, reports and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A row for each value in their order, with its count; others are left out."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    fixed = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"{column} string, place int")
    return fixed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), "place")


def curation(events: DataFrame) -> DataFrame:
    """Counts of outcomes; the rate is of promoted among promoted and demoted."""
    of = lambda a: F.count_if(F.col("action") == a)
    return events.agg(of("promoted").alias("promoted"), of("demoted").alias("rejected"), of("superseded").alias("superseded"), of("archived").alias("archived")).withColumn("promotion_rate", rate(F.col("promoted"), F.col("promoted") + F.col("rejected")))


def health(memories: DataFrame, before: Column) -> DataFrame:
    """active, stale and freshness = clamp(1 - stale / active), 1 without active."""
    active, old = F.count_if(F.col("lifecycle") == "active"), F.count_if((F.col("lifecycle") == "active") & (F.col("updated_at") < before))
    row = memories.agg(F.count(F.lit(1)).alias("total"), active.alias("active"), old.alias("stale"))
    return row.withColumn("freshness", F.greatest(F.least(1 - rate(F.col("stale"), F.col("active")), F.lit(1.0)), F.lit(0.0)))


def tenants(memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both counts of every tenant that either side has."""
    one = memories.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_memories"))
    two = candidates.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return one.join(two, "tenant_id", "full_outer").select("tenant_id", F.coalesce("n_memories", F.lit(0)).alias("n_memories"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def cited_queries(log: DataFrame, since: Column, until: Column) -> DataFrame:
    """Per actor, both ends of the window included: total, cited, citations."""
    rows = log.where(F.col("time").between(since, until))
    return rows.groupBy("actor").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("citations") > 0).alias("cited"), F.sum("citations").alias("citations"))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, and precision, recall (1 without cases) and f1."""
    p, a = predicted.cast("boolean"), actual.cast("boolean")
    row = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp = F.col("tp")
    row = row.withColumn("precision", rate(tp, tp + F.col("fp"), 1.0)).withColumn("recall", rate(tp, tp + F.col("fn"), 1.0))
    total = F.col("precision") + F.col("recall")
    return row.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), total))


def status_sets(memories: DataFrame) -> DataFrame:
    """Counts by lifecycle, category, tenant and in all, in one pass."""
    columns = ["lifecycle", "category", "tenant_id"]
    sets = [[F.col(c)] for c in columns] + [[]]
    return memories.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n")).select(*columns, "n")


def retrieval(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall, reciprocal rank and nDCG at ``k``. ``results`` has
    query_id, doc_id, rank; ``gold`` query_id, doc_id. A query without results
    has zeros."""
    hits = results.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max(1 / F.col("rank")).alias("rr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = wanted.join(got, "query_id", "left")
    return out.select("query_id", (F.coalesce("n_hits", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce("rr", F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def system(memories: DataFrame, candidates: DataFrame, events: DataFrame, before: Column) -> DataFrame:
    """One row of the lifecycle, curation, health and tenant reports."""
    states = memories.agg(F.count_if(F.col("lifecycle") == "active").alias("n_active"), F.count(F.lit(1)).alias("n_memories"))
    states = states.withColumn("active_rate", rate(F.col("n_active"), F.col("n_memories")))
    outcomes = curation(events).select("promoted", "rejected", "promotion_rate")
    old = health(memories, before).select("stale", "freshness")
    both = tenants(memories, candidates).agg(F.count(F.lit(1)).alias("n_tenants"))
    return states.crossJoin(outcomes).crossJoin(old).crossJoin(both)  # a row each


def tenant_summary(memories: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Both counts of a tenant and how often each action occurs (a map), by
    name in the order of the Unicode collation."""
    actions = events.where("action is not null").groupBy("tenant_id", "action").agg(F.count(F.lit(1)).alias("n")).groupBy("tenant_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"))
    joined = tenants(memories, candidates).join(actions, "tenant_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = joined.select("tenant_id", zero("n_memories").alias("n_memories"), zero("n_candidates").alias("n_candidates"), "actions")
    return rows.orderBy(F.collate("tenant_id", "UNICODE"))


def rendered(report: DataFrame, title: str) -> DataFrame:
    """A one-row report as Markdown lines (pos, line): a heading, and a line
    for each column; rates as percent with one decimal."""
    cells = []
    for name in report.columns:
        value = F.col(name)
        shown = F.concat(F.format_number(value * 100, 1), F.lit("%")) if name.endswith("rate") or name == "freshness" else value.cast("string")
        cells.append(F.concat(F.lit(f"- {name}: "), F.coalesce(shown, F.lit("none"))))
    return report.select(F.posexplode(F.array(F.lit(f"# {title}"), F.lit(""), *cells)).alias("pos", "line"))


def floors(measured: DataFrame, wanted: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """stratum, measured, floor and ok: not more than ``epsilon`` below."""
    joined = wanted.join(measured, "stratum", "left")
    return joined.select("stratum", "measured", "floor", (F.coalesce("measured", F.lit(0.0)) >= F.col("floor") - epsilon).alias("ok"))


def proposed_floors(measured: DataFrame) -> DataFrame:
    """Measures as floors, four decimals, never above what was measured."""
    return measured.select("stratum", (F.floor(F.col("measured") * 10_000) / 10_000).alias("floor"))


def check_metrics(scored: DataFrame) -> DataFrame:
    """Per check: tp, fp, fn, tn, precision and recall (1 without cases), four
    decimals. ``scored`` has check, caught and expected, a row for every case
    that counts for a check."""
    hit = lambda c, e: F.count_if((F.col("caught") == c) & (F.col("expected") == e))
    rows = scored.groupBy("check").agg(hit(True, True).alias("tp"), hit(True, False).alias("fp"), hit(False, True).alias("fn"), hit(False, False).alias("tn"))
    share = lambda part, other: F.round(rate(F.col(part), F.col(part) + F.col(other), 1.0), 4)
    return rows.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def groundedness(items: DataFrame) -> DataFrame:
    """supported_precision, supported_recall, catch_rate and balanced accuracy
    of items with predicted and supported (booleans), four decimals."""
    p, s = F.col("predicted"), F.col("supported")
    n = lambda c: F.count_if(c)
    row = items.agg(n(p & s).alias("right"), n(p).alias("predicted"), n(s).alias("supported"), n(~p & ~s).alias("caught"), n(~s).alias("unsupported"))
    share = lambda part, whole: F.round(rate(F.col(part), F.col(whole), 1.0), 4)
    made = row.select(share("right", "predicted").alias("supported_precision"), share("right", "supported").alias("supported_recall"), share("caught", "unsupported").alias("catch_rate"))
    return made.withColumn("balanced", F.round((F.col("supported_recall") + F.col("catch_rate")) / 2, 4))
