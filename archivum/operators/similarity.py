"""Duplicate, supersession and contradiction checks between texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions import text as T
from archivum.operators import overlap
from archivum.storage import stored

KEYS = ["tenant_id", "category"]


def exact_duplicates(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Candidates with ``duplicate``: whether a memory of their tenant has the
    same content hash, in any lifecycle."""
    known = memories.select("tenant_id", "content_hash").distinct().withColumn("duplicate", F.lit(True))
    return candidates.join(known, ["tenant_id", "content_hash"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def first_in_batch(df: DataFrame, order: str = "id") -> DataFrame:
    """Adds ``first``: whether a row is the first of its tenant and content.

    The first ids are pre-aggregated, so a content that many rows share is one
    row of the join's small side and no task sorts its rows."""
    least = df.groupBy("tenant_id", "content_hash").agg(F.min(order).alias("__first"))
    return df.join(least, ["tenant_id", "content_hash"]).withColumn("first", F.col(order) == F.col("__first")).drop("__first")


def _classes(df: DataFrame, tokens: Column, name: Column) -> DataFrame:
    """tenant, category, class and its tokens (as hashes): rows that are alike
    are one class, so copies are compared once. Rows without tokens take no part."""
    rows = df.select(*KEYS, name.alias("class"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens")).where(F.size("tokens") > 0)
    return rows.groupBy(*KEYS, "class").agg(F.first("tokens").alias("tokens"))


def _members(df: DataFrame, name: Column, most: int) -> DataFrame:
    """The ``most`` smallest ids of each class; ranks are limited before the
    shuffle, so a class of many copies is not one task's."""
    order = F.row_number().over(Window.partitionBy(*KEYS, "class").orderBy("id"))
    rows = df.select(*KEYS, name.alias("class"), "id").distinct()
    return rows.withColumn("__n", order).where(F.col("__n") <= most).select(*KEYS, F.col("class").alias("right"), F.col("id").alias("right_id"))


def similar_classes(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """tenant, category, left, right and similarity of the classes whose
    Jaccard is at least ``threshold``: found by their rarest tokens (prefix
    filter) and sizes, not by all pairs.

    Two sets that similar share one of the first size - ceil(threshold * size)
    + 1 tokens in any common order; the order here is by frequency, then hash."""
    tokens = left.select(F.explode("tokens").alias("t")).unionAll(right.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("f"))

    def prefixes(df: DataFrame, name: str, n: str) -> DataFrame:
        rows = df.select(*KEYS, F.col("class").alias(name), F.size("tokens").alias(n), F.explode("tokens").alias("t")).join(tokens, "t")
        ordered = rows.groupBy(*KEYS, name, n).agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("own"))
        take = F.col(n) - F.ceil(F.col(n) * threshold - 1e-9).cast("int") + 1
        return ordered.select(*KEYS, name, n, F.explode(F.slice("own", 1, F.greatest(take, F.lit(1)))).alias("x")).select(*KEYS, name, n, F.col("x.t").alias("t"))

    near = F.least("n_left", "n_right") >= threshold * F.greatest("n_left", "n_right") - 1e-9
    pairs = prefixes(left, "left", "n_left").join(prefixes(right, "right", "n_right"), [*KEYS, "t"]).where(near).select(*KEYS, "left", "right").distinct()
    one = left.select(*KEYS, F.col("class").alias("left"), F.col("tokens").alias("left_tokens"))
    two = right.select(*KEYS, F.col("class").alias("right"), F.col("tokens").alias("right_tokens"))
    scored = pairs.join(one, [*KEYS, "left"]).join(two, [*KEYS, "right"]).withColumn("similarity", T.jaccard(F.col("left_tokens"), F.col("right_tokens"), 0.0))
    return scored.where(F.col("similarity") >= threshold).select(*KEYS, "left", "right", "similarity")


#: Sets of candidate pairs up to which their names are sent to all executors.
BROADCAST_NODES = 200_000
INTEGERS = ("byte", "short", "integer", "long")


def similar_texts(left: DataFrame, right: DataFrame, tokens: Column, name: Column, threshold: float, most: int | None = None) -> DataFrame:
    """As ``similar_classes``, of rows (with id) with long texts: whole sets are
    made again for the few pairs that the counts of ``overlap`` leave, one of a
    class of copies, and are never dealt out for all rows nor for each pair. A
    class is not compared with itself. Runs the counting when it is called.

    With ``most``, pairs that hold none of the ``most`` best ids of a left class
    (larger similarity, then smaller id) may be left out. Pairs grow as the square
    of a group of near copies, what is made of them then doesn't. Ids that are no
    integers have no order that a block knows: then nothing is left out."""
    whole_ids = left.schema["id"].dataType.typeName() in INTEGERS and right.schema["id"].dataType.typeName() in INTEGERS
    few = most is not None and whole_ids
    node, row = F.xxhash64(*KEYS, name), F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))) if few else F.xxhash64("id")

    def sets(df: DataFrame, *more: str) -> DataFrame:
        rows = df.where(" and ".join(f"{k} is not null" for k in KEYS))
        return rows.select(*KEYS, *more, name.alias("class"), node.alias("node"), row.alias("row"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("tokens"))

    pairs = stored((overlap.listed if few else overlap.candidates)(sets(left), sets(right), threshold, right.count()), "pairs")

    def whole(df: DataFrame, side: str) -> DataFrame:
        names = ("node", "row") if few else (f"{side}_node", f"{side}_row")
        found = pairs.where(F.col("on_left") == (side == "left")) if few else pairs
        wanted = found.select(*(F.col(c).alias(a) for c, a in zip((*names, "band", "part"), ("__node", "__row", "band", "part")))).distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
        return sets(df.withColumns({"__node": node, "__row": row}).join(wanted, ["__node", "__row"]), "band", "part").withColumn("on_left", F.lit(side == "left"))

    both = whole(left, "left").unionAll(whole(right, "right"))
    return overlap.closest(both, pairs, threshold, most) if few else overlap.scored(both, pairs, threshold)


def _best(pairs: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """The ``most`` best ids of every left class: larger similarity first, then
    smaller id."""
    rank = F.row_number().over(Window.partitionBy(*KEYS, "left").orderBy(F.desc("similarity"), "right_id"))
    found = pairs.join(members, [*KEYS, "right"]).withColumn("rank", rank).where(F.col("rank") <= most)
    return found.select(*KEYS, F.col("left").alias("class"), "rank", "right_id", "similarity")


def supersessions(candidates: DataFrame, memories: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The best active memory that each candidate's title resembles: left_id,
    right_id, similarity; ties to the smaller id. Two titles without a word
    are not compared."""
    active = memories.where("lifecycle = 'active'")
    tokens = T.title_tokens(F.col("title"))
    name = F.sha2(F.array_join(F.array_sort(tokens), " ").cast("binary"), 256)
    pairs = similar_classes(_classes(candidates, tokens, name), _classes(active, tokens, name), threshold)
    # Two, as the best may be the candidate itself.
    best = _best(pairs, _members(active, name, 2), 2)
    rows = candidates.select(F.col("id").alias("left_id"), *KEYS, name.alias("class")).join(best, [*KEYS, "class"]).where("left_id <> right_id")
    return rows.groupBy("left_id").agg(F.min_by(F.struct("right_id", "similarity"), "rank").alias("b")).select("left_id", "b.*")


def contradictions(candidates: DataFrame, memories: DataFrame, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """Up to ``most`` active memories that overlap a candidate's content
    without being equal, most similar first, with their rank."""
    active = memories.where("lifecycle = 'active'")
    tokens, name = T.content_tokens(F.col("content")), F.col("content_hash")
    pairs = similar_texts(candidates, active, tokens, name, threshold, most).where(F.col("left") != F.col("right"))
    best = _best(pairs, _members(active, name, most), most)
    rows = candidates.select(F.col("id").alias("left_id"), *KEYS, name.alias("class")).join(best, [*KEYS, "class"])
    return rows.select("left_id", "rank", "right_id", "similarity")
