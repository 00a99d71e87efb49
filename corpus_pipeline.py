"""The corpus pipeline: from ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.llm import bpe, decontamination, neardup, quality, secrets
from archivum.llm._shared import discard, plain_name, remainder, stored, table

#: Documents that score below it are rejected.
QUALITY_THRESHOLD = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def with_hash(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a column for the hash of the text: an id may occur with
    several texts, and a decision is about one of them."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) isn't among the
    (id, h) of ``gone``; null ids count as equal."""
    h = plain_name("h", docs.columns)
    gone = gone.select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    marked = with_hash(docs, h)
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["__id"]) & (marked[h] == gone["__h"]), "left_anti").select(*[marked[f"`{c}`"] for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality network rejects. It is fitted on
    labelled documents whose crc32 modulo 5 is not 0.

    Null and empty texts are scored as empty ones; repeated rows share their
    fate; an empty table stays empty; other columns are kept, whatever their
    names."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder(F.col("doc_id"), 5) != 0)
    network = quality.learn(labels, docs, "doc_id", "text", "quality")
    score, predicted = plain_name("score", docs.columns), plain_name("predicted", docs.columns)
    scored = quality.predict(docs, network, QUALITY_THRESHOLD, keep=docs.columns, names=(score, predicted))
    return scored.where(F.col(predicted) == 1).select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles,
    similarity of 0.8 or more): the one with the smallest id.

    A document is an id with a text: other texts of the same id are judged by
    themselves, and rows that repeat both are copies, of which one stays. Rows
    without an id are copies of others if their texts are. Texts without words
    are all kept."""
    found = stored(neardup.near_duplicates(docs, by_text=True), "groups")
    others = found.where(~F.col("kept"))
    repeats = stored(found.where("kept and n_shingles > 0").groupBy("id", "h").count().where("count > 1").select("id", "h"), "repeats")
    left = without(docs, others)
    if repeats.isEmpty():
        return left
    h = plain_name("h", docs.columns)
    marked = with_hash(docs, h)
    again = marked.join(repeats.select(F.col("id").alias("__id"), F.col("h").alias("__h")), marked["doc_id"].eqNullSafe(F.col("__id")) & (marked[h] == F.col("__h")), "left_semi")
    one = again.dropDuplicates(["doc_id", h]).select(*[f"`{c}`" for c in docs.columns])
    return without(left, repeats).union(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark. Other texts of
    the same id are judged by themselves; null and wordless texts stay."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias("id"), "h"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Null texts stay null,
    with null n_chars; every row is kept."""
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether they decode to the text
    (null: empty). Every row is kept; other columns are not."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    back = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"], decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", to_tokens),
]
#: The stages learn and hash in ways that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
            if before is not None:
                discard(before)
            before = docs
    return docs
