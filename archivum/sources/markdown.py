"""Markdown records: rendering with front matter, and parsing it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rendered(keys: list[str]) -> Column:
    """Front matter of ``keys`` in their order, ``# title`` and the content."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    lines = [F.concat(F.lit(f'{k}: "'), F.coalesce(quoted(k), F.lit("")), F.lit('"')) for k in keys]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), "content", F.lit(""))


def parsed(text: Column) -> Column:
    """struct(front, body): ``key: value`` lines of the front matter as a map
    (comments skipped, the last of equal keys wins), and the trimmed body."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^\s*[^#:\s][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), '^"(.*)"$', "$1").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", ""), r"\A\s+|\s+\z", "")
    return F.struct(F.map_from_entries(last).alias("front"), body.alias("body"))


def vault(spark: SparkSession, root: str) -> DataFrame:
    """path and text of the Markdown files below ``root``: hidden tool folders
    and blank files are left out."""
    files = spark.read.format("text").option("recursiveFileLookup", True).option("wholetext", True).load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    kept = files.where(F.col("path").rlike(r"(?i)\.(md|markdown|mdx)$") & ~F.col("path").rlike(r"/(\.obsidian|\.trash|\.git|node_modules)/"))
    return kept.where(F.col("text").rlike(r"\S"))


def vault_count(spark: SparkSession, root: str) -> int:
    """How many files ``vault`` lists before it looks into them: blank ones count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.where(F.col("path").rlike(r"(?i)\.(md|markdown|mdx)$") & ~F.col("path").rlike(r"/(\.obsidian|\.trash|\.git|node_modules)/")).count()


def coerced(raw: Column) -> Column:
    """struct(kind, text, number) of a front-matter value: true and false are
    booleans, ``[a, b]`` a list (text: its items joined by ``|``), what reads
    as a number one, nothing, ``~`` and null an empty string, and the rest a
    string without its quotes."""
    value = F.trim(raw)
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), "^'(.*)'$", "$1")
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(inner, ","), bare), lambda x: x != "")
    numeric = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    kind = F.when(value.isin("", "~", "null"), "string").when(value.isin("true", "false"), "boolean").when(value.rlike(r"^\[.*\]$"), "list").when(numeric, "number").otherwise("string")
    text = F.when(value.isin("", "~", "null"), "").when(kind == "list", F.array_join(items, "|")).when(kind.isin("boolean", "number"), value).otherwise(bare(value))
    return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind == "number", value.cast("double")).alias("number"))


def imported(spark: SparkSession, glob: str, base: str) -> DataFrame:
    """Each file as a candidate: path below ``base``, category by path, trimmed
    content, and outcome (queued, or failed where nothing is left)."""
    from archivum.functions.heuristics import path_category

    files = spark.read.format("text").option("wholetext", True).load(glob).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("content"))
    path = F.substring_index("path", "/" + base.rstrip("/").rpartition("/")[2] + "/", -1)
    outcome = F.when(F.col("content") == "", "failed").otherwise("queued")
    return files.select(path.alias("path"), path_category(path).alias("category"), "content", F.lit("import").alias("source"), outcome.alias("outcome"))
