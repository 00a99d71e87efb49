"""Rows out of JSON text: strict, resilient, and the small line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.storage import exists

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Roles; an unknown one is the last.
ROLES = ["admin", "member"]


def strict(df: DataFrame, json: str, schema: str, key: str) -> DataFrame:
    """``json`` as a struct of the same name; the first row that can't be
    decoded ends the job, named by its key."""
    made = F.from_json(json, schema)
    broken = F.col(json).isNotNull() & F.try_parse_json(json).isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("row "), F.col(key).cast("string"), F.lit(f": {json} is not JSON")))).otherwise(made)
    return df.withColumn(json, checked)


def resilient(df: DataFrame, json: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``json`` decoded, and (id, reason) of those that can't be; a
    null key is ``<unknown>``."""
    bad = F.col(json).isNull() | F.try_parse_json(json).isNull()
    reason = F.when(F.col(json).isNull(), "missing").otherwise("not JSON")
    good = df.where(~bad).withColumn(json, F.from_json(json, schema))
    return good, df.where(bad).select(F.coalesce(F.col(key).cast("string"), F.lit("<unknown>")).alias("id"), reason.alias("reason"))


def query_access(values: DataFrame) -> DataFrame:
    """actor, time and citations of the access lines (value): a string actor
    and a number for the time are needed, citations that aren't strings go."""
    v = F.try_parse_json("value")
    rows = values.select(v.alias("v")).where("v is not null")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    kept = rows.where((F.try_variant_get("v", "$.event", "string") == "query-access") & (kind("$.actor") == "STRING") & kind("$.time").isin("BIGINT", "DOUBLE", "DECIMAL(1,0)"))
    cited = F.filter(F.coalesce(F.try_variant_get("v", "$.citations", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.schema_of_variant(c) == "STRING")
    return kept.select(F.try_variant_get("v", "$.actor", "string").alias("actor"), F.try_variant_get("v", "$.time", "long").alias("time"), F.transform(cited, lambda c: c.cast("string")).alias("citations"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines; none where it isn't there, and a line that
    can't be read ends the job."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def until_broken(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` lines (file, pos, value) of the files in falling
    order of their names; a line that isn't JSON ends its file."""
    bad = rows.where(F.try_parse_json("value").isNull()).groupBy("file").agg(F.min("pos").alias("__end"))
    good = rows.join(F.broadcast(bad), "file", "left").where(F.col("__end").isNull() | (F.col("pos") < F.col("__end"))).drop("__end")
    return good.orderBy(F.desc("file"), "pos").limit(limit)


def ids_of_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids (file, id) of files of ids, lower case, comments skipped; and
    the files that fail because a line is no id, of which no id counts."""
    plain = rows.withColumn("id", F.lower(F.trim("value"))).where(~F.col("id").startswith("#"))
    broken = plain.where(~F.col("id").rlike(UUID)).select("file").distinct()
    return plain.join(F.broadcast(broken), "file", "left_anti").select("file", "id"), broken


def tokens(rows: DataFrame, now: Column) -> DataFrame:
    """token, actor, role and state (valid, expired or revoked) of token
    records; those without token or actor are left out, an unknown role is
    ``member``."""
    role = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise(ROLES[-1])
    state = F.when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.col("expires") <= now, "expired").otherwise("valid")
    return rows.where("token is not null and actor is not null").select("token", "actor", role.alias("role"), state.alias("state"))


def hits(df: DataFrame, output: str) -> DataFrame:
    """Search output, a JSON list, as rows (the other columns, file, score).
    What isn't a list gives none; a hit without a file is left out, and a
    score that is no number is 0."""
    rest = [c for c in df.columns if c != output]
    items = F.from_json(F.col(output), "array<struct<file:string,score:string>>")
    rows = df.where(F.trim(output).startswith("[")).select(*rest, F.explode(items).alias("h"))
    score = F.coalesce(F.nanvl(F.expr("try_cast(h.score as double)"), F.lit(0.0)), F.lit(0.0))
    return rows.where("h.file is not null").select(*rest, F.col("h.file").alias("file"), score.alias("score"))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Nulls of a column as its default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def verified_manifest(df: DataFrame, manifest: str) -> DataFrame:
    """Adds ``valid``: a manifest (JSON) whose count is that of its entries and
    whose hash is that of the rest of it, in its order of keys."""
    schema = "schemaVersion int, generatedAt string, entryCount int, entries array<struct<id:string,reason:string>>, manifestHash string"
    df = df.withColumn("__m", F.from_json(manifest, schema))
    body = F.to_json(F.struct(*[F.col(f"__m.{c}") for c in ("schemaVersion", "generatedAt", "entryCount", "entries")]))
    ok = (F.size("__m.entries") == F.col("__m.entryCount")) & (F.sha2(body.cast("binary"), 256) == F.col("__m.manifestHash"))
    return df.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("__m")


def manifest_of(entries: DataFrame, key: str, generated_at: str) -> DataFrame:
    """key and the manifest (JSON) of its entries (seq, id, reason), by seq and
    id. A manifest is one document, so the entries of a key must be few."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "reason"))), lambda e: F.struct(e["id"].alias("id"), e["reason"].alias("reason")))
    made = entries.groupBy(key).agg(listed.alias("entries")).withColumns({"schemaVersion": F.lit(1), "generatedAt": F.lit(generated_at), "entryCount": F.size("entries")})
    names = ["schemaVersion", "generatedAt", "entryCount", "entries"]
    hashed = made.withColumn("manifestHash", F.sha2(F.to_json(F.struct(*names)).cast("binary"), 256))
    return hashed.select(key, F.to_json(F.struct(*names, "manifestHash")).alias("manifest"))


def pending(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """The migrations (version, name) beyond the last one applied, in order."""
    last = applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("__last"))
    return migrations.join(F.broadcast(last), F.col("version") > F.col("__last")).drop("__last").orderBy("version")


def first_trace(paths: DataFrame, events: DataFrame) -> DataFrame:
    """``paths`` (path) with the first event (file, id, output) that wrote each."""
    first = events.groupBy(F.col("output").alias("path")).agg(F.min_by("id", F.struct("file", "id")).alias("event"))
    return paths.join(first, "path", "left")


def nearest_package(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """path and the nearest folder above it that ``manifests`` (folder, name)
    has, with the name found there; null for none."""
    from archivum.functions.paths import ancestors

    above = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("far", "folder"))
    nearest = above.join(manifests, "folder").groupBy("path").agg(F.min_by(F.struct("folder", "name"), "far").alias("p"))
    return paths.select("path").distinct().join(nearest, "path", "left").select("path", "p.folder", "p.name")
