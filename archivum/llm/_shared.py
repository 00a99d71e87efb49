"""What the training-data operators have in common: storage and batching."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivum.shipping import ship
from archivum.storage import discard, fresh_path, stored  # noqa: F401  operators take them from here

#: Rows of one Arrow batch handed to Python. Texts are unbounded, so batches
#: are kept short in rows.
MAX_ROWS_PER_BATCH = 400
#: Whole texts of a group that ``bounded_sample`` fetches, in bytes, at most.
SAMPLE_BYTES = 16 << 20
#: Range of the hashes by which keys are sampled.
HASHES = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession) -> None:
    """Ship this package to the workers; keep Arrow batches short in rows."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > MAX_ROWS_PER_BATCH:
        spark.conf.set(key, str(MAX_ROWS_PER_BATCH))


def release_memory() -> None:
    """Give a task's freed memory back to the system: workers live on, several
    to an executor, and what each holds counts against it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lower_ascii(text):
    """A-Z to a-z and nothing else; ``lower`` would fold other scripts too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; null keys count as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def plain_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until it isn't taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def with_outputs(df: DataFrame, text: str, keep: list[str], outputs: dict[str, T.DataType], task) -> DataFrame:
    """The columns ``keep``, and ``outputs`` made from ``text`` (null as empty).

    ``task()`` is called in each task and gives a function from a list of texts
    to a list of columns. Kept columns travel as Arrow data under names of
    their own; one that is named like an output is left out.
    """
    for_python(df.sparkSession)
    keep = [c for c in keep if c.lower() not in {o.lower() for o in outputs}]
    inner = [f"k{i}" for i in range(len(keep))] + [f"o{i}" for i in range(len(outputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task()
        for batch in batches:
            columns = made(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=inner)
        del made
        release_memory()

    schema = T.StructType([T.StructField(n, t) for n, t in zip(inner, [*(df.schema[c].dataType for c in keep), *outputs.values()])])
    sent = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner)])
    return sent.mapInArrow(run, schema).toDF(*keep, *outputs)


def bounded_sample(marked: DataFrame, docs: DataFrame, key: str, group: str, text: str, per_group: int, bytes_per_group: int = SAMPLE_BYTES) -> list[tuple]:
    """At most ``per_group`` whole (group, text) of each group, and no more
    bytes than ``bytes_per_group`` beyond the first text, sorted; the same for
    the same rows. ``marked`` has key and group, ``docs`` key and text. Rows
    with a null key, group or text don't take part.

    The keys with the smallest hashes are taken. Nothing is sorted but the keys
    below a hash that the groups' counts set, about twice ``per_group`` of each;
    where repeated keys make them fewer, the bound is raised.
    """
    spark = docs.sparkSession
    rest = marked.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"))
    counts = {r.g: r["count"] for r in rest.groupBy("g").count().collect()}
    if not counts:
        return []
    hashed = rest.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(HASHES)))
    wide = 2
    while True:
        most = {g: min(HASHES, -(-HASHES * wide * (per_group + 32) // n)) for g, n in counts.items()}
        bound = F.create_map(*[x for g, m in most.items() for x in (F.lit(g), F.lit(m))])
        found = hashed.where(F.col("h") < F.element_at(bound, F.col("g"))).distinct().collect()
        got = Counter(r.g for r in found)
        if all(got[g] >= per_group or m == HASHES for g, m in most.items()):
            break
        wide *= 4
    place: Counter = Counter()
    chosen = []
    for h, k, g in sorted((r.h, r.k, r.g) for r in found):
        place[g] += 1
        if place[g] <= per_group:
            chosen.append((k, g, place[g]))
    chosen = spark.createDataFrame(chosen, T.StructType([rest.schema["k"], rest.schema["g"], T.StructField("place", T.LongType())]))
    texts = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    rows = stored(texts.join(F.broadcast(chosen), "k").select("g", "place", "text"), "sample")
    fits = []
    room: Counter = Counter()
    for r in sorted(rows.select("g", "place", F.octet_length("text").alias("n")).groupBy("g", "place").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.place):
        if not room[r.g] or room[r.g] + r.n <= bytes_per_group:
            fits.append((r.g, r.place))
        room[r.g] += max(1, r.n)
    kept = spark.createDataFrame(fits, T.StructType([rest.schema["g"], T.StructField("place", T.LongType())])) if fits else rows.select("g", "place").limit(0)
    out = sorted({(r.g, r.text) for r in rows.join(F.broadcast(kept), ["g", "place"]).select("g", "text").collect()})
    discard(rows)
    return out
