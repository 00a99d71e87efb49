"""Files by name: listing, reading, writing, moving, checking."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.functions import paths
from archivum.shipping import ship
from archivum.storage import stored


def listing(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """name, path, bytes and modified of the files that match; contents are
    not read. A missing folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    return files.select(F.col("_metadata.file_name").alias("name"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """name, path and content (binary) of the files that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    return files.select(F.col("_metadata.file_name").alias("name"), "path", "content")


def lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file, pos (from 0) and value of every line, in the order of each file.
    A file is read whole by one task, as its lines have an order."""
    text = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    rows = text.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    return rows.where(F.trim("value") != "")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` of each row to ``name`` below ``folder``; name,
    bytes, sha256 and outcome (written, or unsafe for a name that climbs or is
    absolute, which is not written), as a stored table.

    A file appears whole under its name: it is written beside it and moved, so
    that a repeated task leaves the same files. A name should occur once."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes, digests = [], []
            for name, body, safe in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = body.as_py() if safe else None
                sizes.append(None if data is None else len(data))
                digests.append(None if data is None else hashlib.sha256(data).hexdigest())
                if data is None:
                    continue
                path = f"{base}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                beside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside, compression=None) as out:
                    out.write(data)
                store.move(beside, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["name", "bytes", "sha256"])

    ready = files.select("name", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"), paths.is_safe(F.col("name")).alias("safe"))
    made = stored(ready.mapInArrow(run, "name string, bytes long, sha256 string"), "files")
    return made.withColumn("outcome", F.when(F.col("bytes").isNull(), "unsafe").otherwise("written"))


def move_files(names: DataFrame, folder: str, into: str) -> DataFrame:
    """Moves the files ``name`` of a folder below another; name and outcome
    (moved, missing or unsafe), as a stored table. A task that is repeated
    finds its file moved already."""
    ship(names.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        _, target = fs.FileSystem.from_uri(into)
        there = lambda p: store.get_file_info(p).type != fs.FileType.NotFound
        for batch in batches:
            found = []
            for name, safe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not safe:
                    found.append("unsafe")
                elif there(f"{base}/{name}"):
                    store.create_dir(f"{target}/{name}".rpartition("/")[0], recursive=True)
                    store.move(f"{base}/{name}", f"{target}/{name}")
                    found.append("moved")
                else:
                    found.append("moved" if there(f"{target}/{name}") else "missing")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["name", "outcome"])

    return stored(names.select("name", paths.is_safe(F.col("name")).alias("safe")).mapInArrow(run, "name string, outcome string"), "moved")


def pinned(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name and state of every entry (name, bytes, sha256) of a manifest:
    missing, size-mismatch, hash-mismatch or ok, the first that applies.
    ``files`` has name and content."""
    found = files.select("name", F.length("content").cast("long").alias("__n"), F.sha2("content", 256).alias("__h"))
    joined = manifest.join(found, "name", "left")
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") != F.col("bytes"), "size-mismatch").when(F.col("__h") != F.col("sha256"), "hash-mismatch").otherwise("ok")
    return joined.select("name", state.alias("state"))


def newest(spark: SparkSession, folder: str, pattern: str, keep: int) -> DataFrame:
    """name and kept: the ``keep`` last names in their order stay."""
    names = listing(spark, folder, pattern).select("name")
    last = names.orderBy(F.desc("name")).limit(keep).withColumn("kept", F.lit(True))
    return names.join(F.broadcast(last), "name", "left").select("name", F.coalesce("kept", F.lit(False)).alias("kept"))
