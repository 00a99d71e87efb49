"""Intermediate tables and files in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one JVM (tests) a temporary folder is made; on a
    cluster without it, this is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="archivum-")
        where = _own_dirs[context.applicationId]
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is put there goes with the
    application."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    files, place = file_system(spark, path)
    return files.exists(place)


def write_table(spark: SparkSession, table: pa.Table, folder: str) -> None:
    """Writes a small table of the driver as the one Parquet file of a folder.
    It appears whole, and what the folder had before goes."""
    files, place = file_system(spark, folder)
    files.delete(place, True)
    sink = pa.BufferOutputStream()
    pq.write_table(table, sink)
    data, name = sink.getvalue().to_pybytes(), f"part-{uuid.uuid4().hex}.parquet"
    if files.getScheme() == "file":  # Hadoop starts processes for a local file's rights
        there = Path(place.toUri().getPath())
        there.mkdir(parents=True)
        (there / f".{name}").write_bytes(data)
        (there / f".{name}").rename(there / name)
        return
    beside = spark._jvm.org.apache.hadoop.fs.Path(place, f".{name}")
    out = files.create(beside)
    out.write(data)
    out.close()
    if not files.rename(beside, spark._jvm.org.apache.hadoop.fs.Path(place, name)):
        raise OSError(f"{folder}/{name} couldn't be moved into place")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts lineage: what follows reads files that outlive any executor. They
    go with the application, or before by ``discard``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    files, place = file_system(df.sparkSession, df.stored_at)
    files.delete(place, True)
