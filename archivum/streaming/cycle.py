"""The cycle as a stream: files in, each candidate once, in batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivum.sources.jsonl import CANDIDATE, plain
from archivum.storage import exists, file_system, fresh_path, write_table

STORE = "id string, content string, batch long"
#: Runs of ids of like age that are merged to one, and bytes of a file of one.
MERGED, RUN_BYTES = 8, 64 << 20
#: Bytes up to which the driver takes a batch by itself; a larger one is a job.
SMALL = 4 << 20
#: Bytes of ids that the driver holds at most, and batches that are saved as one.
HELD, SAVED = 128 << 20, 2
#: Ids that are hashed at a time.
HASHED = 100_000
#: Errors that may pass if one waits, by what their text has.
TRANSIENT = ("timeout", "timed out", "connection reset", "temporarily unavailable", "too many requests")
#: How Spark writes a stream's logs, and the way that starts no processes to
#: move a local file.
LOGS, PLAIN_LOGS = "spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def hashes_of(ids: list[str]) -> np.ndarray:
    """The same for the same id in this process alone, which holds them."""
    return np.fromiter(map(hash, ids), np.int64, len(ids))


class Held:
    """Ids in the driver's memory by their hash, in sorted runs of which
    MERGED of one age are merged. Equal hashes are told apart."""

    def __init__(self):
        self.runs: list[tuple[int, np.ndarray, pa.Array]] = []  # age, hashes and ids, oldest first
        self.bytes = 0

    def add(self, hashes: np.ndarray, ids: pa.Array) -> None:
        self._run(0, hashes, ids)
        while len(self.runs) >= MERGED and self.runs[-MERGED][0] == self.runs[-1][0]:
            young, self.runs = self.runs[-MERGED:], self.runs[:-MERGED]
            self._run(young[0][0] + 1, np.concatenate([h for _, h, _ in young]), pa.concat_arrays([i for _, _, i in young]))
        self.bytes = sum(h.nbytes + i.nbytes for _, h, i in self.runs)

    def _run(self, age: int, hashes: np.ndarray, ids: pa.Array) -> None:
        order = np.argsort(hashes, kind="stable")
        self.runs.append((age, hashes[order], ids.take(pa.array(order))))

    def those_of(self, hashes: dict[str, int]) -> set[str]:
        """Those of some ids (with their hashes) that are held."""
        asked, wanted, found = [*hashes], np.fromiter(hashes.values(), np.int64, len(hashes)), set()
        for _, held, ids in self.runs:
            low, high = np.searchsorted(held, wanted), np.searchsorted(held, wanted, "right")
            found |= {asked[k] for k in np.flatnonzero(low < high) if asked[k] in ids[low[k] : high[k]].to_pylist()}
        return found


class Known:
    """The ids of a store's batches, for the one query that adds to it.

    Its runs are batches as they are stored, and files of ids alone that
    MERGED runs of one age were merged to. So a batch reads the ids of all
    before it, but only as many files as the logarithm of their number.
    A small batch reads none of them while all ids fit the driver (HELD)."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.last = spark, store, None
        self.runs: list[tuple[int, str]] = []  # age and path, oldest first
        self.folder, self.made = None, 0
        self.held: Held | None = None  # None: to be read from the runs
        self.over = False  # the ids are more than the driver holds
        self.unsaved: list[set[str]] = []  # new ids of batches that are in no run

    def before(self, number: int) -> DataFrame | None:
        """Ids of all batches but ``number``; None if there are none."""
        self._begin(number)
        self._save()
        if not self.runs:
            return None
        return self._read([path for _, path in self.runs])

    def new(self, number: int, hashes: dict[str, int]) -> set[str] | None:
        """Those of the ids (with their hashes) that no batch but ``number``
        has; None if the ids are too many for the driver."""
        self._begin(number)
        if self.held is None and not self.over:
            before, self.held = self.before(number), Held()
            if before is not None:
                if (before.agg(F.sum(F.octet_length("id") + 12)).first()[0] or 0) > HELD:
                    self.over = True
                else:
                    ids = before.toArrow()["id"].combine_chunks()
                    parts = (ids.slice(at, HASHED).to_pylist() for at in range(0, len(ids), HASHED))
                    self.held.add(np.concatenate([hashes_of([]), *map(hashes_of, parts)]), ids)
        return None if self.over else hashes.keys() - self.held.those_of(hashes)

    def add(self, number: int, new: dict[str, int] | None = None) -> None:
        """Batch ``number`` is stored. ``new``: its new ids (with their hashes),
        if the driver has them."""
        self.last = number
        if new is None:
            self.held = None
            self._save()
            self._run(f"{self.store}/batch={number}")
            return
        self.unsaved.append({*new})
        self.held.add(np.fromiter(new.values(), np.int64, len(new)), pa.array(new.keys(), pa.string()))
        if self.held.bytes > HELD:
            self.held, self.over = None, True
        if len(self.unsaved) == SAVED:
            self._save()

    def _begin(self, number: int) -> None:
        """The first time, or when a batch comes again, the store itself tells
        what it has."""
        if self.last is not None and number > self.last:
            return
        for _, path in self.runs:
            self._drop(path)
        self.runs, self.unsaved, self.held, self.over = [], [], None, False
        if exists(self.spark, self.store):
            batches = self.spark.read.schema(STORE).parquet(self.store)
            self._keep(batches.where(F.col("batch") != number).select("id"), MERGED, [self.store])
        self.last = number - 1

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("id string").parquet(*paths)

    def _save(self) -> None:
        """The ids of what is unsaved become a run."""
        if self.unsaved:
            path = self._path()
            write_table(self.spark, pa.table({"id": pa.array(sorted(set().union(*self.unsaved)), pa.string())}), path)
            self.unsaved = []
            self._run(path)

    def _run(self, path: str) -> None:
        self.runs.append((0, path))
        while len(self.runs) >= MERGED and self.runs[-MERGED][0] == self.runs[-1][0]:
            young, self.runs = self.runs[-MERGED:], self.runs[:-MERGED]
            paths = [path for _, path in young]
            self._keep(self._read(paths), young[0][0] + 1, paths)
            for path in paths:
                self._drop(path)

    def _keep(self, ids: DataFrame, age: int, paths: list[str]) -> None:
        sizes = []
        for path in paths:
            files, place = file_system(self.spark, path)
            sizes.append(files.getContentSummary(place).getLength())
        kept = self._path()
        ids.coalesce(1 + sum(sizes) // RUN_BYTES).write.parquet(kept)
        self.runs.append((age, kept))

    def _path(self) -> str:
        self.folder = self.folder or fresh_path(self.spark, "known")
        self.made += 1
        return f"{self.folder}/{self.made}"

    def _drop(self, path: str) -> None:
        if self.folder and path.startswith(f"{self.folder}/"):
            files, place = file_system(self.spark, path)
            files.delete(place, True)


def plain_rows(batch: DataFrame) -> tuple[list[tuple[str, str]], int] | None:
    """(id, content) of a batch, and how many lines it has, read by the driver
    without a job. None if the batch is over SMALL, if it isn't of whole local
    files, or if Spark might read a line otherwise (``plain``)."""
    try:
        files = [f for part in batch._jdf.queryExecution().logical().rdd().partitions() for f in part.files()]
        found = [(f.toPath().toString(), f.start(), f.length()) for f in files]
    except Py4JError:  # not a scan of files
        return None
    if sum(n for _, _, n in found) > SMALL or not all(path.startswith("file:/") and start == 0 for path, start, _ in found):
        return None
    rows, lines = [], 0
    for path, _, length in found:
        data = Path(path.removeprefix("file:")).read_bytes()
        made = plain(data) if len(data) == length else None
        if made is None:
            return None
        rows += made[0]
        lines += made[1]
    return rows, lines


def start(spark: SparkSession, folder: str, store: str, state: str, files_per_batch: int | None = None, every: str | None = None) -> StreamingQuery:
    """Reads the spool as it grows and appends candidates that the store
    hasn't, each id once. A batch takes at most ``files_per_batch`` files.
    Without ``every`` the query ends when all that is there is taken; with it,
    a batch starts so often, and never before the last one ended. Spark counts
    no rows of batches that the driver reads by itself; ``progress`` does."""
    if file_system(spark, state)[0].getScheme() == "file" and not spark.conf.get(LOGS, None):
        spark = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())  # the setting is this stream's alone
        spark.conf.set(LOGS, PLAIN_LOGS)
    reader = spark.readStream.option("pathGlobFilter", "spool-*.jsonl")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.text(folder).select(F.from_json("value", CANDIDATE).alias("c")).select("c.id", "c.content").where("id is not null and content is not null")

    known = Known(spark, store)
    counted: dict[int, int] = {}  # lines of the last batches that the driver has read
    recent = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))

    def small(batch: DataFrame, number: int) -> list[tuple[str, str]] | None:
        """(id, content) of a batch that the driver can take."""
        if known.over:
            return None
        counted.pop(number - recent, None)
        counted.pop(number, None)
        read = plain_rows(batch)
        if read is not None:
            rows, counted[number] = read
            return rows
        if batch._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL:
            return None
        found = batch.select("id", "content").coalesce(1).toArrow()
        return [*zip(found["id"].to_pylist(), found["content"].to_pylist())]

    def take(batch: DataFrame, number: int) -> None:
        # Rows of this batch that an attempt before has written count as new,
        # and its part of the store is written anew: each id once, whatever fails.
        rows = small(batch, number)
        if rows is not None:
            ids = [*{i for i, _ in rows}]
            hashes = dict(zip(ids, hashes_of(ids).tolist()))
            new = known.new(number, hashes)
            if new is not None:
                least: dict[str, str] = {}
                for i, content in rows:
                    if i in new:
                        least[i] = min(content, least.get(i, content))
                write_table(spark, pa.table({"id": pa.array(least.keys(), pa.string()), "content": pa.array(least.values(), pa.string())}), f"{store}/batch={number}")
                known.add(number, {i: hashes[i] for i in least})
                return
            counted.pop(number, None)
        fresh = batch.groupBy("id").agg(F.min("content").alias("content"))
        before = known.before(number)
        if before is not None:
            fresh = fresh.join(before, "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")
        known.add(number)

    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", state)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    query.counted = counted
    return query


def drained(query: StreamingQuery) -> None:
    """Ends a polling query once what is there is taken."""
    query.processAllAvailable()
    query.stop()


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows) of the batches that a query reports of."""
    counted = getattr(query, "counted", {})
    rows = [(p.batchId, p.numInputRows or counted.get(p.batchId, 0)) for p in query.recentProgress]
    return [(number, n) for number, n in rows if n]


def is_transient(error: BaseException) -> bool:
    return isinstance(error, (TimeoutError, ConnectionError)) or any(x in str(error).lower() for x in TRANSIENT)


def with_retry(call: Callable, attempts: int = 3, base: float = 0.1, jitter: float = 0.1, sleep: Callable = time.sleep):
    """What ``call`` gives; errors that may pass are tried again after ``base``
    seconds, doubled each time, and some jitter."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts or not is_transient(error):
                raise
            sleep(base * 2**k + random.random() * jitter)


class Cache:
    """Values for some seconds; the clock is the caller's."""

    def __init__(self, seconds: float, now: Callable = time.monotonic):
        self.seconds, self.now, self.held = seconds, now, {}

    def get(self, key, make: Callable):
        if key not in self.held or self.now() - self.held[key][0] > self.seconds:
            self.held[key] = (self.now(), make())
        return self.held[key][1]
