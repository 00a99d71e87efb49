"""WARC archives: a task-parallel writer and a splittable reader.

Writer: each task writes gzip members, one for each record, to files of its
own in a shared folder; the manifest (a stored table) names the files of the
attempts that succeeded, so what a lost or repeated attempt leaves is never
read. Reader: tasks get byte ranges of files, look for the gzip magic, accept
a candidate if its first bytes decode to a WARC header, and own the records
that start inside their range, reading on beyond its end for the last one.

A member that itself stores an uncompressed copy of a WARC member can't be
told from a true one by a range that starts within it; such payloads need
``split_bytes`` of at least the file's size.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import for_python, fresh_path, stored

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Digests that occur again (about 50 bytes each) are broadcast up to so many;
#: beyond, they are joined under so many salts.
BROADCAST_DIGESTS, SALTS = 400_000, 32
#: A task begins a new file beyond this.
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
#: Tasks that read archives, at most; each then takes several ranges.
READ_TASKS = 20_000
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:archivum:page:"

MANIFEST = "path string, bytes long, records long"
RECORD = "path string, start long, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, from built-ins:
    40 bits at a time, as ten hexadecimal and eight base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(df: DataFrame, key: str, payload: str, min_bytes: int = 0, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """key, keep, payload (binary, null as empty), payload_bytes,
    payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest key is the response and the others revisit it. Repeats of
    that smallest key are responses too, as is a row with a null key.

    Digests that occur again are found without the payloads. If they are few,
    they are broadcast and no payload is moved; else they are joined under a
    salt, so that a payload which a third of the rows share isn't one task's.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).alias(key), *[c for c in keep if c != key], body.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    narrow = rows.where(F.col("payload_bytes") >= min_bytes).select(F.col("payload_digest").alias("__digest"), F.col(key).alias("__key"))
    again = stored(narrow.groupBy("__digest").agg(F.min("__key").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "repeated-digests")
    if again.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(again), rows["payload_digest"] == again["__digest"], "left").drop("__digest")
    else:
        salted = again.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (rows["payload_digest"] == salted["__digest"]) & (rows["__own"] == salted["__salt"]), "left").drop("__digest", "__salt", "__own")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("__first").isNotNull() & (F.col(key) != F.col("__first"))
    revisit = F.coalesce(revisit, F.lit(False))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("__first"))).drop("__first")


def _header(value: str | None) -> str:
    return "".join(c for c in (value or "") if c not in "\r\n")


def record_bytes(key, uri: str | None, kind: str, digest: str, refers_to, payload: bytes, payload_bytes: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{'' if key is None else key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, key: str, uri: str, where: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``mark_revisits`` returns; the manifest, as a stored table.

    ``where`` is a folder that all executors share (by default a new one
    below the session's). Empty partitions write no file.
    """
    spark = records.sparkSession
    for_python(spark)
    where = where or fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(where)
        out = path = None
        size = count = 0
        made = []
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                k, url, kind, digest, refers, length, payload = (c[i].as_py() for c in columns)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(path, compression=None), 0, 0
                data = gzip_member(record_bytes(k, url, kind, digest, refers, payload if kind == "response" else b"", length))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path, size, count))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, count))
        base = where[: -len(folder)] if where.endswith(folder) else ""
        yield pa.RecordBatch.from_arrays([pa.array([base + m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "bytes", "records"])

    ready = records.select(F.col(key), F.col(uri), "record_type", "payload_digest", "refers_to", "payload_bytes", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"))
    return stored(ready.mapInArrow(run, MANIFEST), "warc-manifest")


class _Bytes:
    """A file read at any place, a chunk at a time."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def read(self, at: int, n: int = CHUNK) -> bytes:
        if not (self.at <= at and at + 64 <= self.at + len(self.data)) or self.at + len(self.data) < min(at + n, self.size):
            self.source.seek(at)
            self.at, self.data = at, self.source.read(max(n, CHUNK))
        return self.data[at - self.at :][:n]


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the WARC header that ``data`` begins with, and its length."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _starts_record(file: _Bytes, at: int) -> bool:
    """Whether a member with a WARC header begins here. What doesn't begin
    like one is given up at once; a header is read to its end, however long."""
    opened, seen, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while pos < file.size and not opened.eof:
            piece = file.read(pos, 4096)
            before = max(0, len(seen) - 3)
            seen += opened.decompress(piece)
            pos += len(piece)
            if len(seen) >= 7 and not seen.startswith(b"WARC/1."):
                return False
            if seen.find(b"\r\n\r\n", before) >= 0:
                return parse_header(bytes(seen)) is not None
    except zlib.error:
        return False
    return False


def _member(file: _Bytes, at: int) -> tuple[bytes, int]:
    """The member that begins here, decoded, and where it ends."""
    opened, parts, pos = zlib.decompressobj(31), [], at
    while not opened.eof:
        piece = file.read(pos, 1 << 16)
        if not piece:
            raise ValueError(f"gzip member at {at} ends with the file")
        parts.append(opened.decompress(piece))
        pos += len(piece)
    return b"".join(parts), pos - len(opened.unused_data)


def scan_range(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of every record that starts in [start, end)."""
    file, at = _Bytes(source, size), start
    while at < end:
        window = file.read(at, min(CHUNK, end - at + len(MAGIC) - 1))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        if not _starts_record(file, at):
            at += 1
            continue
        data, after = _member(file, at)
        fields, begin = parse_header(data)
        yield at, fields, data[begin : begin + int(fields["content-length"])]
        at = after


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the files in ``manifest`` (path, bytes), as RECORD.

    ``payload`` is the HTTP body of a response and null for a revisit;
    ``payload_bytes`` is the Content-Length that the HTTP header gives.
    """
    for_python(manifest.sparkSession)
    splits = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # The ranges are few rows but much work: a task for each, up to READ_TASKS.
    count = manifest.where("bytes > 0").agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    splits = splits.repartition(max(1, min(READ_TASKS, int(count or 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for split in batch.to_pylist():
                path, start = split["path"], split["start"]
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    rows, held = [], 0
                    for at, head, block in scan_range(source, split["bytes"], start, min(start + split_bytes, split["bytes"])):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
                        kind = head["warc-type"]
                        rows.append((path, at, head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:"), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, length, body if kind == "response" else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return splits.mapInArrow(run, RECORD)
