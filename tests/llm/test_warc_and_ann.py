import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from archivum.llm import ann, warc

PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", None), (3, None, ""), (4, "http://c", "<p>x</p>"), (5, "http://d\r\nX: y", "é" * 9000), (5, "http://d", "é" * 9000)]


def archives(spark, min_bytes=0, rows=PAGES):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    marked = warc.mark_revisits(frame, "page_id", "html", min_bytes, keep=["url"])
    return marked, warc.write_archives(marked.repartition(2), "page_id", "url", archive_bytes=400)


def test_base32_digest(spark):
    got = spark.range(1).select(warc.base32_sha1(F.lit(b"abc")).alias("d")).first().d
    assert got == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_round_trip_in_any_split(spark, split):
    marked, manifest = archives(spark)
    got = warc.read_archives(manifest, split).collect()
    assert len(got) == len(PAGES)
    kinds = {(int(r.record_id.rsplit(":", 1)[1]), r.record_type) for r in got}
    assert kinds == {(1, "response"), (4, "revisit"), (2, "response"), (3, "revisit"), (5, "response")}
    for r in got:
        page = int(r.record_id.rsplit(":", 1)[1])
        html = (next(p[2] for p in PAGES if p[0] == page) or "").encode()
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html


def test_small_payloads_are_responses(spark):
    marked, _ = archives(spark, min_bytes=1)
    assert {r.page_id: r.record_type for r in marked.collect() if r.page_id in (2, 3)} == {2: "response", 3: "response"}


def test_members_are_plain_gzip_and_false_magic_is_passed_over(tmp_path):
    record = lambda k, body: warc.record_bytes(k, "u", "response", "D", None, body, len(body))
    noise = warc.MAGIC * 50
    bodies = [noise, b"", b"x" * 5000, noise + b"WARC/1.1"]
    stored = b"".join(warc.gzip_member(record(k, b), 0) for k, b in enumerate(bodies))  # level 0 keeps the noise readable
    path = tmp_path / "a.warc.gz"
    path.write_bytes(stored)
    assert gzip.decompress(stored) == b"".join(record(k, b) for k, b in enumerate(bodies))
    for split in (64, 700, len(stored)):
        found = []
        with fs.LocalFileSystem().open_input_file(str(path)) as source:
            for start in range(0, len(stored), split):
                found += [b for _, _, b in warc.scan_range(source, len(stored), start, min(start + split, len(stored)))]
        assert [b.partition(b"\r\n\r\n")[2] for b in found] == bodies


def test_empty_table_writes_and_reads_nothing(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.mark_revisits(frame, "page_id", "html", keep=["url"]), "page_id", "url")
    assert warc.read_archives(manifest).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[200:260] = x[200]  # one vector many times: ties go to the smaller id
    rows = [(k, v.tolist(), 3) for k, v in enumerate(x)]
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0, None] + [0.0] * 14, 0), (2080, [float("inf")] * 16, 0), (2100, [1.0], 0), (None, x[0].tolist(), 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list int")
    got = ann.search(frame, F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        scores = x.astype(float) @ x[q].astype(float)
        order = sorted((k for k in range(1500) if k != q), key=lambda k: (-scores[k], k))[:20]
        hits += len({r.vec_id for r in rows} & set(order))
        assert [r.rank for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert all(r.score == pytest.approx(scores[r.vec_id]) for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
    assert hits / (20 * len(by)) >= 0.9


def test_search_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(frame, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in got] == [(1, 1), (2, 2)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_large_lists_are_spread(monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 10)
    plan = ann.shards_of({0: 4, 1: 5, 2: 25, 3: 8})
    assert plan == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1)]
