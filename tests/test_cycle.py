"""The stream of candidates over many batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from archivum import storage
from archivum.sources import jsonl
from archivum.streaming import cycle


def fill(spool, numbers):
    for k in numbers:
        ids = [k, max(0, k - 1), k // 2, 1000 + k % 3]
        (spool / f"spool-{k:03}.jsonl").write_text("".join(f'{{"id":"{i}","content":"c{i}"}}\n' for i in ids))


def test_batches_do_not_read_all_batches_before_one_by_one(spark, tmp_path, monkeypatch):
    """Each id once over many batches and a restart, while what a batch lists
    grows as the logarithm of the batches."""
    spool, store, state = tmp_path / "spool", str(tmp_path / "store"), str(tmp_path / "state")
    spool.mkdir()
    listed, read = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: listed.append(paths) or read(self, *paths, **options))
    fill(spool, range(20))
    cycle.start(spark, str(spool), store, state, files_per_batch=1).awaitTermination()
    assert sum(store in paths for paths in listed) == 0 and max(map(len, listed)) <= 2 * cycle.MERGED
    fill(spool, range(20, 30))
    cycle.start(spark, str(spool), store, state, files_per_batch=1).awaitTermination()
    assert sum(store in paths for paths in listed) == 1 and max(map(len, listed)) <= 2 * cycle.MERGED
    rows = read(spark.read, store).collect()
    assert sorted(int(r.id) for r in rows) == [*range(30), 1000, 1001, 1002]
    assert all(r.content == f"c{r.id}" for r in rows) and len({r.batch for r in read(spark.read, store).select("batch").collect()}) <= 30


def test_a_batch_that_comes_again_counts_its_own_rows_as_new(spark, tmp_path):
    store = str(tmp_path / "store")
    known = cycle.Known(spark, store)
    assert known.before(0) is None
    for number in range(cycle.MERGED + 1):
        spark.createDataFrame([(str(number), "x")], "id string, content string").write.parquet(f"{store}/batch={number}")
        known.add(number)
    last = cycle.MERGED
    assert len(known.runs) == 2
    for other in (known, cycle.Known(spark, store)):
        assert sorted(r.id for r in other.before(last).collect()) == sorted(str(n) for n in range(last))


def repeats(spool, numbers):
    """Lines of which most ids come again, in batches far apart, with other contents."""
    for k in numbers:
        rows = [(k, "b"), (k, "a"), (k * 7 % 30, "c"), (k // 3, "d")]
        (spool / f"spool-{k:03}.jsonl").write_text("".join(f'{{"id":"{i}","content":"{c}{i}"}}\n' for i, c in rows))


def test_small_batches_read_no_ids_of_earlier_ones(spark, tmp_path, monkeypatch):
    spool, store, state = tmp_path / "spool", str(tmp_path / "store"), str(tmp_path / "state")
    spool.mkdir()
    read_, read = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: read_.append(paths) or read(self, *paths, **options))
    repeats(spool, range(20))
    cycle.start(spark, str(spool), store, state, files_per_batch=1).awaitTermination()
    assert len(read_) <= 20 // cycle.MERGED and spark.conf.get(cycle.LOGS, None) is None
    rows = read(spark.read, store).collect()
    assert len({r.batch for r in rows}) <= 20 and len(rows) == len({r.id for r in rows})
    assert {r.id for r in rows} == {str(i) for k in range(20) for i in (k, k * 7 % 30, k // 3)}


@pytest.mark.parametrize(("small", "held"), [(0, 1 << 20), (1 << 20, 0), (1 << 20, 60), (350, 1 << 20), (1 << 20, 1 << 20)])
def test_each_id_once_whether_the_driver_or_a_job_takes_a_batch(spark, tmp_path, monkeypatch, small, held):
    """With a restart; in one batch the least content of an id stays."""
    spool, store, state = tmp_path / "spool", str(tmp_path / "store"), str(tmp_path / "state")
    spool.mkdir()
    monkeypatch.setattr(cycle, "SMALL", small)
    monkeypatch.setattr(cycle, "HELD", held)
    for numbers in (range(9), range(9, 14)):
        repeats(spool, numbers)
        (spool / f"spool-{numbers[0]:03}.jsonl").write_text("".join(f'{{"id":"{numbers[0]}","content":"{c}{numbers[0]}{"-" * 300}"}}\n' for c in "ba"))
        cycle.start(spark, str(spool), store, state, files_per_batch=1).awaitTermination()
    rows = spark.read.parquet(store).collect()
    ids = {str(i) for k in range(14) if k not in (0, 9) for i in (k, k * 7 % 30, k // 3)} | {"0", "9"}
    assert sorted(r.id for r in rows) == sorted(ids)
    assert not [r for r in rows if r.content.startswith("b")]
    assert len([f for f in (tmp_path / "store").iterdir() if f.name.startswith("batch=")]) == 14


def test_held_ids_with_equal_hashes_are_told_apart():
    held = cycle.Held()
    for k in range(20):
        held.add(np.array([k % 3, k % 3]), pa.array([f"a{k}", f"b{k}"]))
    assert len(held.runs) < cycle.MERGED + 3
    asked = {f"{c}{k}": k % 3 for c in "abc" for k in range(22)}
    assert held.those_of(asked) == {f"{c}{k}" for c in "ab" for k in range(20)} and held.those_of({}) == set()


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_a_small_table_replaces_what_a_folder_had(spark, tmp_path, scheme):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tables.link./in", f"file://{tmp_path}")
    folder = f"file://{tmp_path}/t" if scheme == "file" else "viewfs://tables/in/t"
    for ids in (["x", "y"], [], ["z"]):
        storage.write_table(spark, pa.table({"id": pa.array(ids, pa.string())}), folder)
        assert [r.id for r in spark.read.parquet(folder).orderBy("id").collect()] == ids
        assert len([f for f in (tmp_path / "t").iterdir() if f.suffix == ".parquet"]) == 1


def test_small_plain_batches_take_no_job(spark, tmp_path, monkeypatch):
    """Odd lines are left to Spark; the lines of all batches are counted."""
    spool, store, state = tmp_path / "spool ä", str(tmp_path / "store"), str(tmp_path / "state")
    spool.mkdir()
    jobs, to_arrow = [], type(spark.range(0)).toArrow
    monkeypatch.setattr(type(spark.range(0)), "toArrow", lambda self: jobs.append(self) or to_arrow(self))
    fill(spool, range(20))
    query = cycle.start(spark, str(spool), store, state, files_per_batch=1)
    query.awaitTermination()
    assert jobs == [] and cycle.progress(query) == [(k, 4) for k in range(20)]
    (spool / "spool-900.jsonl").write_text('{"id":900,"content":"x"}\n{ broken\n')
    query = cycle.start(spark, str(spool), store, state, files_per_batch=1)
    query.awaitTermination()
    assert jobs and [n for _, n in cycle.progress(query)] == [2]
    assert sorted(int(r.id) for r in spark.read.parquet(store).collect()) == [*range(20), 900, 1000, 1001, 1002]


ODD_LINES = ["", " ", "{}", "null", "[]", '[["id","a"],["content","b"]]', '{"id":"a"}', '{"id":"a","content":null}', '{"id":"a","content":""}', '{"id":"a","content":"b"} x', "{'id':'a','content':'b'}", '{"id":1,"content":"b"}', '{"id":"a","content":{"b": 1}}', '{"id":"a","id":"c","content":"b"}', '{"ID":"a","content":"b"}', '{"id":"a","content":"\\ud83d\\ude00\\u0000é"}', '{"id":"a","content":"\\ud83d"}', '{"id":"a","content":"b\rc"}', '{"id":"a","content":"b\tc"}', '{"id":"a","content":"b","k":NaN}', '{"id":"a","content":"b","k":"\\x"}', '﻿{"id":"a","content":"b"}', ' {"id" : "a", "content":" "} \t', '{"id":"a","content":"b"']


def test_what_the_driver_reads_of_a_line_is_what_spark_reads(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    lines = [x.encode() for x in ODD_LINES] + [b'{"id":"a","content":"\xff"}']
    for k, line in enumerate(lines):
        (folder / f"spool-{k:03}.jsonl").write_bytes(line + b"\n")
    seen = {k: [] for k in range(len(lines))}
    for r in spark.read.text(str(folder)).select(F.substring("_metadata.file_name", 7, 3).cast("int").alias("k"), F.from_json("value", jsonl.CANDIDATE).alias("c")).collect():
        seen[r.k] += [(r.c.id, r.c.content)] if r.c and r.c.id is not None and r.c.content is not None else []
    made = {k: jsonl.plain(line + b"\n") for k, line in enumerate(lines)}
    assert {k: (seen[k], 1) for k in seen if made[k]} == {k: v for k, v in made.items() if v}
    assert [ODD_LINES[k] for k, v in made.items() if v] == [ODD_LINES[k] for k in (2, 6, 7, 8, 14, 15, 22)]
    assert jsonl.plain(b"") == ([], 0) and jsonl.plain(b'{"id":"a","content":"b"}\n{"id":"c"}') == ([("a", "b")], 2)
