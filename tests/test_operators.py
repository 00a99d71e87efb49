import hashlib
import hmac
import json
import math
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archivum.functions import hashing as H
from archivum.functions import text as T
from archivum.operators import audit, policy, reports, search, similarity
from archivum.plans.domain import NAMESPACE
from archivum.sources import jsonl, markdown
from archivum.streaming import intake

TEXTS = ["", "a", "hello world", "é🙂 漢字", "tab\tand\nline", None]


def test_hashes_and_ids(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, t string")
    for r in frame.select("t", H.content_hash(F.col("t")).alias("h"), H.uuid5(F.col("t"), NAMESPACE).alias("u"), H.hmac_sha256(b"k" * 80, F.col("t")).alias("m"), T.utf16_length(F.col("t")).alias("n")).collect():
        if r.t is None:
            assert r.h is None and r.m is None
            continue
        assert r.h == hashlib.sha256(r.t.encode()).hexdigest()
        assert r.u == str(uuid.uuid5(uuid.UUID(NAMESPACE), r.t))
        assert r.m == hmac.new(b"k" * 80, r.t.encode(), "sha256").hexdigest()
        assert r.n == len(r.t.encode("utf-16-le")) // 2


def test_entropy(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    for r in frame.select("t", T.entropy(F.col("t")).alias("e")).collect():
        n = len(r.t.encode("utf-16-le")) // 2
        assert r.e == pytest.approx(-sum(c / n * math.log2(c / n) for c in Counter(r.t).values()))


def test_small_text_functions(spark):
    row = spark.createDataFrame([("see [[one]] and [[two|text]] not `[[three]]`", "kb://x/some-file_name.v2.md", "ssh://git@Host.com:team/Repo.git", "token = abcdefgh12 at a@b.org")], "w string, c string, u string, s string")
    got = row.select(T.wiki_links(F.col("w")).alias("w"), T.citation_id(F.col("c")).alias("c"), T.citation_title(F.col("c")).alias("t"), T.normalized_url(F.col("u")).alias("u"), T.sensitivity(F.col("s")).alias("s"), T.redact(F.col("s"), T.PII).alias("r")).first()
    assert got.w == ["one", "two"] and got.c == "some-file_name.v2" and got.t == "some file name.v2"
    assert got.u == "host.com/team/repo" and got.s == "restricted" and got.r.endswith("at [REDACTED:email-address]")


def test_chain_reasons(spark):
    rows = spark.createDataFrame([("t", k, str(k), "promoted", "m", "{}") for k in range(1, 7)], "tenant_id string, seq long, id string, action string, memory_id string, details_json string")
    made = audit.chained(rows, "tenant_id")
    assert {r.reason for r in audit.verify_chain(made).collect()} == {None}
    first = made.where("seq = 1").first()
    body = {"id": "1", "action": "promoted", "memory_id": "m", "tenant_id": "t", "actor_json": "{}", "reason": "", "details_json": "{}", "prev_entry_hash": None}
    assert first.entry_hash == hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()
    edited = made.withColumn("action", F.when(F.col("seq") == 3, "deleted").otherwise(F.col("action")))
    assert {r.seq: r.reason for r in audit.verify_chain(edited).collect()} == {1: None, 2: None, 3: "content", 4: None, 5: None, 6: None}
    gone = made.where("seq <> 4")
    assert {r.seq: r.reason for r in audit.verify_chain(gone).collect()}[5] == "link"
    assert audit.verify_chain(made.limit(0)).count() == 0


def test_positions_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 3)
    frame = spark.range(0, 20, 2).withColumnRenamed("id", "seq")
    assert [r.position for r in audit.with_position(frame).orderBy("seq").collect()] == list(range(1, 11))


def test_policy_short_circuits(spark):
    frame = spark.createDataFrame([(1, "t", "short", "en", "high", "manual", "public"), (2, "t", "token = abcdefgh12 " * 4, "en", "high", "manual", "public"), (3, "t", "long enough text here, all is well", "en", "untrusted", "manual", "restricted"), (4, "t", "long enough text here, all is well", "en", "high", "manual", "public")], "id int, title string, content string, tenant_id string, trust_level string, source string, sensitivity string")
    got = {r.id: (r.outcome, r.rejected_by, list(r.flagged_by)) for r in policy.evaluate(frame, policy.recommended()).collect()}
    assert got[1] == ("rejected", "content_length", [])
    assert got[2] == ("rejected", "secret_detection", [])
    assert got[3] == ("flagged", None, ["source_trust", "sensitivity_gate"])
    assert got[4] == ("approved", None, [])


def test_fusion_ties_and_measures(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r.id: (r.score, r.best_rank) for r in search.fuse(one, two).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61), 1) and got["c"][1] == 2
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "query_id long, doc_id long")
    results = spark.createDataFrame([(1, 10, 2), (1, 12, 1)], "query_id long, doc_id long, rank int")
    rows = {r.query_id: r for r in reports.retrieval(results, gold).collect()}
    assert rows[1].recall == 0.5 and rows[1].mrr == 0.5 and rows[2].recall == 0 and rows[2].ndcg == 0


def test_contradictions_match_all_pairs(spark, data):
    from archivum.plans import domain

    memories = domain.memories(spark, data)
    got = {(r.left_id, r.right_id): r.similarity for r in similarity.contradictions(memories.where("id % 2 = 1"), memories, most=10**6).collect()}
    rows = memories.select("id", "tenant_id", "category", "lifecycle", "content_hash", T.content_tokens(F.col("content")).alias("w")).collect()
    wanted = {}
    for a in rows:
        for b in rows:
            if a.id % 2 and a.id != b.id and b.lifecycle == "active" and (a.tenant_id, a.category) == (b.tenant_id, b.category) and a.content_hash != b.content_hash:
                one, two = set(a.w), set(b.w)
                s = len(one & two) / len(one | two) if one | two else 0
                if s >= 0.6:
                    wanted[a.id, b.id] = pytest.approx(s)
    assert got == wanted


def test_sources_and_stream(spark, tmp_path):
    good = {"id": "1", "tenantId": "t", "content": "x", "capturedAt": "2026-01-01T00:00:00Z"}
    (tmp_path / "spool-a.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"id": "2"}) + "\n")
    (tmp_path / "spool-b.jsonl").write_text(json.dumps(good | {"id": "3"}) + "\nnot json\n")
    (tmp_path / "other.jsonl").write_text(json.dumps(good | {"id": "4"}) + "\n")
    assert [r.id for r in jsonl.spool(spark, str(tmp_path)).collect()] == ["1"]
    stream = intake.candidates(spark, str(tmp_path)).writeStream.format("memory").queryName("intake_rows").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r.id for r in spark.table("intake_rows").collect()) == ["1", "3"]
    log = tmp_path / "log.txt"
    log.write_text('{"event":"query-access","actor":"a","time":5,"citations":["x"]}\n{"event":"other"}\nnoise\n')
    assert [(r.actor, r.time) for r in jsonl.access_log(spark, str(log)).collect()] == [("a", 5)]


def test_markdown(spark, tmp_path):
    text = '---\n# note\nkey: "one"\nkey: two\nempty:\n---\n\n# Title\nbody'
    got = spark.createDataFrame([(text,), ("no front matter",)], "t string").select(markdown.parsed(F.col("t")).alias("p")).collect()
    assert got[0].p.front == {"key": "two", "empty": ""} and got[0].p.body == "# Title\nbody"
    assert got[1].p.front == {} and got[1].p.body == "no front matter"
    (tmp_path / ".git").mkdir()
    for name, body in (("a.md", "x"), ("b.txt", "x"), ("c.MDX", " \n"), (".git/d.md", "x")):
        (tmp_path / name).write_text(body)
    assert [r.path.rsplit("/", 1)[1] for r in markdown.vault(spark, str(tmp_path)).collect()] == ["a.md"]


def test_ignore_rules(spark):
    from archivum.functions.ignore import DEFAULTS, ignored

    paths = {"a/node_modules/x.js": True, "node_modules/x": True, "src/app.MIN.js": True, "src/app.js": False, "LICENSE.txt": True, "docs/keep/LICENSE": False, "/root.txt": True, "sub/root.txt": True, "a/b1.c": True}
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    rules = [*DEFAULTS, "# comment", "", "!docs/keep/**", "/root.txt", "b?.c"]
    assert {r.p: r.i for r in frame.select("p", ignored(F.col("p"), rules).alias("i")).collect()} == paths


def test_limits(spark):
    from archivum.operators.limits import limited

    events = spark.createDataFrame([("a", t) for t in (0, 1, 2, 10, 11, 12, 13)] + [("b", 5), (None, 1)], "k string, t long")
    got = [(r.k, r.t) for r in limited(events, "k", "t", 2, 10).where("not allowed").collect()]
    assert sorted(got) == [("a", 2), ("a", 10), ("a", 13)]


def test_breaks_and_files(spark):
    from archivum.operators import anchors

    breaks = spark.createDataFrame([("1", "h", None, 2, 1, "content"), ("2", "h", "p", 2, 2, "content"), ("3", "h", "p", 2, 3, "fork")], "id string, entry_hash string, prev_entry_hash string, hash_version int, seq int, reason string")
    manifest = breaks.withColumn("seq", F.when(F.col("id") == "2", 9).otherwise(F.col("seq")))
    assert {r.id: r["class"] for r in anchors.classified(breaks, manifest).collect()} == {"1": "documented", "2": "tamper", "3": "fork"}


def test_heuristics(spark):
    from archivum.functions import heuristics as Hx

    rows = [("We use three shards", "The store uses 3 shards.", True), ("We use 4 shards", "The store uses 3 shards.", False), ("Do not use shards", "Use shards here", False), ("Cats like milk", "Dogs drink water", False), ("", "anything", True)]
    frame = spark.createDataFrame(rows, "c string, e string, g boolean")
    for r in frame.select("c", "g", Hx.grounded(F.col("c"), F.col("e"), 0.5).alias("x")).collect():
        assert r.x == r.g, r.c
    paths = spark.createDataFrame([("Docs/ADR/my-first_note.md", "decision", "My First Note"), ("x/API/debug/a.md", "reference", "A"), ("plain.txt", "reference", "Plain")], "p string, c string, t string")
    for r in paths.select("*", Hx.path_category(F.col("p")).alias("pc"), Hx.path_title(F.col("p")).alias("pt")).collect():
        assert (r.pc, r.pt) == (r.c, r.t)
    texts = spark.createDataFrame([("x", " Untitled ", "untitled"), ("MIT License text", "t", "license"), ("a" * 1200, "t", "minified"), ("plain words here", "t", None)], "c string, t string, n string")
    for r in texts.select("n", Hx.noise(F.col("c"), F.col("t")).alias("x")).collect():
        assert r.x == r.n


def test_measures_of_all_texts(spark, tmp_path):
    """Long texts and nulls have rows too; entropy against counts."""
    import math
    from collections import Counter

    from archivum.plans import registry

    texts = ["", "aab", "\U0001f600a", "lorem ipsum dolor " * 2000, None]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = registry.queries()
    got = {r.id: r.entropy for r in queries["i10_entropy"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        n = len((text or "").encode("utf-16-le")) // 2
        assert got[k] == pytest.approx(sum(-c / n * math.log2(c / n) for c in Counter(text or "").values()), abs=1e-6)
    assert queries["o13_groundedness"](spark, str(tmp_path)).count() == len(texts)
