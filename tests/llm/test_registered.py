"""The registered queries against brute force, exact values or held-out floors."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from archivum.llm import ann, lm, quality, queries, secrets
from support import near_duplicate_groups

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def rows(folder, name, columns="*"):
    return duckdb.sql(f"select {columns} from read_parquet('{folder}/{name}.parquet')").fetchall()


@pytest.fixture(scope="module")
def texts(data):
    return dict(rows(data, "documents", "doc_id, text"))


def remainder(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1.0
    truth = np.asarray(truth)
    n1, n0 = truth.sum(), (1 - truth).sum()
    return (order[truth == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_op3_finds_the_nearest(spark, data):
    vectors = {k: np.array(v, float) for k, v in rows(data, "embeddings", "vec_id, embedding") if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = {}
    for r in queries.op3_ann(spark, data).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {k for k in vectors if k % 20 == 0}
    hits = total = 0
    for q, got in found.items():
        got.sort()
        wanted = sorted((k for k in vectors if k != q), key=lambda k: (-float(vectors[q] @ vectors[k]), k))[:20]
        assert [r for r, _, _ in got] == list(range(1, len(wanted) + 1))
        assert all(s == pytest.approx(float(vectors[q] @ vectors[k])) for _, k, s in got)
        hits, total = hits + len({k for _, k, _ in got} & set(wanted)), total + len(wanted)
    assert hits >= 0.9 * total


def test_op4_columns(spark, data, texts):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = queries.op4_secrets(spark, data).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(texts[r.doc_id] or "") if ok(m)]
        counts = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (counts[0], counts[1], counts[2])
        base = [x for _, _, x in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert [x for x in own if not x.startswith("markov")] == base and sorted(own, key=lambda x: int(x.split(":")[1])) == own


def test_op4_finds_planted_keys_and_leaves_names_alone(spark, data):
    import random
    import string

    rng = random.Random(5)
    documents = spark.read.parquet(f"{data}/documents.parquet")
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(24, 48))) for _ in range(60)]
    keys += [base64.b64encode(rng.randbytes(30)).decode() for _ in range(40)]
    names = [
        "/usr/local/lib/python/site-packages", "getElementByIdAndClassName", "kubectl-apply-configuration-manifests", "MAX_CONNECTION_RETRY_TIMEOUT",
        "some_very_long_snake_case_name", "internationalization-and-localization", "AbstractSingletonProxyFactoryBean", "createServerSideTranslations",
        "======================================", "----------------------------", "/var/log/nginx/access/error/archive", "antidisestablishmentarianism",
    ]
    planted = [(10**9 + k, f"see {w} here") for k, w in enumerate(keys)] + [(2 * 10**9 + k, f"see {w} here") for k, w in enumerate(names)]
    both = documents.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {r.key: r.spans for r in secrets.secrets(both).where("key >= 1000000000").collect()}
    assert sum(bool(found[10**9 + k]) for k in range(len(keys))) >= 0.9 * len(keys)
    assert not [w for k, w in enumerate(names) if found[2 * 10**9 + k]]
    clean = {r.doc_id: r.text for r in secrets.without_secrets(both).where("doc_id >= 1000000000").collect()}
    assert all(clean[2 * 10**9 + k] == f"see {w} here" for k, w in enumerate(names))
    assert sum(clean[10**9 + k] == "see [SECRET] here" for k in range(len(keys))) >= 0.9 * len(keys)


def test_many_matches_have_their_places(spark):
    text = "".join(f"é token: abcdef{k:04d} " for k in range(1500))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.secrets(frame).first().spans
    assert len(spans) == 1500 and all(text[s.start : s.end] == f"token: abcdef{k:04d}" for k, s in enumerate(spans))


def test_op6_payloads(spark, data):
    pages = {k: (html or "").encode() for k, html in rows(data, "pages", "page_id, html")}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    found = queries.op6_warc(spark, data).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for r in found:
        body = pages[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = first[body] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if same else ("revisit", first[body]))


def test_op6_salted_join_is_the_same(spark, data, monkeypatch):
    from archivum.llm import warc

    wanted = sorted(map(str, queries.op6_warc(spark, data).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    assert sorted(map(str, queries.op6_warc(spark, data).collect())) == wanted


def test_op7_groups(spark, data, texts):
    groups = near_duplicate_groups(texts, 2, 80)
    found = queries.op7_neardup(spark, data).collect()
    assert {r.doc_id: r.component_id for r in found} == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_op7_sql(spark, data):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    wanted = connection.sql(queries.ORACLE_SQL["op7_neardup"]).fetchall()
    got = queries.op7_neardup(spark, data).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_op8_base(spark, data, texts):
    counts = Counter()
    for k, text in texts.items():
        if remainder(k, 5) != 1:
            counts.update((text or "").encode().lower().split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    found = queries.op8_lm(spark, data).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        tokens = (texts[r.doc_id] or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        assert r.held_out == (remainder(r.doc_id, 5) == 1) and r.n_tokens == len(tokens) and r.train_tokens == total
        assert r.n_known == sum(counts[t] > 0 for t in tokens) and r.base_score == pytest.approx(base) and r.score < 0
    bits = lambda name: sum(r[name] for r in found if r.held_out)
    assert bits("score") > bits("base_score")


@pytest.mark.parametrize("name, label, threshold, folder", [("op2_toxicity", "toxic", 0.5, LARGEST), ("op9_quality", "quality", 0.3, LARGER)])
def test_classifiers_hold_out(spark, name, label, threshold, folder):
    """The smaller tables have six toxic texts held out, too few to tell."""
    truth = dict(rows(folder, "labels", f"doc_id, {label}"))
    found = queries.QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(k for (k,) in rows(folder, "documents", "doc_id"))
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)
    held = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert auc(*zip(*held)) >= 0.95
    assert np.mean([(s >= threshold) == bool(y) for s, y in held]) >= 0.9


def test_language_holds_out(spark):
    truth = {k: lang for k, lang, text in rows(LARGER, "documents", "doc_id, lang, text") if lang and text and re.search(r"[^\W\d_]", text)}
    held = [(r.lang_pred, truth[r.doc_id]) for r in queries.op5_langid(spark, LARGER).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) >= 0.97


def numeric(loss, weights, grads, picks=6, step=1e-4):
    """Central differences at some places of every weight."""
    rng = np.random.default_rng(1)
    for name, w in weights.items():
        flat, own = w.reshape(-1), np.asarray(grads[name]).reshape(-1)
        places = np.argsort(-np.abs(own))[:picks].tolist() + rng.integers(0, len(flat), 2).tolist()
        for at in places:
            kept = flat[at]
            flat[at] = kept + step
            above = loss()
            flat[at] = kept - step
            below = loss()
            flat[at] = kept
            assert own[at] == pytest.approx((above - below) / (2 * step), rel=2e-2, abs=2e-5), name


@pytest.mark.parametrize("block", [1024, 3])
def test_quality_gradients(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    net = quality.Network(seed=2)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    documents = [quality.segments("".join(map(chr, rng.integers(97, 123, n)))) for n in (900, 100, 300)]
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])

    def loss():
        counts = np.array([len(d) for d in documents])
        inputs, starts, _ = net.document_inputs(*net.blocks(np.concatenate(documents)), counts)
        hidden = np.maximum(inputs @ net.weights["hidden"] + net.weights["hidden_bias"], 0)
        pooled = np.concatenate((np.maximum.reduceat(hidden, starts), np.add.reduceat(hidden, starts) / counts[:, None]), axis=1)
        p = 1 / (1 + np.exp(-(pooled @ net.weights["out"] + net.weights["out_bias"][0])))
        return -float(weight @ (target * np.log(p) + (1 - target) * np.log(1 - p)))

    numeric(loss, net.weights, net.gradients(documents, target, weight), step=1e-6)


def test_language_model_gradients():
    net = lm.Network(seed=2, side=4)
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    tokens, targets = rng.integers(0, 16, (5, 3)), rng.integers(0, 16, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[2, 1] = True, True

    def loss():
        state, logs = np.zeros((3, lm.HIDDEN)), 0.0
        for t in range(5):
            state = net.step(tokens[t], state * ~fresh[t][:, None])[0]
            logs += float(net.log_probabilities(state, targets[t]).sum())
        return -logs / 15

    grads, _ = net.gradients(tokens, targets, fresh, np.zeros((3, lm.HIDDEN)))
    numeric(loss, net.weights, grads)


def test_every_training_token_is_fitted(monkeypatch):
    seen = []
    real = lm.Adam.fit
    monkeypatch.setattr(lm.Adam, "fit", lambda self, stream, begins, lanes, length, window, rate: (seen.append(lanes * length), real(self, stream, begins, lanes, length, window, rate))[1])
    documents = [np.arange(2, 2 + n, dtype=np.int32) for n in (0, 7, 300, 41)]
    lm.train(documents, np.ones(lm.CLASSES**2), epochs=2)
    assert sum(seen) == 2 * sum(len(d) + 1 for d in documents)


def test_hot_words_of_one_step(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 1) for k in range(5000)] + [(b"often", 900)], "word binary, n long")
    found = lm.hot_words(counts, 1000)
    assert found[b"often"] == 900 and 800 <= len(found) <= 1200


def test_lists_of_the_index_cover_all_rows():
    x = np.random.default_rng(3).standard_normal((400, 8)).astype(np.float32)
    index = ann.Index(x, 400, 20)
    lists, codes = index.encode(x)
    assert len(lists) == len(codes) == 400 and lists.max() < index.lists
