"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest

import corpus_pipeline
from archivum.llm import quality
from archivum.llm._shared import remainder, stored
from support import contaminated, near_duplicate_groups


@pytest.fixture(scope="module")
def stages(spark, data):
    """The input and output rows of every stage."""
    docs, found = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, data), "test-stage")
        found.append(({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}))
        docs = out
    return found


def test_columns(spark, data, stages):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    for _, out in stages[:-1]:
        assert all(list(r.asDict()) == columns for r in out.values())


def test_quality(spark, data, stages):
    from pyspark.sql import functions as F

    before, after = stages[0]
    labels = spark.read.parquet(f"{data}/labels.parquet").where(remainder(F.col("doc_id"), 5) != 0)
    network = quality.learn(labels, spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", "quality")
    ids = sorted(before)
    scores = network.score([before[k].text for k in ids])
    assert {k for k, s in zip(ids, scores) if s >= corpus_pipeline.QUALITY_THRESHOLD} == set(after)


def test_near_duplicates(stages):
    before, after = stages[1]
    groups = near_duplicate_groups({k: r.text for k, r in before.items()}, 5, 80)
    assert set(after) == set(groups.values())
    assert all(after[k] == before[k] for k in after)


def test_decontamination(spark, data, stages):
    before, after = stages[2]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {k for k, r in before.items() if contaminated(r.text, items)}
    assert set(after) == set(before) - leaks


def test_secrets(stages):
    before, after = stages[3]
    assert set(before) == set(after)
    base = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.I)
    for k, r in before.items():
        if not base.search(r.text):
            assert after[k].text == r.text
        else:
            assert "[SECRET]" in after[k].text and not re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", after[k].text)
        assert after[k].n_chars == len(after[k].text)


def test_tokens(stages):
    import public_tokenizers
    import tiktoken

    from archivum.llm import bpe

    before, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(before) == set(after)
    for k, r in after.items():
        assert list(r.ids) == library.encode_ordinary(before[k].text) and r.n_tokens == len(r.ids) and r.round_trip


EDGES = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, h long, id long, kept boolean, row string"
ONE, OTHER = " ".join(f"alpha{k}" for k in range(40)), " ".join(f"beta{k}" for k in range(40))


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(1, ONE), (1, ONE), (1, OTHER), (None, ONE), (2, None), (3, ""), (4, "x " * 30_000), (5, ONE + " more"), (6, OTHER), (None, "by itself alone")]
    return spark.createDataFrame([(k, t, "en", None, None, 0.5, 1, 7, 9, True, "r") for k, t in rows], EDGES)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_empty_tables(spark, data, edge_docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, edge_docs, data)
    assert out.columns == edge_docs.columns and out.count() <= edge_docs.count()
    assert stage(spark, edge_docs.limit(0), data).count() == 0


def test_one_of_each_id_and_text_stays(spark, data, edge_docs):
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.keep_one_of_each(spark, edge_docs, data).collect())
    assert kept == sorted([(1, ONE), (1, OTHER), (2, ""), (3, ""), (4, "x " * 30_000), (0, "by itself alone")])


def test_leaks_go_by_text(spark, data):
    item = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(5, item), (5, "nothing of it"), (None, item), (None, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, data).collect()]
    assert sorted(kept, key=str) == sorted([(5, "nothing of it"), (None, None)], key=str)


def test_redaction_and_tokens_keep_every_row(spark, data, edge_docs):
    clean = corpus_pipeline.redact_secrets(spark, edge_docs, data)
    assert clean.count() == edge_docs.count()
    tokens = corpus_pipeline.to_tokens(spark, clean, data).collect()
    assert len(tokens) == edge_docs.count() and all(r.round_trip for r in tokens)
    assert corpus_pipeline.to_tokens(spark, edge_docs.limit(0), data).count() == 0
