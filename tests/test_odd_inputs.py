"""Registered queries on documents made for the test, against their SQL."""

import shutil

import duckdb
import pytest

from archivum.plans import registry


@pytest.fixture
def differing(spark, data, tmp_path):
    """Rows that only a query has and rows that only its SQL has, on documents
    (id, text) of one language."""

    def run(name, documents):
        folder = str(tmp_path)
        for table in ("events", "lineitem"):
            shutil.copy(f"{data}/{table}.parquet", folder)
        spark.createDataFrame([(k, t, "en") for k, t in documents], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
        connection = duckdb.connect()
        connection.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        wanted = connection.sql(registry.oracle_sql()[name])
        got = registry.queries()[name](spark, folder).select(*wanted.columns).collect()
        return sorted({tuple(r) for r in got} ^ set(wanted.fetchall()))

    return run


PROSE = "a text of more than fifteen words that says one thing and another so that the policy finds it long and good enough "


def test_records_taken_alone_are_no_copies_of_each_other(differing):
    """Equal contents of which the policy promotes the first and flags others."""
    assert differing("k8_process_one", [(k, PROSE * 3) for k in range(1, 200, 10)]) == []


def test_titles_of_any_characters_are_link_targets(differing):
    titles = ["plain", "a | b", "a  b", "[x] y", "x y", "`code`", " edges ", "", "50% + 1:2", "Ünï"]
    assert differing("d12_wiki_link_targets", [(k, t + "\nbody") for n, t in enumerate(titles) for k in (20 * n, 20 * n + 1)]) == []


def test_a_rule_with_no_upper_bound(differing):
    assert differing("q1_rule_registry", [(k, "x" * n) for k, n in enumerate([0, 99, 100, 50_000, 50_001, 120_000] * 4)]) == []


def near_copies():
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[: 40 - n]) for n in (0, 1, 2, 9, 20)] * 20
    return [*enumerate([*texts, None, "", "...", "w1", "w1 w2", "W1"])]


def test_suspects_of_copies_and_empty_texts(differing):
    assert differing("g10_suspects", near_copies()) == []


def test_contradictions_of_copies_and_empty_texts(differing):
    assert differing("j9_contradiction_check", near_copies()) == []
