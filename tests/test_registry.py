"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import re

import duckdb
import pytest

from archivum.functions import heuristics
from archivum.plans import domain, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(data):
    connection = duckdb.connect()
    for name in os.listdir(data):
        connection.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{data}/{name}')")
    return connection


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, tables, name):
    got, wanted = QUERIES[name](spark, data).toPandas(), tables.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


def test_every_query_but_one_has_sql():
    assert set(SQL) < set(QUERIES) and set(QUERIES) - set(SQL) == {"o13_groundedness"}


def test_groundedness_against_plain_python(spark, data):
    """Support of titles, token by token; it is needed for being grounded."""

    def content(text):
        skip = {*heuristics.STOPWORDS, *heuristics.NEGATIONS, *heuristics.NUMBERS}
        return {t for t in re.findall("[a-z0-9]+", text.lower()) if t not in skip and not t.isdigit()}

    def variants(t):
        out = {t}
        if len(t) > 3 and t.endswith("s") and not t.endswith("ss"):
            out.add(t[:-1])
        if len(t) > 4 and t.endswith("es"):
            out.add(t[:-2])
        if len(t) > 4 and t.endswith("ed"):
            out |= {t[:-2], t[:-2] + "e"}
        if len(t) > 5 and t.endswith("ing"):
            out |= {t[:-3], t[:-3] + "e"}
        return out

    texts = {r.id: (r.title, r.content) for r in domain.memories(spark, data).select("id", "title", "content").collect()}
    found = QUERIES["o13_groundedness"](spark, data).collect()
    assert sorted(r.id for r in found) == sorted(texts)
    for r in found:
        own, known = content(texts[r.id][0]), set().union(*map(variants, content(texts[r.id][1])), set())
        share = sum(1 for t in own if variants(t) & known) / len(own) if own else 1.0
        assert r.support == pytest.approx(share, abs=1e-6) and (not r.grounded or share >= 0.7)
