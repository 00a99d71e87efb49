"""Registered queries of evaluation (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions import disclosure, heuristics
from archivum.functions import text as T
from archivum.operators import reports, search
from archivum.plans import domain as D
from archivum.plans import sqltext as S
from archivum.plans.lookups import RETRIEVED_SQL, retrieved
from archivum.plans.registry import QUERY, query
from archivum.plans.scalars import WITH_PLANTS, planted

MEASURED_SQL = (
    RETRIEVED_SQL
    + """, h AS (SELECT r.query_id, count(*) AS n_hits, max(1 / rank) AS rr, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id WHERE rank <= 10 GROUP BY 1),
    m AS (SELECT w.query_id, coalesce(n_hits, 0) / n_gold AS recall, coalesce(rr, 0) AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM (SELECT query_id, count(*) AS n_gold FROM g GROUP BY 1) w LEFT JOIN h ON w.query_id = h.query_id) """
)


@query(plain=MEASURED_SQL + "SELECT query_id, recall FROM m")
def o1_recall(s, d):
    return reports.retrieval(*retrieved(s, d)).select("query_id", "recall")


@query(plain=MEASURED_SQL + "SELECT query_id, round(ndcg, 9) AS ndcg FROM m")
def o2_ndcg(s, d):
    return reports.retrieval(*retrieved(s, d)).select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query(plain=MEASURED_SQL + "SELECT query_id, rr FROM m")
def o3_reciprocal_rank(s, d):
    return reports.retrieval(*retrieved(s, d)).select("query_id", F.col("mrr").alias("rr"))


FLOORS = [("lexical", 0.2), ("semantic", 0.9), ("untested", 0.1)]
_SHARES = "SELECT CASE WHEN doc_id % 2 = 0 THEN 'lexical' ELSE 'semantic' END AS stratum, avg(quality) AS measured FROM labels GROUP BY 1"


def measured(s, d):
    stratum = F.when(F.col("doc_id") % 2 == 0, "lexical").otherwise("semantic")
    return D.read(s, d, "labels").groupBy(stratum.alias("stratum")).agg(F.avg("quality").alias("measured"))


@query(plain=f"SELECT stratum, round(measured, 9) AS measured, floor, coalesce(measured, 0) >= floor - 0.001 AS ok FROM (VALUES ('lexical', 0.2::DOUBLE), ('semantic', 0.9::DOUBLE), ('untested', 0.1::DOUBLE)) f(stratum, floor) LEFT JOIN ({_SHARES}) USING (stratum)")
def o6_floors(s, d):
    wanted = s.createDataFrame(FLOORS, "stratum string, floor double")
    return reports.floors(measured(s, d), wanted).withColumn("measured", F.round("measured", 9))


@query(plain=f"SELECT stratum, floor(measured * 10000) / 10000 AS floor FROM ({_SHARES})")
def o6_proposed_floors(s, d):
    return reports.proposed_floors(measured(s, d))


@query(plain=MEASURED_SQL + "SELECT round(avg(recall), 9) AS recall, avg(recall) >= 0.85 AS sufficient FROM m")
def o7_sufficiency(s, d):
    row = reports.retrieval(*retrieved(s, d)).agg(F.avg("recall").alias("r"))
    return row.select(F.round("r", 9).alias("recall"), (F.col("r") >= 0.85).alias("sufficient"))


#: What the planted texts should be caught by.
EXPECTED = {0: ["secret-scanner", "content-classifier", "boundary-disclosure"], 1: ["secret-scanner", "content-classifier", "boundary-disclosure"], 2: ["content-classifier"], 3: ["content-classifier", "boundary-disclosure"], 4: ["content-classifier"], 5: ["secret-scanner", "content-classifier"], 6: ["boundary-disclosure"], 7: ["secret-scanner", "content-classifier"], 8: ["boundary-disclosure"]}
CHECKS = ["secret-scanner", "content-classifier", "boundary-disclosure"]
_CASES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"check\", {caught} AS caught, id % 12 IN ({', '.join(str(k) for k, e in EXPECTED.items() if c in e)}) AS expected, id % 12 AS k FROM planted"
    for c, caught in zip(CHECKS, [S.has_secret("content"), f"{S.sensitivity('content')} <> 'public'", f"({S.disclosed('content')}) IS NOT NULL"])
)


@query(WITH_PLANTS + f"""SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 4) AS recall FROM
    (SELECT "check", count(*) FILTER (caught AND expected) AS tp, count(*) FILTER (caught AND NOT expected) AS fp, count(*) FILTER (NOT caught AND expected) AS fn, count(*) FILTER (NOT caught AND NOT expected) AS tn FROM ({_CASES}) WHERE expected OR k > 8 GROUP BY "check")""")
def o8_govern_decisions(s, d):
    """A planted text counts for the checks that should catch it, one without
    for all of them."""
    k, text = F.col("id") % 12, F.col("content")
    rows = planted(s, d).withColumn("clean", disclosure.canonical(text))
    caught = {"secret-scanner": T.has_secret(text), "content-classifier": T.sensitivity(text) != "public", "boundary-disclosure": disclosure.category(F.col("clean")).isNotNull()}
    cases = F.array(*[F.struct(F.lit(c).alias("check"), caught[c].alias("caught"), k.isin([n for n, e in EXPECTED.items() if c in e]).alias("expected")) for c in CHECKS])
    scored = rows.select(k.alias("k"), F.explode(cases).alias("c")).select("k", "c.*").where("expected or k > 8")
    return reports.check_metrics(scored)


@query(S.bm25() + ", top AS (SELECT id FROM hits ORDER BY round(score, 9) DESC, id LIMIT 5), probes AS (SELECT id % 4 AS probe, id FROM memories WHERE contains(content, 'the') AND id % 50 = 0) SELECT probe, round(avg(CASE WHEN id IN (SELECT id FROM top) THEN 1.0 ELSE 0.0 END), 9) AS recall FROM probes GROUP BY probe")
def o12_memory_utility(s, d):
    """How much of what each probe expects is among the five best hits."""
    rows = D.memories(s, d)
    best = search.top(search.bm25(rows, QUERY).select("id", F.round("score", 9).alias("score")), 5).select("id", F.lit(1.0).alias("hit"))
    probes = rows.where("id % 50 = 0").where(F.contains("content", F.lit("the"))).select((F.col("id") % 4).alias("probe"), "id")
    return probes.join(best, "id", "left").groupBy("probe").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("recall"))


@query("SELECT id, round(len(list_filter(c, lambda t: list_contains(w, t))) / len(c), 6) AS exact_support FROM (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z]{8,}')) AS c, list_distinct(regexp_extract_all(lower(content), '[a-z]{8,}')) AS w FROM memories) WHERE len(c) > 0")
def h11_title_support(s, d):
    """Of a title's long words, the share that occurs in the content as it is."""
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{8,}"), F.lit(0)))
    rows = D.memories(s, d).select("id", long("title").alias("c"), long("content").alias("w")).where(F.size("c") > 0)
    return rows.select("id", F.round(F.size(F.array_intersect("c", "w")) / F.size("c"), 6).alias("exact_support"))


@query()
def o13_groundedness(s, d):
    """Each record's title as a claim about its content."""
    rows = D.memories(s, d)
    return rows.select("id", F.round(heuristics.support(F.col("title"), F.col("content")), 6).alias("support"), heuristics.grounded(F.col("title"), F.col("content")).alias("grounded"))


@query("SELECT count(*) AS n, count(*) FILTER (id % 2 = 1) AS unsupported, 1.0::DOUBLE AS catch_rate FROM memories")
def o14_groundedness_eval(s, d):
    """Titles as they are (supported), and with a number that the content
    hasn't (not supported): all of those are caught."""
    rows = D.memories(s, d).select("content", (F.col("id") % 2 == 0).alias("supported"), F.concat("title", F.when(F.col("id") % 2 == 1, " 987654321987").otherwise("")).alias("claim"))
    items = rows.select("supported", heuristics.grounded(F.col("claim"), F.col("content")).alias("predicted"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("supported")).alias("unsupported"))
    return counts.crossJoin(reports.groundedness(items).select("catch_rate"))  # a row each
