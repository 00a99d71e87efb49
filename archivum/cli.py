"""Command line: ``python -m archivum.cli COMMAND --data DIR [options]``.

Each command gives a DataFrame, which is printed as JSON lines; ``run`` gives
it to a caller. The exit code is that of the command (``code`` of its row, if
it has one).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.operators import audit, curation, index, records, search
from archivum.plans import domain as D


def _events(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["audit_events"].select("tenant_id", "seq", F.col("id").cast("string").alias("id"), "action", F.col("memory_id").cast("string").alias("memory_id"), "details_json")


def verify(tables, options) -> DataFrame:
    made = audit.chained(_events(tables), "tenant_id")
    return audit.exit_code(audit.verify_chain(made, by=["tenant_id"]))


def accounting(tables, options) -> DataFrame:
    receipts = tables["audit_events"].where("action = 'promoted'").select(F.col("memory_id").alias("id"))
    orphans = tables["memories"].join(receipts, "id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return orphans.withColumn("code", F.when(F.col("orphans") > 0, 2).otherwise(0))


def transition(tables, options) -> DataFrame:
    rows = records.find(tables["memories"], source=options.source, category=options.category)
    if options.before:
        rows = rows.where(F.col("updated_at") < F.lit(options.before).cast("timestamp"))
    if not (options.source or options.category or options.before):
        raise SystemExit("at least one of --source, --category and --before is needed")
    return records.with_transition(rows, F.lit(options.to)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def export(tables, options) -> DataFrame:
    rows = records.find(records.exportable(tables["memories"]), tenant_id=options.tenant)
    from archivum.functions.text import directory

    return rows.groupBy(directory(F.col("lifecycle"), F.col("source"), F.col("category")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


def reindex(tables, options) -> DataFrame:
    return index.health({"documents": tables["memories"], "postings": search.postings(tables["memories"])})


def canary(tables, options) -> DataFrame:
    spark = tables["memories"].sparkSession
    controls = spark.createDataFrame([(q,) for q in options.queries], "query_id string")
    found = F.array(*[F.when(F.contains("content", F.lit(q)), F.lit(q)) for q in options.queries])
    hits = tables["memories"].select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("query_id"))
    return index.canary(hits, controls, options.least)


def merge(tables, options) -> DataFrame:
    parts = [tables["memories"].where(F.col("id") % options.clones == k) for k in range(options.clones)]
    return curation.union_of_clones(parts).agg(F.count(F.lit(1)).alias("n"))


COMMANDS = {"verify": verify, "accounting": accounting, "transition": transition, "export": export, "reindex": reindex, "canary": canary, "merge": merge}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="archivum")
    out.add_argument("command", choices=sorted(COMMANDS))
    out.add_argument("--data", required=True, help="folder of the Parquet tables")
    out.add_argument("--source")
    out.add_argument("--category")
    out.add_argument("--before", help="instants before this one")
    out.add_argument("--to", default="deprecated", choices=D.LIFECYCLES)
    out.add_argument("--tenant")
    out.add_argument("--queries", nargs="*", default=["the"])
    out.add_argument("--least", type=int, default=1)
    out.add_argument("--clones", type=int, default=2)
    return out


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    options = parser().parse_args(arguments)
    return COMMANDS[options.command](D.tables(spark, options.data), options)


def main(arguments: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    code = 0
    made = run(spark, arguments)
    for row in made.toJSON().toLocalIterator():
        print(row)
    if "code" in made.columns:
        code = int(made.agg(F.max("code")).first()[0] or 0)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
