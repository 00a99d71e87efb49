"""Policy rules as columns, and their evaluation in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import text as T

#: Ordinals of trust, and sources that a low relevance rejects.
TRUST_ORDER = {"high": 4, "medium": 3, "low": 2, "untrusted": 1}


def secret_detection() -> Column:
    return F.when(T.has_secret(F.col("content")), "fail").otherwise("pass")


def content_length(least: int = 10, most: int | None = 50_000) -> Column:
    """Without ``most`` no content is too long."""
    n = T.utf16_length(F.col("content"))
    outside = n < least if most is None else (n < least) | (n > most)
    return F.when(outside, "fail").otherwise("pass")


def tenant_match(tenant: str | None) -> Column:
    return F.lit("pass") if tenant is None else F.when(F.col("tenant_id").eqNullSafe(F.lit(tenant)), "pass").otherwise("fail")


def source_trust(least: str = "low", below: str = "fail") -> Column:
    order = F.create_map(*[F.lit(x) for item in TRUST_ORDER.items() for x in item])
    return F.when(F.coalesce(F.try_element_at(order, F.col("trust_level")), F.lit(0)) < TRUST_ORDER[least], below).otherwise("pass")


def relevance() -> Column:
    """A sum of fixed weights for what a record has; three decimals."""
    n = T.utf16_length(F.col("content"))
    words = F.size(F.array_distinct(F.filter(F.split(F.lower(F.col("content")), r"\s+"), lambda w: w != "")))
    score = F.when(F.trim("title") != "", 0.2).otherwise(0.0) + F.when(n > 200, 0.2).when(n > 50, 0.1).otherwise(0.0) + F.lit(0.05)
    score = score + F.when(F.col("trust_level") == "high", 0.05).otherwise(0.0) + F.when(words > 15, 0.1).otherwise(0.0)
    return F.round(score + F.when(F.col("source").isin("manual", "import"), 0.1).otherwise(0.0), 3)


def sensitivity_gate(blocked: list[str] | None = None) -> Column:
    return F.when(F.col("sensitivity").isin(blocked or ["restricted", "confidential"]), "fail").otherwise("pass")


def content_sanitization() -> Column:
    return F.when(F.size(T.matched(F.col("content"), T.SANITIZATION)) > 0, "flag").otherwise("pass")


def evaluate(df: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Adds outcome (rejected, flagged or approved), rejected_by and
    flagged_by. ``rules`` are (name, result, action) in order: the first
    failure of a rejecting rule ends the evaluation, and other failures and
    flags before it flag the row."""
    results = F.array(*[F.struct(F.lit(n).alias("rule"), r.alias("result"), F.lit(a).alias("action")) for n, r, a in rules])
    df = df.withColumn("__r", results)
    rejects = lambda x: (x["result"] == "fail") & (x["action"] == "reject")
    df = df.withColumn("rejected_by", F.try_element_at(F.filter("__r", rejects), F.lit(1))["rule"])
    place = F.array_position(F.transform("__r", lambda x: x["rule"]), F.col("rejected_by"))
    seen = F.slice("__r", 1, F.coalesce(place, F.lit(len(rules) + 1)).cast("int") - 1)
    df = df.withColumn("flagged_by", F.transform(F.filter(seen, lambda x: x["result"] != "pass"), lambda x: x["rule"]))
    outcome = F.when(F.col("rejected_by").isNotNull(), "rejected").when(F.size("flagged_by") > 0, "flagged").otherwise("approved")
    return df.withColumn("outcome", outcome).drop("__r")


def recommended(tenant: str | None = None) -> list[tuple[str, Column, str]]:
    return [
        ("secret_detection", secret_detection(), "reject"),
        ("content_length", content_length(25), "reject"),
        ("tenant_match", tenant_match(tenant), "reject"),
        ("source_trust", source_trust("low", "flag"), "flag"),
        ("relevance_score", F.when(relevance() < 0.3, "fail").otherwise("pass"), "flag"),
        ("sensitivity_gate", sensitivity_gate(), "flag"),
        ("content_sanitization", content_sanitization(), "flag"),
    ]


#: Every rule there is, by priority, and those that reject.
RULES = ["secret_detection", "content_length", "tenant_match", "dedup_check", "source_trust", "relevance_score", "sensitivity_gate", "content_sanitization", "contradiction_check"]
REJECTING = ["secret_detection", "content_length", "tenant_match", "dedup_check"]
#: The rules that look at a row alone, by name (each may be replaced).
EVALUATORS = {
    "secret_detection": secret_detection,
    "content_length": content_length,
    "tenant_match": tenant_match,
    "source_trust": source_trust,
    "relevance_score": lambda least=0.3: F.when(relevance() < least, "fail").otherwise("pass"),
    "sensitivity_gate": sensitivity_gate,
    "content_sanitization": content_sanitization,
}


def from_registry(rules: list[tuple[str, dict, str]]) -> list[tuple[str, Column, str]]:
    """Rules (name, parameters, action) as ``evaluate`` takes them; a name that
    no evaluator has is an error."""
    unknown = [n for n, _, _ in rules if n not in EVALUATORS]
    if unknown:
        raise ValueError(f"no evaluator for {', '.join(unknown)}")
    return [(n, EVALUATORS[n](**parameters), action) for n, parameters, action in rules]


def recommended_table(spark) -> DataFrame:
    """priority, rule and rejects of the recommended policy."""
    return spark.createDataFrame([(k, r, r in REJECTING) for k, r in enumerate(RULES)], "priority int, rule string, rejects boolean")


def lacking(rules: Column, waived: list[str] = []) -> Column:  # noqa: B006
    """The rules that an array of names hasn't, sorted; ``waived`` may lack."""
    return F.array_sort(F.array_except(F.array(*[F.lit(r) for r in RULES if r not in waived]), rules))


def dormant(policies: DataFrame) -> DataFrame:
    """id and uncovered rules of the enabled policies that lack any."""
    rows = policies.where("enabled").select("id", lacking(F.col("rules")).alias("uncovered"))
    return rows.where(F.size("uncovered") > 0)


def upgraded(policies: DataFrame) -> DataFrame:
    """tenant_id, action, version and rules of each tenant's policy after an
    upgrade: created where none is enabled, replaced (version + 1) where the
    first enabled one lacks rules, else kept."""
    first = F.min_by(F.struct("version", "rules"), "id")
    rows = policies.groupBy("tenant_id").agg(F.min(F.when(F.col("enabled"), F.col("id"))).alias("id"))
    known = policies.where("enabled").groupBy("tenant_id").agg(first.alias("p"))
    joined = rows.join(known, "tenant_id", "left")
    full = F.array(*[F.lit(r) for r in RULES])
    action = F.when(F.col("p").isNull(), "created").when(F.size(lacking(F.col("p.rules"))) > 0, "replaced").otherwise("kept")
    version = F.when(action == "created", 1).when(action == "replaced", F.col("p.version") + 1).otherwise(F.col("p.version"))
    return joined.select("tenant_id", action.alias("action"), version.alias("version"), F.when(action == "kept", F.col("p.rules")).otherwise(full).alias("rules"))


def in_order(rules: Column) -> Column:
    """The names of enabled rules (rule, priority, enabled) as they are
    evaluated: contradictions first, then the others, each by priority."""
    placed = F.transform(F.filter(rules, lambda r: r["enabled"]), lambda r: F.struct((r["rule"] != "contradiction_check").alias("late"), r["priority"].alias("priority"), r["rule"].alias("rule")))
    return F.transform(F.array_sort(placed), lambda r: r["rule"])


def contradiction_check(candidates: DataFrame, memories: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Candidates with ``contradiction_check`` (flag or pass, never fail) and
    the similarity of the closest memory that differs (score, or null)."""
    from archivum.operators import similarity

    limit = min(1.0, max(0.0, threshold))
    found = similarity.contradictions(candidates, memories, limit, 1).select(F.col("left_id").alias("id"), F.col("similarity").alias("score"))
    return candidates.join(found, "id", "left").withColumn("contradiction_check", F.when(F.col("score").isNull(), "pass").otherwise("flag"))


def failing_enum(members: dict[str, list[str]]) -> Column:
    """The first column whose value is no member; where the value itself
    discloses something, what it discloses."""
    from archivum.functions import disclosure

    failing = F.lit(None).cast("string")
    for column, values in reversed(members.items()):
        failing = F.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), F.coalesce(disclosure.category(F.col(column)), F.lit(column))).otherwise(failing)
    return failing
