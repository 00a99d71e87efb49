"""Intake, gates, promotion, rejection, lifecycle and merges of records.

Each function gives DataFrames of what is to be written; nothing is written
here. Rows of a batch depend on each other only through the first promoted row
of a content, which is an aggregate and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions import disclosure, hashing, heuristics, ignore
from archivum.functions import text as T
from archivum.operators import anchors, audit, policy, records, similarity
from archivum.plans import domain as D
from archivum.sources import files, jsonl

IMPORTS = ["import", "bulk_import"]


def captured(events: DataFrame) -> DataFrame:
    """Captured texts as candidates: content hash, whether a secret occurs,
    tenant ``unknown`` if there is none, status inbox."""
    return events.select("id", F.coalesce("tenant_id", F.lit("unknown")).alias("tenant_id"), "title", "content", hashing.content_hash(F.col("content")).alias("content_hash"), T.has_secret(F.col("content")).alias("secrets_detected"), F.lit("inbox").alias("status"))


def overridden(candidates: DataFrame, actor: str, role: str, tenants: list[str]) -> DataFrame:
    """What an intake knows better than the sender: the actor is the author, a
    member's trust is untrusted, a token for one tenant sets it, flags are reset."""
    out = candidates.withColumn("author", F.lit(actor)).withColumn("role", F.lit(role)).withColumn("status", F.lit("inbox"))
    if role == "member":
        out = out.withColumn("trust_level", F.lit("untrusted"))
    return out.withColumn("tenant_id", F.lit(tenants[0])) if len(tenants) == 1 else out


def origin_token(key: bytes) -> Column:
    """The token of a row's id, tenant and time of capture."""
    return hashing.hmac_sha256(key, F.concat_ws("\u0000", F.col("id").cast("string"), "tenant_id", "captured_at"))


def origin_verdict(key: bytes | None) -> Column:
    """unattested without a token; unverifiable without a key; invalid or
    attested by the token of the row's own id, tenant and time."""
    good = origin_token(key) == F.col("token_hmac") if key else F.lit(False)
    return F.when(F.col("token_hmac").isNull(), "unattested").when(F.lit(not key), "origin_token_unverifiable").when(~good, "origin_token_invalid").otherwise("attested")


def excluded(path: Column, rules: list[str] = ignore.DEFAULTS) -> Column:  # noqa: B006
    """Why an import is left out: its path, or what its content looks like;
    null for other sources and for what may come in."""
    why = F.coalesce(F.when(ignore.ignored(path, rules), "path"), heuristics.noise(F.col("content"), F.col("title")))
    return F.when(F.col("source").isin(IMPORTS), why)


def free_promotion(batch: DataFrame) -> DataFrame:
    """Adds ``result`` to rows with ``outcome`` and ``duplicate``: a row whose
    content an earlier row of the batch was promoted with is a duplicate too."""
    free = batch.where(~F.col("duplicate") & (F.col("outcome") == "approved"))
    first = free.groupBy("tenant_id", "content_hash").agg(F.min("id").alias("__first"))
    again = F.col("__first").isNotNull() & (F.col("__first") < F.col("id"))
    joined = batch.join(first, ["tenant_id", "content_hash"], "left")
    result = F.when(F.col("duplicate") | again, "duplicate").when(F.col("outcome") == "approved", "promoted").otherwise(F.col("outcome"))
    return joined.withColumn("result", result).drop("__first")


def _judged(batch: DataFrame, memories: DataFrame, rules: list | None) -> DataFrame:
    """Adds ``duplicate`` (of a stored row) and what the policy says (none
    enabled: approved)."""
    checked = similarity.exact_duplicates(batch, memories)
    return policy.evaluate(checked, rules) if rules is not None else checked.withColumn("outcome", F.lit("approved"))


def processed(batch: DataFrame, memories: DataFrame, rules: list | None) -> DataFrame:
    """Adds ``result`` (duplicate, promoted, rejected or flagged): duplicates
    of stored rows first, then the policy (none enabled: promote), then
    repeats of a row that the same batch promotes."""
    return free_promotion(_judged(batch, memories, rules))


def processed_alone(rows: DataFrame, memories: DataFrame, rules: list | None) -> DataFrame:
    """As ``processed``, with each row a batch of its own: rows are held
    against stored ones and the policy, never against each other."""
    result = F.when(F.col("duplicate"), "duplicate").when(F.col("outcome") == "approved", "promoted").otherwise(F.col("outcome"))
    return _judged(rows, memories, rules).withColumn("result", result)


def intake(data: DataFrame, candidates: DataFrame, channels: list[str]) -> DataFrame:
    """id and outcome of rows that come by a channel: invalid (no title or
    content), channel, disclosure, already_exists (its id, or its content in
    its tenant), or created; the first that applies."""
    scanned = data.withColumn("__found", disclosure.category(disclosure.canonical(F.concat_ws("\n", "title", "content"))))
    by_id = candidates.select("id").distinct().withColumn("__id", F.lit(True))
    by_hash = candidates.select("tenant_id", "content_hash").distinct().withColumn("__hash", F.lit(True))
    joined = scanned.join(by_id, "id", "left").join(by_hash, ["tenant_id", "content_hash"], "left")
    empty = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    outcome = F.when(empty("title") | empty("content"), "invalid").when(~F.col("source").isin(channels), "channel").when(F.col("__found").isNotNull(), "disclosure").when(F.col("__id") | F.col("__hash"), "already_exists").otherwise("created")
    return joined.select("id", outcome.alias("outcome"))


def ingested(spark, folder: str, sidecars: DataFrame, known: DataFrame) -> DataFrame:
    """id and outcome of the candidates in a spool: tampered (their file's
    manifest, path and sha256, has another hash), known (id), rejected (they
    disclose something) or ingested. A file without a manifest is taken."""
    bodies = files.contents(spark, folder, "spool-*.jsonl").select(F.col("name").alias("path"), "content")
    states = anchors.verified_files(bodies, sidecars).select(F.col("path").alias("file"), "state")
    rows = jsonl.spool(spark, folder).join(F.broadcast(states), "file").join(known.select("id").distinct().withColumn("__known", F.lit(True)), "id", "left")
    rows = rows.withColumn("__found", disclosure.category(disclosure.canonical(F.concat_ws("\n", "title", "content"))))
    outcome = F.when(F.col("state").isin("tampered", "error"), "tampered").when(F.col("__known"), "known").when(F.col("__found").isNotNull(), "rejected").otherwise("ingested")
    return rows.select("id", outcome.alias("outcome"))


def promotion_outcomes(asked: DataFrame, memories: DataFrame, rules: list) -> DataFrame:
    """id and outcome of requests to promote, each by itself: not_inbox,
    disclosure, duplicate, what the policy says, or promoted."""
    judged = policy.evaluate(similarity.exact_duplicates(asked, memories), rules)
    judged = judged.withColumn("__found", disclosure.category(disclosure.canonical(F.col("content"))))
    outcome = F.when(F.col("status") != "inbox", "not_inbox").when(F.col("__found").isNotNull(), "disclosure").when(F.col("duplicate"), "duplicate").when(F.col("outcome") == "approved", "promoted").otherwise(F.col("outcome"))
    return judged.select("id", outcome.alias("outcome"))


def receipts(rows: DataFrame, action: Column, namespace: str, memory: str = "id") -> DataFrame:
    """An audit event for every row: an id derived from action and record, the
    action, record and tenant."""
    made = rows.withColumn("__action", action)
    return made.select(hashing.derived_id(namespace, F.col("__action"), F.col(memory)).alias("event_id"), F.col("__action").alias("action"), F.col(memory).cast("string").alias("memory_id"), "tenant_id")


def promoted(rows: DataFrame, memories: DataFrame, namespace: str, now: str) -> dict[str, DataFrame]:
    """What promoting ``rows`` writes: ``memories`` (derived ids, sensitivity
    by content), ``superseded`` (ids that a better title takes the place of),
    ``links`` (supersedes, by similarity, and relates_to by wiki links whose
    slug is a title in the same tenant) and ``events``."""
    new_id = hashing.derived_id(namespace, F.col("tenant_id"), F.col("id"), F.col("content_hash"))
    made = rows.select(new_id.alias("id"), F.col("id").alias("candidate_id"), "tenant_id", "title", "content", "category", "content_hash", T.sensitivity(F.col("content")).alias("sensitivity"), F.lit("active").alias("lifecycle"), F.lit(now).cast("timestamp").alias("updated_at"))
    ids = made.select("id", "candidate_id", "tenant_id")
    best = similarity.supersessions(rows, memories).join(ids, F.col("left_id") == F.col("candidate_id"))
    supersedes = best.select(F.col("id").alias("source_id"), F.col("right_id").cast("string").alias("target_id"), F.lit("supersedes").alias("link_type"), F.col("similarity").alias("weight"))
    slugs = made.select("id", "tenant_id", F.explode(F.array_distinct(T.wiki_links(F.col("content")))).alias("slug")).withColumn("slug", F.lower("slug"))
    named = memories.select(F.col("id").alias("target"), "tenant_id", F.lower("title").alias("slug"))
    relates = slugs.join(named, ["tenant_id", "slug"]).select(F.col("id").alias("source_id"), F.col("target").cast("string").alias("target_id"), F.lit("relates_to").alias("link_type"), F.lit(1.0).alias("weight")).distinct()
    gone = best.select(F.col("right_id").alias("id"), "tenant_id").distinct()
    events = receipts(made, F.lit("promoted"), namespace).unionAll(receipts(gone, F.lit("superseded"), namespace))
    return {"memories": made, "superseded": gone, "links": supersedes.unionAll(relates), "events": events}


def rejected(judged: DataFrame, namespace: str) -> DataFrame:
    """Audit rows of what was rejected or flagged: the action is ``deleted``."""
    return receipts(judged.where(F.col("result").isin("rejected", "flagged")), F.lit("deleted"), namespace)


#: The audit action of a change to each lifecycle.
ACTION_OF = {"active": "promoted", "deprecated": "demoted", "superseded": "superseded", "archived": "archived"}


def transitioned(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """id, outcome and action of requests (id, target, superseded_by): missing,
    needs_successor, unchanged, illegal or allowed, with the event's action."""
    known = memories.select("id", "lifecycle").withColumn("__known", F.lit(True))
    joined = records.with_transition(requests.join(known, "id", "left"), F.col("target"))
    outcome = F.when(F.col("__known").isNull(), "missing").when((F.col("target") == "superseded") & F.col("superseded_by").isNull(), "needs_successor").otherwise(F.col("outcome"))
    actions = F.create_map(*[F.lit(x) for item in ACTION_OF.items() for x in item])
    return joined.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "allowed", F.try_element_at(actions, F.col("target"))).alias("action"))


def recategorized(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """id, category and outcome (missing, unknown, same or recategorized) of
    requests (id, wanted); the category is what the record then has."""
    joined = requests.join(memories.select("id", "category").withColumn("__known", F.lit(True)), "id", "left")
    outcome = F.when(F.col("__known").isNull(), "missing").when(~F.col("wanted").isin(D.CATEGORIES), "unknown").when(F.col("wanted") == F.col("category"), "same").otherwise("recategorized")
    return joined.withColumn("outcome", outcome).select("id", F.when(F.col("outcome") == "recategorized", F.col("wanted")).otherwise(F.col("category")).alias("category"), "outcome")


def vault_preview(notes: DataFrame, memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """id and outcome of notes (id, content): skipped_empty, or a collision
    with the same content earlier in the vault (batch), among memories
    (curated) or candidates (candidate), else created. Tenants don't matter."""
    hashed = notes.withColumn("content_hash", hashing.content_hash(F.col("content"))).withColumn("__blank", ~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)))
    first = hashed.where("not __blank").groupBy("content_hash").agg(F.min("id").alias("__first"))
    one = memories.select("content_hash").distinct().withColumn("__curated", F.lit(True))
    two = candidates.select("content_hash").distinct().withColumn("__candidate", F.lit(True))
    joined = hashed.join(first, "content_hash", "left").join(one, "content_hash", "left").join(two, "content_hash", "left")
    outcome = F.when(F.col("__blank"), "skipped_empty").when(F.col("__first") < F.col("id"), "batch").when(F.col("__curated"), "curated").when(F.col("__candidate"), "candidate").otherwise("created")
    return joined.select("id", outcome.alias("outcome"))


def rolled_back(candidates: DataFrame, links: DataFrame, batches: DataFrame, batch: str) -> dict[str, DataFrame]:
    """Candidates, links and batches without what one batch brought; a batch
    that is rolled back already is an error."""
    state = F.when((F.col("id") == batch) & (F.col("status") == "rolled_back"), F.raise_error(F.lit(f"batch {batch} is rolled back already")).cast("string")).when(F.col("id") == batch, "rolled_back").otherwise(F.col("status"))
    keep = F.coalesce(F.col("batch_id") != batch, F.lit(True))
    return {"candidates": candidates.where(keep), "links": links.where(keep), "batches": batches.withColumn("status", state)}


def union_of_clones(clones: list[DataFrame], key: str = "id") -> DataFrame:
    """Every id once, from the first clone that has it; adds ``side``."""
    if not clones:
        raise ValueError("no clone to merge")
    rows = clones[0].withColumn("side", F.lit(0))
    for k, clone in enumerate(clones[1:], 1):
        rows = rows.unionByName(clone.withColumn("side", F.lit(k)))
    least = rows.groupBy(key).agg(F.min("side").alias("side"))
    return rows.join(least, [key, "side"], "left_semi")


def merged(clones: list[DataFrame], namespace: str) -> DataFrame:
    """The rows of all clones, each id once, with ``outcome``: bad_id (the id
    isn't that of its tenant, origin and content), secret, pii or compensation
    (what it discloses), duplicate (of a smaller id's content, in any tenant)
    or promoted. All rows are untrusted; ``clocked`` dates the promoted ones."""
    rows = union_of_clones(clones).withColumn("trust_level", F.lit("untrusted"))
    right = F.col("id") == hashing.derived_id(namespace, F.col("tenant_id"), F.col("origin_id"), hashing.content_hash(F.col("content")))
    rows = rows.withColumn("__found", disclosure.category(disclosure.canonical(F.concat_ws("\n", "title", "content")))).withColumn("__right", right)
    clean = F.col("__right") & F.col("__found").isNull()
    first = rows.where(clean).groupBy("content_hash").agg(F.min("id").alias("__first"))
    joined = rows.join(first, "content_hash", "left")
    outcome = F.when(~F.col("__right"), "bad_id").when(F.col("__found").isNotNull(), F.col("__found")).when(F.col("__first") < F.col("id"), "duplicate").otherwise("promoted")
    return joined.withColumn("outcome", outcome).drop("__found", "__right", "__first")


def clocked(rows: DataFrame, epoch: str) -> DataFrame:
    """Adds ``at``: ``epoch`` and a millisecond for each row before, by id (a
    UUID, whose first digits deal the rows into ranges)."""
    placed = audit.with_position(rows, "id", bucket=F.substring("id", 1, 3))
    return placed.withColumn("at", F.timestamp_millis(F.unix_millis(F.lit(epoch).cast("timestamp")) + F.col("position") - 1)).drop("position")


def staleness(memories: DataFrame, rules: list[tuple[str, list[str], bool]]) -> DataFrame:
    """id, rule and matched tokens of the facts that rules (name, tokens,
    whether a record of the past is exempt) say are dead."""
    text = F.concat_ws("\n", "title", "content")
    found = []
    for name, tokens, exempt in rules:
        hits = F.filter(F.array(*[F.when(T.mentions(text, t), F.lit(t)) for t in tokens]), lambda x: x.isNotNull())
        found.append(F.struct(F.lit(name).alias("rule"), hits.alias("matched"), F.lit(exempt).alias("exempt")))
    rows = memories.select("id", heuristics.historical(text).alias("past"), F.explode(F.array(*found)).alias("f")).select("id", "past", "f.*")
    return rows.where((F.size("matched") > 0) & ~(F.col("past") & F.col("exempt"))).select("id", "rule", "matched")
