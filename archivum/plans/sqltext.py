"""Pieces of the SQL that the registered queries are compared with."""

from __future__ import annotations

import hashlib

from archivum.functions import disclosure, heuristics
from archivum.functions import text as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(column: str, *patterns: str) -> str:
    return f"regexp_matches({column}, {lit('|'.join(f'(?:{p})' for p in patterns))})"


FREE = [p for n, p in T.SECRETS.items() if n not in T.CONTEXT]


def has_secret(c: str) -> str:
    joined, tight = f"regexp_replace({c}, '\\r?\\n', '', 'g')", f"regexp_replace({c}, '\\s+', '', 'g')"
    own, about = T.SECRETS["heroku-api-key"], T.CONTEXT["heroku-api-key"]
    return f"({matches(c, *FREE)} OR {matches(joined, *FREE)} OR {matches(tight, *[T.SECRETS[n] for n in T.UNBROKEN])} OR ({matches(c, about)} AND ({matches(c, own)} OR {matches(joined, own)})))"


def sensitivity(c: str) -> str:
    return f"CASE WHEN {has_secret(c)} THEN 'restricted' WHEN {matches(c, *T.PII.values())} THEN 'confidential' WHEN {matches(c, *T.PLACES.values())} THEN 'internal' ELSE 'public' END"


def disclosed(c: str) -> str:
    pay = f"{matches(c, disclosure.PAY)} OR ({matches(c, disclosure.SHARES)} AND {matches(c, disclosure.PAY_CONTEXT)})"
    return f"CASE WHEN {matches(c, *disclosure.CREDENTIALS)} THEN 'secret' WHEN {matches(c, disclosure.PERSONAL)} THEN 'pii' WHEN {pay} THEN 'compensation' END"


def redacted(c: str) -> str:
    for name, pattern in T.SECRETS.items():
        clean = f"regexp_replace({c}, {lit(pattern)}, '[REDACTED:{name}]', 'g')"
        c = f"CASE WHEN {matches(c, T.CONTEXT[name])} THEN {clean} ELSE {c} END" if name in T.CONTEXT else clean
    return c


def historical(c: str) -> str:
    return matches(f"lower({c})", *heuristics.HISTORICAL)


def uuid5(namespace: str, name: str) -> str:
    """Of a string expression."""
    seed = namespace.replace("-", "")
    h = f"sha1(from_hex('{seed}') || encode({name}))"
    variant = f"['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1]"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def hmac(key: bytes, message: str) -> str:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


#: Words of a text by blanks, each once.
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
RELEVANCE = (
    "round(CASE WHEN trim(title) <> '' THEN 0.2 ELSE 0 END + CASE WHEN length(content) > 200 THEN 0.2 WHEN length(content) > 50 THEN 0.1 ELSE 0 END + 0.05"
    " + CASE WHEN trust_level = 'high' THEN 0.05 ELSE 0 END + CASE WHEN len(" + WORDS.format("content") + ") > 15 THEN 0.1 ELSE 0 END"
    " + CASE WHEN source IN ('manual', 'import') THEN 0.1 ELSE 0 END, 3)"
)
SANITIZED = matches("content", *T.SANITIZATION.values())
#: After WITH: every record with what the recommended policy says of it.
JUDGED = f""", rules AS (SELECT *, {has_secret('content')} AS r_secret, length(content) < 25 OR length(content) > 50000 AS r_length,
    trust_level = 'untrusted' AS f_trust, {RELEVANCE} < 0.3 AS f_relevance, sensitivity IN ('restricted', 'confidential') AS f_gate, {SANITIZED} AS f_places FROM memories),
  judged AS (SELECT *, CASE WHEN r_secret OR r_length THEN '' ELSE concat_ws(',', CASE WHEN f_trust THEN 'source_trust' END, CASE WHEN f_relevance THEN 'relevance_score' END, CASE WHEN f_gate THEN 'sensitivity_gate' END, CASE WHEN f_places THEN 'content_sanitization' END) END AS flagged_by,
    CASE WHEN r_secret THEN 'secret_detection' WHEN r_length THEN 'content_length' END AS rejected_by,
    CASE WHEN r_secret OR r_length THEN 'rejected' WHEN f_trust OR f_relevance OR f_gate OR f_places THEN 'flagged' ELSE 'approved' END AS outcome FROM rules)
"""
#: After JUDGED: odd records as a batch against even ones as those stored.
BATCH = """, dup AS (SELECT j.*, j.content_hash IN (SELECT content_hash FROM memories m WHERE m.id % 2 = 0 AND m.tenant_id = j.tenant_id) AS duplicate FROM judged j WHERE id % 2 = 1),
  batch AS (SELECT *, CASE WHEN duplicate OR coalesce(id > min(CASE WHEN NOT duplicate AND outcome = 'approved' THEN id END) OVER (PARTITION BY tenant_id, content_hash), false) THEN 'duplicate' WHEN outcome = 'approved' THEN 'promoted' ELSE outcome END AS result FROM dup)
"""


def titles(table: str = "memories") -> str:
    """After WITH: words of titles, and the best match of each odd record."""
    return f""", t AS (SELECT id, tenant_id, category, lifecycle, {WORDS.format('title')} AS w FROM {table}),
    pairs AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity
      FROM t a JOIN t b ON a.tenant_id = b.tenant_id AND a.category = b.category AND a.id % 2 = 1 AND b.id <> a.id AND b.lifecycle = 'active' AND len(a.w) > 0 AND len(b.w) > 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS n FROM pairs WHERE similarity >= 0.6) WHERE n = 1)
"""


def bm25(table: str = "memories", column: str = "content") -> str:
    """After WITH: hits (id, score) of the records that have both words of the
    fixed query, ``the`` and ``and``."""
    return f""", w AS (SELECT id, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
    tf AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'and')) AS b FROM w),
    st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf),
    hits AS (SELECT id, greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)) AS score
      FROM tf, st WHERE a > 0 AND b > 0)
    """


BOOST = "CASE category WHEN 'decision' THEN 1.2 WHEN 'architecture' THEN 1.15 WHEN 'convention' THEN 1.1 WHEN 'pattern' THEN 1.1 WHEN 'troubleshooting' THEN 1.0 WHEN 'onboarding' THEN 0.95 WHEN 'reference' THEN 0.9 ELSE 1.0 END"
FINAL = f"floor(score * exp(-ln(2) / 90 * (date_diff('millisecond', updated_at, TIMESTAMP '2026-01-01 00:00:00') / 86400000.0)) * {BOOST} * 1000 + 0.5) / 1000"
