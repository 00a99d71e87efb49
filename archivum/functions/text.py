"""Text measures and classifications, all from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of categories in ranking.
CATEGORY_BOOST = {"decision": 1.2, "architecture": 1.15, "convention": 1.1, "pattern": 1.1, "troubleshooting": 1.0, "onboarding": 0.95, "reference": 0.9}
#: Patterns of internal places in a text, in report order.
SANITIZATION = {
    "home-path": r"(/home/|/Users/)[A-Za-z0-9_-]+",
    "windows-drive": r"[A-Za-z]:\\[A-Za-z0-9_\\-]+",
    "internal-hostname": r"[a-zA-Z0-9-]+\.internal\b",
    "local-hostname": r"[a-zA-Z0-9-]+\.local\b",
    "rfc1918-ip": r"\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b",
}
#: Places in a file system that make a text internal.
PLACES = {"home": r"/home/[a-zA-Z0-9_.-]+/", "users": r"/Users/[a-zA-Z0-9_.-]+/", "drive": r"[A-Z]:\\"}
#: Personal data, in report order.
PII = {
    "email-address": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "us-phone": r"(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "ssn-like": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ssn-keyword": r"(?i:\bSSN\b|social security (?:number|no))",
    "date-of-birth": r"(?i:date of birth|\bDOB\b\s*[:=])",
    "background-check": r"(?i:background[- ]check (?:result|report|passed|failed))",
}
#: Credentials, in report order.
SECRETS = {
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "aws-key": r"AKIA[0-9A-Z]{16}",
    "github-token": r"gh[pousr]_[A-Za-z0-9_]{36,}",
    "generic-api-key": r"sk-[A-Za-z0-9]{20,}",
    "slack-token": r"xox[bpras]-[0-9A-Za-z-]{10,}",
    "pem-key": r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----",
    "connection-string": r"(?:mongodb|postgres|mysql|redis|amqp)://[^:]+:[^@]+@",
    "base64-auth": r"Basic\s+[A-Za-z0-9+/]{20,}={0,2}",
    "gcp-service-account": r'"type"\s*:\s*"service_account"',
    "high-entropy-hex": r"[a-f0-9]{40,}",
    "env-secret": r"""(?i:(?:SECRET|PASSWORD|TOKEN|API_KEY|PRIVATE_KEY)\s*=\s*["']?[^\s"']{8,})""",
    "azure-connection-string": r"AccountKey=[A-Za-z0-9+/=]{20,}",
    "heroku-api-key": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "mysql-connection-string": r"mysql://[^:]+:[^@]+@[^\s]+",
    "postgres-connection-string": r"postgres(?:ql)?://[^:]+:[^@]+@[^\s]+",
}
#: Fixed value: what a text must also have for a pattern to count.
CONTEXT = {"heroku-api-key": r"(?i:(?:^|[^a-z0-9])(?:heroku|api[-_ ]?key|api|key|token|secret|credential|bearer)(?:[^a-z0-9]|$)|[A-Za-z][A-Za-z0-9_]*\s*[:=])"}
#: Patterns without blanks or prose in them, looked for with all blanks removed.
UNBROKEN = ["jwt", "aws-key", "github-token", "generic-api-key", "slack-token", "high-entropy-hex", "azure-connection-string"]
#: Runs that may be base64 of something.
ENCODED = r"[A-Za-z0-9+/]{24,}={0,2}"
#: One CJK character, or a run of letters and digits.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{N}]+"


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def title_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def content_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def jaccard(one: Column, two: Column, both_empty: float) -> Column:
    """Of two arrays without repeats; ``both_empty`` is what two empty ones have."""
    common = F.size(F.array_intersect(one, two))
    union = F.size(one) + F.size(two) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def matched(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that occur in a text, in their order."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()])
    return F.filter(hits, lambda x: x.isNotNull())


def redact(text: Column, patterns: dict[str, str] = SECRETS) -> Column:
    """Each pattern replaced in turn by ``[REDACTED:name]``; a pattern's
    context is looked for in what the ones before have left."""
    for name, pattern in patterns.items():
        clean = F.regexp_replace(text, pattern, f"[REDACTED:{name}]")
        text = F.when(text.rlike(CONTEXT[name]), clean).otherwise(text) if name in CONTEXT else clean
    return text


def _any(names) -> str:
    return "|".join(f"(?:{SECRETS[n]})" for n in names)


def unbroken_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r?\n", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def decoded(text: Column) -> Column:
    """What the base64 runs of a text stand for, a line each; runs that aren't
    base64 of text give what is valid of them."""
    runs = F.regexp_extract_all(text, F.lit(ENCODED), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.make_valid_utf8(F.try_to_binary(x, F.lit("base64")).cast("string"))), "\n")


def secret_ids(text: Column) -> Column:
    """Names of the credentials that occur in a text: as it stands, with lines
    joined, with blanks removed (patterns that have none), or base64-encoded,
    which is reported as ``base64-wrapped:name``."""
    hits = []
    for name, pattern in SECRETS.items():
        found = text.rlike(pattern) | unbroken_lines(text).rlike(pattern)
        if name in UNBROKEN:
            found = found | without_blanks(text).rlike(pattern)
        hits.append(F.when(found & text.rlike(CONTEXT[name]) if name in CONTEXT else found, F.lit(name)))
    inner = decoded(text)
    wrapped = [F.when(inner.rlike(p), F.lit(f"base64-wrapped:{n}")) for n, p in SECRETS.items() if n not in CONTEXT]
    return F.filter(F.array(*hits, *wrapped), lambda x: x.isNotNull())


def has_secret(text: Column) -> Column:
    """Whether ``secret_ids`` would find any, by one expression a view."""
    free, bound = _any(n for n in SECRETS if n not in CONTEXT), [n for n in SECRETS if n in CONTEXT]
    found = text.rlike(free) | unbroken_lines(text).rlike(free) | without_blanks(text).rlike(_any(UNBROKEN)) | decoded(text).rlike(free)
    for name in bound:
        found = found | (text.rlike(CONTEXT[name]) & (text.rlike(SECRETS[name]) | unbroken_lines(text).rlike(SECRETS[name])))
    return found


def sensitivity(text: Column) -> Column:
    """restricted for secrets, confidential for personal data, internal for
    places in a file system, else public: the highest that applies."""
    any_of = lambda p: text.rlike("|".join(f"(?:{x})" for x in p.values()))
    return F.when(has_secret(text), "restricted").when(any_of(PII), "confidential").when(any_of(PLACES), "internal").otherwise("public")


def entropy(text: Column) -> Column:
    """Shannon bits a character: counts by code point over the UTF-16 length.
    Characters are sorted and their runs counted, in one pass."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = utf16_length(text)
    bits = lambda k: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        same = s["last"] == c
        return F.struct(c.alias("last"), F.when(same, s["run"] + 1).otherwise(1).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + bits(s["run"])).alias("sum"))

    return F.coalesce(F.aggregate(chars, start, step, lambda s: s["sum"] + bits(s["run"])), F.lit(0.0))


def freshness(updated_at: Column, now: Column, half_life_days: float = 90.0) -> Column:
    """exp(-ln 2 / half-life * age in days), 1 for times to come."""
    import math

    age = F.greatest((F.unix_millis(now) - F.unix_millis(updated_at)) / 86_400_000.0, F.lit(0.0))
    return F.exp(F.lit(-math.log(2) / half_life_days) * age)


def category_boost(category: Column) -> Column:
    pairs = [F.lit(x) for item in CATEGORY_BOOST.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(1.0))


def round3(x: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def citation_id(citation: Column) -> Column:
    """The last path segment without its last extension; null if empty."""
    base = F.regexp_replace(F.regexp_extract(citation, r"([^/]*)$", 1), r"\.[^.]+$", "")
    return F.when(base != "", base)


def citation_title(citation: Column) -> Column:
    title = F.trim(F.regexp_replace(F.coalesce(citation_id(citation), F.lit("")), "[-_]+", " "))
    return F.when(title != "", title).otherwise(citation)


def normalized_url(url: Column) -> Column:
    """Without scheme, user and ``.git``; ``host:path`` as ``host/path``; lower case."""
    x = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^[^@/]+@", ""), r"^([^/:]+):([^/0-9])", "$1/$2")
    return F.lower(F.regexp_replace(F.regexp_replace(x, "/+$", ""), r"\.git$", ""))


def directory(lifecycle: Column, source: Column, category: Column) -> Column:
    """Where a memory is exported to; null for an unknown category."""
    own = F.when(category == "decision", "decisions").when(category.isin("pattern", "convention", "architecture"), "curated").when(category.isin("troubleshooting", "reference", "onboarding"), "guides")
    return F.when(lifecycle.isin("archived", "superseded"), "archive").when(source == "bulk_import", "bulk").otherwise(own)


def wiki_links(text: Column) -> Column:
    """Slugs of ``[[slug]]`` and ``[[slug|text]]`` outside code."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]|\n]+)(\|[^\]\n]*)?\]\]"), F.lit(1)), lambda s: F.trim(s))


def mentions(text: Column, token: str) -> Column:
    """Whether a token occurs, in any case, not next to a letter or digit."""
    import re

    return text.rlike(f"(?i)(?<![a-z0-9]){re.escape(token)}(?![a-z0-9])")


LINK_OR_CODE = r"(?s)```.*?```|`[^`\n]*`|\[\[[^\]|\n]+(?:\|[^\]\n]*)?\]\]"


SLUG, LABEL = r"^\[\[([^\]|\n]+)", r"^\[\[[^\]|\n]+\|([^\]\n]*)\]\]$"


def _with_tokens(df: DataFrame, text: str) -> DataFrame:
    """Adds the links and code of a text, and what lies between them. They are
    columns, so that a text is searched once and not for each link."""
    parts, found = F.split(F.col(text), LINK_OR_CODE, -1), F.regexp_extract_all(F.col(text), F.lit(LINK_OR_CODE), F.lit(0))
    return df.withColumn("__parts", parts).withColumn("__found", found)


def with_rewritten_links(df: DataFrame, text: str, out: str, target) -> DataFrame:
    """Adds ``text`` with every wiki link outside code as ``target(slug,
    label)`` says, the rest as it is; the label is the slug where none is
    given."""

    def piece(part: Column, i: Column) -> Column:
        token = F.coalesce(F.get("__found", i), F.lit(""))
        slug, label = F.trim(F.regexp_extract(token, SLUG, 1)), F.regexp_extract(token, LABEL, 1)
        return F.concat(part, F.when(token.startswith("[["), target(slug, F.when(label == "", slug).otherwise(label))).otherwise(token))

    return _with_tokens(df, text).withColumn(out, F.array_join(F.transform("__parts", piece), "")).drop("__parts", "__found")


def with_link_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds (slug, start, end) of the wiki links outside code, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<slug:string,start:int,end:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        token = F.get("__found", i)
        begin = s["at"] + F.length(F.get("__parts", i))
        end = begin + F.length(token)
        here = F.array(F.struct(F.trim(F.regexp_extract(token, SLUG, 1)).alias("slug"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(token.startswith("[["), F.concat(s["out"], here)).otherwise(s["out"]).alias("out"))

    places = F.when(F.size("__found") > 0, F.sequence(F.lit(0), F.size("__found") - 1)).otherwise(F.array().cast("array<int>"))
    return _with_tokens(df, text).withColumn(out, F.aggregate(places, start, step, lambda s: s["out"])).drop("__parts", "__found")


def query_terms(query: str) -> list[str]:
    """The runs of letters and digits of a query, all of which are required."""
    import re

    return re.findall(r"[^\W_]+", query)


def plain_query(query: Column) -> Column:
    """A query without the marks that full-text syntax gives a meaning."""
    return F.regexp_replace(query, r'[*"^(){}:]', "")


def like_escaped(text: Column) -> Column:
    """``%``, ``_`` and the backslash with a backslash before them."""
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def to_fixed(x: Column, digits: int = 4) -> Column:
    return F.round(x, digits)


def is_version(text: Column) -> Column:
    """Three dotted numbers without leading zeros, then pre-release and build."""
    return text.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$")


def is_tag(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9][a-z0-9-]*$")


def cosine_of_distance(distance: Column) -> Column:
    """Of unit vectors at an Euclidean distance."""
    return 1 - distance * distance / 2
