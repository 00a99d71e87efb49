"""Secret scans: patterns, and character Markov models, in DataFrame functions.

Patterns give the base spans. For other long runs of key-like characters two
first-order Markov models are compared: one of random strings, trained from
the values that the patterns label, and one of ordinary identifiers, trained
from words and from identifiers that neighbouring words make (camel case,
snake case, kebab case, paths). Both fall back on classes of characters where
a pair is rare. How large the log-likelihood ratio of a character must be is
set on values and identifiers that were held out.

Texts are read once: spans, labelled values and candidate runs go to a narrow
stored table, and the models and the final spans are made from that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import discard, stored

#: The patterns, in the order in which kinds are listed.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge: so many key-like characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORDS = r"[A-Za-z]{2,}"
#: Characters that keys are made of, by class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-.")
ALPHABET = sum(map(len, CLASSES))
#: The models are fitted on at most so many labelled values, and on the words of
#: at most so many documents (those with the smallest hashes). One in HELD_OUT
#: of either is kept for setting the threshold.
SAMPLE_VALUES, SAMPLE_DOCUMENTS, HELD_OUT = 20_000, 1_000, 4
#: Words of a made identifier.
IDENTIFIER_WORDS = 5
#: The least log-likelihood ratio (natural) of a whole run, and the bounds of
#: the least one for a character.
LEAST_RATIO, LOWEST_MEAN, HIGHEST_MEAN = 12.0, 0.3, 0.8
#: The threshold lies between what these shares of held-out identifiers stay
#: under and of labelled values reach, so far from the former.
ORDINARY_BELOW, RANDOM_ABOVE, NEARNESS = 0.999, 0.95, 0.25
#: Weights of the pairs themselves against classes of characters, and of the
#: uniform part of the random model.
PAIRS, UNIFORM = 0.75, 0.5
#: Matches whose places are added up at a time.
BLOCK = 256
SPAN = "struct<start:int,end:int,value:string>"


def with_matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds ``out``: the pattern's non-overlapping matches, leftmost first, as
    structs of start, end (code points) and value. Positions follow from the
    texts between matches."""
    df = df.withColumn("__m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(F.col(text), pattern, -1)))
    # Places are sums of lengths before, taken by blocks, so that a text with
    # very many matches doesn't copy a growing array at each.
    df = df.withColumn("__l", F.expr("transform(__m, (m, i) -> length(__g[i]) + length(m))"))
    df = df.withColumn("__b", F.expr(f"transform(sequence(0, greatest(size(__m) - 1, 0) div {BLOCK}), b -> aggregate(slice(__l, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0, (t, x) -> t + x))"))
    df = df.withColumn("__o", F.expr("aggregate(__b, named_struct('at', 0, 'all', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at))), s -> s.all)"))
    placed = F.expr(
        f"""case when size(__m) > 0 then flatten(transform(__o, (o, b) -> aggregate(
          sequence(cast(b * {BLOCK} as int), cast(least(b * {BLOCK} + {BLOCK - 1}, size(__m) - 1) as int)),
          named_struct('pos', o, 'spans', cast(array() as array<{SPAN}>)),
          (s, i) -> named_struct(
            'pos', s.pos + __l[i],
            'spans', concat(s.spans, array(named_struct('start', s.pos + length(__g[i]), 'end', s.pos + __l[i], 'value', __m[i])))),
          s -> s.spans)))
        else cast(array() as array<{SPAN}>) end"""
    )
    return df.withColumn(out, placed).drop("__m", "__g", "__l", "__b", "__o")


def _as_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, h (hash of the text), base (kind, start, end), labelled (values
    taken for random strings), candidates (start, end, value) and row (all of
    the row's own columns, for those who ask)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    rows = with_matches(rows, "text", ASSIGN, "assign")
    values = F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("values", values)
    rows = rows.withColumn("assign", F.expr(f"filter(transform(assign, (s, i) -> named_struct('start', s.start, 'end', s.end, 'value', values[i])), s -> length(s.value) >= {ASSIGN_CHARS})"))
    rows = with_matches(rows, "text", ACCESS, "access")
    rows = with_matches(rows, "text", HEX, "hex")
    rows = with_matches(rows, "text", CANDIDATE, "candidates")
    kinds = [_as_kind(F.col(kind), k) for k, kind in enumerate(KINDS[:3])]
    labelled = F.expr("concat(transform(access, s -> s.value), transform(hex, s -> s.value), filter(transform(assign, s -> s.value), v -> v rlike '[0-9]' and v rlike '[A-Za-z]'))")
    return rows.select("key", F.xxhash64("text").alias("h"), F.array_sort(F.concat(*kinds)).alias("base"), labelled.alias("labelled"), "candidates", "row")


def _pairs(strings: DataFrame) -> DataFrame:
    """How often each character code follows another in the column ``value``."""
    at = strings.where("length(value) > 1").select("value", F.explode(F.expr("sequence(1, length(value) - 1)")).alias("i"))
    return at.groupBy(F.expr("ascii(substr(value, i, 1))").alias("a"), F.expr("ascii(substr(value, i + 1, 1))").alias("b")).count().where("a < 128 and b < 128")


def probabilities(counts: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """P(b | a) of every pair of key-like characters (codes): the pairs' own
    shares, mixed with those of their classes spread evenly within a class."""
    kind = {ord(c): k for k, own in enumerate(CLASSES) for c in own}
    of_char = dict.fromkeys(kind, 0.0)
    of_class = [[1.0] * len(CLASSES) for _ in CLASSES]
    for (a, b), n in counts.items():
        if a in kind and b in kind:
            of_char[a] += n
            of_class[kind[a]][kind[b]] += n
    out = {}
    for a in kind:
        row = of_class[kind[a]]
        own = PAIRS * of_char[a] / (of_char[a] + 10)
        for b in kind:
            spread = row[kind[b]] / sum(row) / len(CLASSES[kind[b]])
            out[a, b] = own * counts.get((a, b), 0) / max(1.0, of_char[a]) + (1 - own) * spread
    return out


def ordinary_strings(texts: DataFrame) -> DataFrame:
    """``value``: the words of the column ``text``, and identifiers that
    neighbouring words make: every IDENTIFIER_WORDS words one, in a style that
    their hash picks."""
    words = F.filter(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), lambda w: ~w.rlike(f"^({HEX}|{ACCESS})$"))
    words = stored(texts.select(words.alias("words")).where("size(words) > 0").withColumn("small", F.transform("words", lambda w: F.lower(w))), "words")
    n = IDENTIFIER_WORDS
    groups = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("small") - 1, F.lit(n)), lambda i: F.slice("small", i + 1, n))).alias("g"))
    camel = F.concat(F.get("g", F.lit(0)), F.array_join(F.transform(F.slice("g", 2, n), lambda w: F.initcap(w)), ""))
    styles = [camel, F.array_join("g", "_"), F.array_join("g", "-"), F.concat(F.lit("/"), F.array_join("g", "/")), F.upper(F.array_join("g", "_"))]
    picked = F.pmod(F.xxhash64("g"), F.lit(len(styles)))
    made = styles[-1]
    for k, style in enumerate(styles[:-1]):
        made = F.when(picked == k, style).otherwise(made)
    return words.select(F.explode("words").alias("value")).union(groups.select(made.alias("value")))


def fitted(found: DataFrame, docs: DataFrame, key: str, text: str) -> tuple[list[float], float]:
    """log P(b | a, random) - log P(b | a, ordinary) at 128 * a + b, and the
    least mean of them that marks a secret: above what held-out identifiers
    stay under, by NEARNESS of the way to what held-out values reach."""
    values = found.select(F.explode("labelled").alias("value")).withColumn("o", F.xxhash64("value")).orderBy("o", "value").limit(SAMPLE_VALUES).select("value")
    few = docs.select(F.col(key).alias("key"), F.xxhash64(key).alias("o")).where("key is not null").orderBy("o", "key").limit(SAMPLE_DOCUMENTS).select("key").distinct()
    sampled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key", "left_semi")
    plain = ordinary_strings(sampled.select("text").where("text is not null"))
    both = stored(values.withColumn("name", F.lit("random")).union(plain.withColumn("name", F.lit("ordinary"))).withColumn("held", F.pmod(F.xxhash64("value"), F.lit(HELD_OUT)) == 0), "strings")
    counts = {"random": {}, "ordinary": {}}
    for name, own in counts.items():
        for row in _pairs(both.where((F.col("name") == name) & ~F.col("held"))).collect():  # 128 x 128 at most
            own[row.a, row.b] = row["count"]
    p = {name: probabilities(own) for name, own in counts.items()}
    ratios = [0.0] * 128 * 128
    for (a, b), ordinary in p["ordinary"].items():
        ratios[128 * a + b] = math.log(UNIFORM / ALPHABET + (1 - UNIFORM) * p["random"][a, b]) - math.log(ordinary)
        if a == b or (chr(a) in CLASSES[-1] and chr(b) in CLASSES[-1]):  # fillers and rules speak against a key, if at all
            ratios[128 * a + b] = min(0.0, ratios[128 * a + b])
    long = both.where("held and length(value) >= 20").withColumn("ratios", constant(ratios))
    mean = F.expr(f"{ratio('value', 'ratios')} / (length(value) - 1)")
    reached = {r.name: (r.low, r.high) for r in long.groupBy("name").agg(F.percentile_approx(mean, 1 - RANDOM_ABOVE, 1000).alias("low"), F.percentile_approx(mean, ORDINARY_BELOW, 10_000).alias("high")).collect()}
    discard(both)
    below = reached.get("ordinary", (None, LOWEST_MEAN))[1]
    above = reached.get("random", (HIGHEST_MEAN, None))[0]
    return ratios, min(HIGHEST_MEAN, max(LOWEST_MEAN, below, below + NEARNESS * (above - below)))


def constant(numbers: list[float]) -> Column:
    """The numbers as a constant array, parsed once by the optimizer."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def ratio(value: str, ratios: Column) -> str:
    """SQL of the ratio of the string expression ``value``; the column
    ``ratios`` has what log_ratios gives."""
    return f"aggregate(sequence(1, length({value}) - 1), cast(0 as double), (t, i) -> t + {ratios}[128 * ascii(substr({value}, i, 1)) + ascii(substr({value}, i + 1, 1))])"


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h and spans: structs of start, kind (its place in KINDS) and end,
    by start, then kind.

    One row for each row of ``docs``. A null text counts as empty and has no
    spans; repeated rows have the same ones; other columns don't matter.
    Spans that the models add don't overlap base ones. Base spans of
    different kinds may overlap each other.
    """
    found = stored(scan(docs, key, text).drop("row"), "secrets")
    return with_spans(found, *fitted(found, docs, key, text)).select("key", "h", "spans")


def with_spans(found: DataFrame, ratios: list[float], least_mean: float) -> DataFrame:
    """Adds ``spans`` to what ``scan`` gives."""
    rows = found.withColumn("ratios", constant(ratios))
    judged = F.expr(
        f"""filter(candidates, c -> not exists(base, s -> s.start < c.end and c.start < s.end)
          and {ratio('c.value', 'ratios')} >= greatest({LEAST_RATIO}D, {least_mean}D * (length(c.value) - 1)))"""
    )
    return rows.withColumn("spans", F.array_sort(F.concat("base", _as_kind(judged, 3))))


def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by ``mark``; texts without
    any stay as they are, null too. Texts are scanned once, stored with their
    spans, and not shuffled."""
    found = stored(scan(docs, key, text), "secrets")
    rows = with_spans(found, *fitted(found, docs, key, text)).select("row", "spans")
    clean = redacted(F.col(f"row.`{text}`"), F.col("spans"), mark)
    return rows.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark`` once."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))).otherwise(s["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(F.array_join(step["out"], ""), F.substring(text, step["at"] + 1, F.length(text)))).otherwise(text)
