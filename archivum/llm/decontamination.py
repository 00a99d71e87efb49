"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions.

Both sides hash every run of GRAM words and keep, of every ``window - GRAM + 1``
neighbouring hashes, the least one. Two texts that share ``window`` words thus
share a fingerprint inside them, so joining fingerprints misses no occurrence.
A hit is extended to all windows of words around it, and those are compared
word for word with the windows of the benchmark. Items shorter than a window
have no complete set of hashes; their few lengths are looked up at the places
in documents where their first words occur.

The benchmark's fingerprints and windows are broadcast only where a count
shows that they are few; otherwise they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import discard, lower_ascii, stored

WINDOW, GRAM = 10, 5
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, said by what it has, which is faster.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The same words before A-Z is lowered.
RAW_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
#: So many rows of the benchmark's side may be broadcast, if their strings
#: have so few bytes in all.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: So many different first words of short items are tested in place.
FIRST_WORDS = 2_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def with_grams(df: DataFrame, gram: int = GRAM) -> DataFrame:
    """Adds ``hashes`` of the array ``words`` and ``grams``, a hash of every
    run of ``gram`` words."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    run = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(gram)])
    last = F.size("words") - gram
    return df.withColumn("grams", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>")))


def with_chosen(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``chosen``: the places in ``grams`` of the least hash of each run
    of ``window - gram + 1`` hashes, leftmost for ties."""
    width = window - gram + 1

    def least(i: Column) -> Column:
        # Both uses name ``grams``, so that the optimizer keeps it a column.
        return i + F.array_position(F.slice("grams", i + 1, width), F.array_min(F.slice("grams", i + 1, width))).cast("int") - 1

    last = F.size("grams") - width
    return df.withColumn("chosen", F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), least))).otherwise(F.array().cast("array<int>")))


def windows_of(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of the benchmark, (w, n, gram): number, words, and
    the words themselves; and the items that have each, (w, item), ids as
    strings. An item of fewer words is one window. Both are stored."""
    worded = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where("size(words) > 0 and item is not null")
    n = F.least(F.size("words"), F.lit(window))
    placed = worded.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    cut = stored(placed.select("item", "n", F.array_join(F.expr("slice(words, at, n)"), " ").alias("gram")).distinct(), "item-windows")
    windows = stored(cut.select("n", "gram").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    owners = stored(cut.join(windows, ["n", "gram"]).select("w", "item"), "window-items")
    discard(cut)
    return windows, owners


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows and the bytes of its strings are few."""
    size = F.lit(0)
    for field in df.schema:
        if field.dataType.simpleString() == "string":
            size = size + F.octet_length(field.name)
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every occurrence of a benchmark window in a document: the key columns
    (all of ``docs`` but ``words``), start (from 0), n and w."""
    keys = [c for c in docs.columns if c != "words"]
    full = windows.where(F.col("n") == window)
    prints = with_chosen(with_grams(full.select(F.split("gram", " ").alias("words")), gram), window, gram)
    prints = prints.select(F.explode_outer("chosen").alias("p"), "grams").select(F.get("grams", F.col("p")).alias("print")).distinct()

    lead = window - gram
    marked = with_chosen(with_grams(docs, gram), window, gram)
    # Outer, as the filter inferred from an inner explode would be pushed below
    # the columns it is made of and evaluate them anew inside the lambdas.
    placed = marked.select(*keys, "words", "grams", F.explode_outer("chosen").alias("p")).withColumn("print", F.get("grams", F.col("p")))
    hits = placed.join(_few(prints), "print", "left_semi")
    start = F.greatest(F.col("p") - lead, F.lit(0))
    near = hits.select(*keys, start.alias("from"), F.slice("words", start + 1, F.col("p") - start + window).alias("near"))
    cuts = near.select(*keys, "from", "near", F.explode(F.sequence(F.lit(0), F.lit(lead))).alias("k")).where(F.size("near") - F.col("k") >= window)
    cut = cuts.select(*keys, (F.col("from") + F.col("k")).alias("start"), F.array_join(F.expr(f"slice(near, k + 1, {window})"), " ").alias("gram")).distinct()
    found = cut.join(_few(full.select("gram", "n", "w")), "gram").select(*keys, "start", "n", "w")

    short = windows.where(F.col("n") < window)
    lengths = sorted(r.n for r in short.select("n").distinct().collect())
    if not lengths:
        return found
    first = short.select(F.substring_index("gram", " ", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    place = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    if len(first) <= FIRST_WORDS:
        place = F.filter(place, lambda i: F.get("words", i).isin([r.w for r in first]))
    spots = docs.select(*keys, "words", F.explode_outer(place).alias("start"))
    sized = spots.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.col("start") + F.col("n") <= F.size("words"))
    cut = sized.select(*keys, "start", "n", F.array_join(F.expr("slice(words, start + 1, n)"), " ").alias("gram"))
    return found.union(cut.join(_few(short), ["n", "gram"]).select(*keys, "start", "n", "w"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_words, n_hit, n_items, items (sorted
    strings), contaminated.

    One row for each row of ``docs``; rows with the same id and text have the
    same result. Null and wordless texts have no words and no hits, items
    without words or id no windows, and an empty benchmark hits nothing.
    Other columns of either table don't matter.
    """
    windows, owners = windows_of(items, item_id, item_text, window)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    worded = keyed.select("doc_id", "h", words_of(F.col("text")).alias("words"))
    hits = stored(occurrences(worded, windows, window).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "start", "n", "w").distinct(), "hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    spans = hits.groupBy("d", "g").agg(F.collect_set(F.struct("start", "n")).alias("spans")).select("d", "g", covered.cast("long").alias("n_hit"))
    owned = hits.select("d", "g", "w").distinct().join(_few(owners), "w").groupBy("d", "g").agg(F.array_sort(F.collect_set("item")).alias("items"))
    summed = spans.join(owned.select(F.col("d").alias("own"), F.col("g").alias("hash"), "items"), F.col("d").eqNullSafe(F.col("own")) & (F.col("g") == F.col("hash"))).select("d", "g", "n_hit", "items")
    counted = keyed.select("doc_id", "h", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"))
    out = counted.join(summed, counted.doc_id.eqNullSafe(summed.d) & (counted.h == summed.g), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (n_hit > 0).alias("contaminated"))
