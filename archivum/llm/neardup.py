"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Each text gives its shingle set (64-bit hashes), minima under HASHES linear
   permutations, a key for each of BANDS bands of minima, and a signature that
   keeps the low BITS bits of each minimum.
2. Equal sets are one class; only a class's smallest id goes on.
3. A band key that several classes share is a bucket. Its hub is the member
   with the least id, and members are compared to hubs: never all pairs.
   The signature, corrected for chance collisions, drops pairs that are below
   the threshold by many standard errors; the rest are confirmed exactly.
   A few bands come first, each member with its most frequent hub; then all
   bands, where a group that was found counts as one member.
4. Buckets whose members are still in different groups are compared across
   those groups, so that no link is lost to the choice of hubs.

At a similarity of 0.8 a pair has no common band with a probability under one
in a million (5 rows, 36 bands).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.llm._shared import for_python, release_memory, stored
from archivum.llm.components import components

ROWS, BANDS = 5, 36
HASHES = ROWS * BANDS
BITS = 4
#: Standard errors below the threshold at which a signature rules a pair out.
SLACK = 4.5
#: Members of a bucket beyond which bitmaps of so many slots bound its pairs.
CROWDED, BITMAP, BLOCK = 64, 2048, 1024
#: Bands that the first comparisons use.
FIRST_BANDS = 8
PER_LONG = 64 // BITS
LONGS = -(-HASHES // PER_LONG)
WORDS, PERCENT = 5, 80
#: The ids of so many pairs may be broadcast (16 bytes each).
BROADCAST_PAIRS = 500_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64 - 1, HASHES, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's ``width``-word shingles.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words
    than ``width`` are one shingle; no words give none.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    if len(data) == 0:
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    take = min(width, n)
    out = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : n - take + 1 + k]
    return np.unique(_mix(out))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a shingle set (not empty) under every permutation."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):
        block = found[at : at + 256, None] * _A[None]
        block += _B[None]
        np.minimum(least, block.min(axis=0), out=least)
    return least


def _features(texts: list[str | None], width: int):
    counts, digests, bands, signatures = [], [], [], []
    place = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    band_salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for text in texts:
        found = shingles(text, width)
        counts.append(len(found))
        if not len(found):
            digests.append(None), bands.append(None), signatures.append(None)
            continue
        one, two = np.bitwise_xor.reduce(_mix(found)), _mix(found + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        digests.append(one.tobytes() + two.tobytes())
        least = _mix(minima(found))
        key = band_salt.copy()
        for column in least.reshape(BANDS, ROWS).T:
            key = _mix(key ^ column)
        bands.append(key.view(np.int64))
        low = np.zeros(LONGS * PER_LONG, np.uint64)
        low[:HASHES] = least & np.uint64(2**BITS - 1)
        signatures.append(np.bitwise_or.reduce(low.reshape(LONGS, PER_LONG) << place, axis=1).view(np.int64))
    return counts, digests, bands, signatures


def features(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, h (hash of the text), n_shingles, set_digest, bands and signature
    of every row."""
    for_python(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands, signatures = _features(batch.column(2).to_pylist(), width)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(signatures, longs)], names=["id", "h", "n_shingles", "set_digest", "bands", "signature"])
        release_memory()

    return df.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text")).mapInArrow(run, "id long, h long, n_shingles long, set_digest binary, bands array<long>, signature array<long>")


def estimate(one: str, two: str) -> Column:
    """Similarity out of two signature columns: the share of equal b-bit
    minima, less what chance makes equal. Written out long by long, so that it
    is compiled."""
    low = int("".join(["0" * (BITS - 1) + "1"] * PER_LONG), 2)
    low = low if low < 2**63 else low - 2**64
    terms = []
    for i in range(LONGS):
        differ = f"({one}[{i}] ^ {two}[{i}])"
        any_bit = " | ".join([differ, *(f"shiftrightunsigned({differ}, {k})" for k in range(1, BITS))])
        terms.append(f"bit_count(({any_bit}) & {low}L)")
    equal = 1 - F.expr(" + ".join(terms)) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _lowest(percent: int) -> float:
    """Estimates under this rule a pair of that similarity out."""
    chance, s = 2.0**-BITS, percent / 100
    p = s + (1 - s) * chance
    return s - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) whose full sets are similar enough, stored.

    Where the pairs are few, their ids are broadcast so that only their texts
    are shuffled.
    """
    pairs = stored(pairs, "pairs")
    count = pairs.count()
    if count == 0:
        return pairs
    if count <= BROADCAST_PAIRS:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    one = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                hub = batch.column(3)[i].as_py()
                if last is None or hub != last:
                    last, last_set = hub, shingles(hub, width)
                own = shingles(batch.column(2)[i].as_py(), width)
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                if len(own) and 100 * common >= percent * (len(own) + len(last_set) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])
        release_memory()

    return stored(both.mapInArrow(run, "a long, b long").distinct(), "links")


def bitmaps(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, bits): which of BITMAP hash slots the shingles of each of these
    documents fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1):
                marks = np.zeros(BITMAP, np.uint8)
                marks[(shingles(text.as_py(), width) % np.uint64(BITMAP)).astype(np.int64)] = 1
                made.append(np.packbits(marks).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "bits"])

    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_PAIRS else ids, "id", "left_semi")
    return texts.select("id", "text").mapInArrow(run, "id long, bits array<long>").dropDuplicates(["id"])


def crowded_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket, of different roots, whose sizes and bitmaps
    leave the similarity possible: a slot that only one side has stands for a
    shingle that the other lacks. ``members`` has bucket, n, id, root,
    n_shingles and bits. A bucket is dealt into blocks of about BLOCK members,
    and two blocks are compared at a time."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, roots, sizes, block = (rows[c].to_numpy() for c in ("id", "root", "n_shingles", "block"))
        bits = np.stack(rows["bits"].to_numpy()).view(np.uint64)
        own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        apart = bool(rows["low"].iloc[0] != rows["high"].iloc[0])
        found = []
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            both = np.bitwise_count(bits[part, None] & bits[None]).sum(axis=2, dtype=np.int64)
            most = np.minimum(sizes[part, None] - own[part, None] + both, sizes[None] - own[None] + both)
            fit = ((100 + percent) * most >= percent * (sizes[part, None] + sizes[None])) & (ids[part, None] < ids[None]) & (roots[part, None] != roots[None])
            if apart:
                fit &= block[part, None] != block[None]
            i, j = np.nonzero(fit)
            found.append((ids[part][i], ids[j]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a, "b": b})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return dealt.select("bucket", "low", "high", "block", "id", "root", "n_shingles", "bits").groupBy("bucket", "low", "high").applyInPandas(compare, "a long, b long")


def _shared_ids(made: DataFrame) -> DataFrame | None:
    """The ids whose rows have different shingle sets, or None."""
    found = made.where("n_shingles > 0 and id is not null").groupBy("id").agg(F.min("set_digest").alias("low"), F.max("set_digest").alias("high")).where("low < high").select("id")
    found = stored(found, "shared-ids")
    count = found.count()
    return None if count == 0 else F.broadcast(found) if count <= BROADCAST_PAIRS else found


def _named(rows: DataFrame, shared: DataFrame | None, by_text: bool) -> DataFrame:
    """Adds ``node``: the id, or a hash of id and text where the id alone
    doesn't tell the text. ``rows`` has id and h."""
    if shared is None:
        node = F.col("id")
    else:
        rows = rows.join(shared.withColumn("several", F.lit(True)), "id", "left")
        node = F.when(F.col("several"), F.xxhash64("id", "h")).otherwise(F.col("id"))
    if by_text:
        node = F.when(F.col("id").isNull(), F.xxhash64(F.lit("no id"), "h")).otherwise(node)
    return rows.withColumn("node", node).drop("several")


def _linked_classes(classes: DataFrame, docs: DataFrame, ties: DataFrame | None, width: int, percent: int) -> DataFrame:
    """(id, root) of the classes that are linked with others, by their texts or
    by ``ties`` (a, b). ``docs`` has node, as id, and text."""
    # A key is salted with its band, so keys of different bands don't meet.
    sizes = classes.select("id", "n_shingles", "signature")
    left = sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("size_a"), F.col("signature").alias("sig_a"))
    right = sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("size_b"), F.col("signature").alias("sig_b"))
    possible = (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (estimate("sig_a", "sig_b") >= _lowest(percent))

    def tried(pairs: DataFrame) -> DataFrame:
        return confirm(pairs.join(left, "a").join(right, "b").where(possible).select("a", "b"), docs, width, percent)

    # First the hubs of a few bands, each member with its most frequent one.
    rows = classes.select("id", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("high")).where("hub < high").select("bucket", "hub")
    to_hubs = rows.join(hubs, "bucket").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = to_hubs.groupBy(F.col("id").alias("a")).agg(F.max_by("hub", F.struct("n", "hub")).alias("b"))
    links = tried(best)
    if ties is not None:
        links = links.union(ties)
    roots = components(links)

    # Then all bands, each group in a bucket by its least member.
    def in_buckets() -> DataFrame:
        named = classes.select("id", "bands").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "bands")
        return named.select("id", "root", F.explode("bands").alias("bucket"))

    groups = in_buckets().groupBy("bucket", "root").agg(F.min("id").alias("id"))
    hubs = groups.groupBy("bucket").agg(F.min(F.struct("root", "id")).alias("low"), F.max("root").alias("high")).where("low.root < high").select("bucket", "low")
    across = groups.join(hubs, "bucket").where(F.col("root") != F.col("low.root")).select(F.col("id").alias("a"), F.col("low.id").alias("b")).distinct()
    second = tried(across)
    if not second.isEmpty():
        links = links.union(second)
        roots = components(links)

    # At last, members of one bucket that are still in different groups. In
    # crowded buckets, bitmaps rule out most pairs beforehand.
    members = in_buckets()
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("bucket", "n")
    rest = stored(members.join(mixed, "bucket"), "mixed")
    one = rest.where(F.col("n") <= CROWDED).select("bucket", F.col("id").alias("a"), F.col("root").alias("root_a")).join(left, "a")
    two = rest.where(F.col("n") <= CROWDED).select("bucket", F.col("id").alias("b"), F.col("root").alias("root_b")).join(right, "b")
    loose = one.join(two, (one.bucket == two.bucket) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & possible).select("a", "b")
    crowded = rest.where(F.col("n") > CROWDED)
    bits = stored(bitmaps(crowded.select("id").distinct(), docs, width), "bits")
    dense = crowded_pairs(crowded.join(bits, "id").join(sizes.select("id", "n_shingles"), "id"), percent)
    third = loose.union(dense).distinct()
    third = confirm(third, docs, width, percent)
    if not third.isEmpty():
        roots = components(links.union(third))
    return roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, percent: int = PERCENT, by_text: bool = False) -> DataFrame:
    """id, h (xxhash64 of the text), n_shingles, component_id and kept of
    every row.

    Rows are linked where 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id that can be reached and kept
    says whether it is the row's own. Null or wordless texts have no shingles
    and no links. Rows with the same id are one node, whatever their texts,
    and each is a row of the result; a row with a null id takes its class's
    component and is kept if there is none.

    With ``by_text`` a node is an id and a text, a null id too, so different
    texts of one id are linked only if they are similar. Then component_id is
    null where no row of the group has an id, and kept marks the group's first
    node by id (null last) and h. Other columns of ``df`` don't matter.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made = stored(features(rows, "id", "text", width), "neardup")
    shared = _shared_ids(made)
    docs = _named(rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))), shared, by_text).select(F.col("node").alias("id"), "text")
    real = _named(made.where("n_shingles > 0"), shared, by_text)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("h")))
    classes = real.groupBy("set_digest").agg(F.min("node").alias("node"), F.min_by(F.struct("n_shingles", "bands", "signature"), "node").alias("f"), first.alias("first"))
    classes = stored(classes.where("node is not null").select("set_digest", F.col("node").alias("id"), "f.*", "first"), "classes")
    ties = None
    if shared is not None and not by_text:
        of_id = real.select(F.col("id").alias("own"), "set_digest").join(shared.withColumnRenamed("id", "own"), "own").join(classes.select("set_digest", "id"), "set_digest").select("own", "id").distinct()
        ties = stored(of_id.join(of_id.groupBy("own").agg(F.min("id").alias("b")), "own").where("id <> b").select(F.col("id").alias("a"), "b"), "ties")

    roots = _linked_classes(classes, docs, ties, width, percent).withColumnRenamed("id", "least")
    found = classes.select("set_digest", "first", F.col("id").alias("least")).join(roots, "least", "left").select("set_digest", "first", F.coalesce("root", "least").alias("root"))
    if shared is not None or by_text:
        # The root is the least node; a group's first id is another matter.
        found = found.drop("first").join(found.groupBy("root").agg(F.min("first").alias("first")), "root")
    else:
        found = found.withColumn("first", F.struct(F.lit(False).alias("unnamed"), F.col("root").alias("id"), F.lit(0).cast("long").alias("h")))
    alone = made.where("n_shingles = 0").select("id", "h", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    out = made.where("n_shingles > 0").select("id", "h", "n_shingles", "set_digest").join(found.select("set_digest", "first"), "set_digest", "left")
    if by_text:
        out = out.select("id", "h", "n_shingles", F.col("first.id").alias("component_id"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("kept"))
    else:
        component = F.coalesce("first.id", "id")
        out = out.select("id", "h", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return out.union(alone)
