"""Hashes and derived ids, all from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, without normalisation; null for null."""
    return F.sha2(text.cast("binary"), 256)


def uuid5(name: Column, namespace: str) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, version and variant set."""
    seed = F.unhex(F.lit("".join(c for c in namespace if c in "0123456789abcdef")))
    digest = F.sha1(F.concat(seed, name.cast("binary")))
    part = lambda start, n: F.substring(digest, start, n)
    variant = F.lower(F.conv((F.conv(part(17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def derived_id(namespace: str, *fields: Column) -> Column:
    """The id of NUL-joined fields; a null counts as an empty field."""
    return uuid5(F.concat_ws("\u0000", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), namespace)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 under a key known to the driver, as lower-case hex."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def canonical_audit_json(prev: Column, version: int = 2) -> Column:
    """The JSON that an audit row's hash covers: fixed key order, nulls kept;
    version 1 has the time, version 2 hasn't."""
    names = ["id", "action", "memory_id", "tenant_id", "actor_json", "reason", "details_json"]
    fields = [F.col(n) for n in names] + ([F.col("timestamp")] if version == 1 else [])
    return F.to_json(F.struct(*fields, prev.alias("prev_entry_hash")), {"ignoreNullFields": "false"})
