"""Paths: safety, collections, citations, workspaces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The collections of an index, in the order they are looked for.
COLLECTIONS = ["curated", "decisions", "guides", "inbox", "archive", "bulk"]
SCOPES = {"curated": ["curated", "decisions", "guides"], "inbox": ["inbox"], "archived": ["archive"], "bulk": ["bulk"]}


def is_safe(path: Column, roots: list[str] = []) -> Column:  # noqa: B006
    """No NUL, no ``..`` segment, and relative or below a root (a root is not
    a prefix of other names: ``/a`` doesn't hold ``/ab``)."""
    below = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        below = below | (path == root) | path.startswith(root + "/")
    climbs = F.array_contains(F.split(path, r"[/\\]"), "..")
    return F.coalesce(~F.contains(path, F.lit("\u0000")) & ~climbs & (~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") | below) & (path != ""), F.lit(False))


def collection(path: Column) -> Column:
    """The first known collection whose name occurs in a path, else unknown."""
    found = F.lit("unknown")
    for name in reversed(COLLECTIONS):
        found = F.when(F.contains(path, F.lit(name)), name).otherwise(found)
    return found


def cited_file(citation: Column, scheme: str = "index") -> Column:
    """``folder/name`` of ``scheme://collection/name``; null for other forms,
    collections that aren't known, and names that are paths."""
    pattern = rf"^{re.escape(scheme)}://({'|'.join(COLLECTIONS)})/([^/\\]+)$"
    name = F.regexp_extract(citation, pattern, 2)
    return F.when((name != "") & ~name.isin(".", ".."), F.concat_ws("/", F.regexp_extract(citation, pattern, 1), name))


def ancestors(path: Column) -> Column:
    """The folders that hold a path, the nearest first; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
