"""Ignore rules: globs compiled to regular expressions, the last match wins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that an import leaves out, in their order.
DEFAULTS = [
    "**/node_modules/**", "**/site-packages/**", "**/bower_components/**", "**/vendor/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**",
    "**/.git/**", "**/.next/**", "**/coverage/**", "**/dist/**", "**/build/**", "*.min.js", "*.min.css", "*.map", "*.bundle.js", "*.chunk.js",
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "poetry.lock", "uv.lock", "Pipfile.lock", "Gemfile.lock",
    "composer.lock", "go.sum", "flake.lock", "CODE_OF_CONDUCT*", "SECURITY.md", "SUPPORT.md", "PULL_REQUEST_TEMPLATE*", "**/ISSUE_TEMPLATE/**",
    "LICENSE*", "LICENCE*", "NOTICE*", "PATENTS*",
]
WILDCARDS = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def compiled(line: str) -> tuple[bool, bool, str] | None:
    """(negated, on the base name alone, regular expression) of a rule, or None
    for a comment or blank line. A leading slash anchors a rule
    with another slash at the root; one without is for base names anywhere."""
    rule = line.strip()
    negated = rule.startswith("!")
    rule = rule[negated:].strip()
    if not rule or line.strip().startswith("#"):
        return None
    body = "".join(WILDCARDS.get(part) or re.escape(part) for part in re.split(r"(\*\*/|\*\*|\*|\?)", rule.removeprefix("/")) if part)
    base_only = "/" not in rule.removeprefix("/")
    free = "" if rule.startswith("/") or base_only else "(?:.*/)?"
    return negated, base_only, f"(?i)^{free}{body}$"


def ignored(path: Column, lines: list[str] = DEFAULTS) -> Column:
    """Whether the last rule that matches a path excludes it."""
    whole = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")
    base = F.substring_index(whole, "/", -1)
    rules = [r for r in map(compiled, lines) if r]
    return reduce(lambda so_far, r: F.when((base if r[1] else whole).rlike(r[2]), F.lit(not r[0])).otherwise(so_far), rules, F.lit(False))
