"""Paths, names and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(parent == "", "/").otherwise(parent)


def ancestors(path: Column) -> Column:
    """A path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when((n == 1) & path.startswith("/"), "/").otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(base_name(name), r"(\.[^.]*)$", 1))


def has_prefix(path: Column, prefix: str) -> Column:
    """Exact beginning, not by folder: /a/b holds /a/bc. Reaches a Parquet scan."""
    return path.startswith(prefix)


def within(path: Column, root: str) -> Column:
    """A folder and everything below it; /a/b doesn't hold /a/bc."""
    root = root.rstrip("/") or "/"
    return (path == root) | path.startswith(root if root == "/" else root + "/")


def glob_pattern(glob: str) -> str:
    """Regular expression, anchored, of a glob with ``*``, ``?``, ``[...]`` and ``\\``, none of which matches ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i >= len(glob):
                raise ValueError(f"malformed pattern {glob!r}")
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            end = glob.find("]", i + (2 if glob[i : i + 1] == "^" else 1))
            if end < 0:
                raise ValueError(f"malformed pattern {glob!r}")
            inner = glob[i:end]
            negated = inner.startswith("^")
            body = re.sub(r"([\[\]&\\])", r"\\\1", inner[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def validated(patterns: list[str]) -> list[str]:
    """Patterns for one path component: trimmed, not empty, without separators, well formed, each once."""
    out: list[str] = []
    for pattern in patterns:
        pattern = pattern.strip()
        if not pattern or "/" in pattern or "\\" in pattern:
            raise ValueError(f"pattern {pattern!r} must name one path component")
        glob_pattern(pattern)
        if pattern not in out:
            out.append(pattern)
    return out


def any_glob(patterns: list[str]) -> str:
    """One regular expression for all of them; matches nothing if there is none."""
    return "|".join(glob_pattern(p) for p in patterns) or "(?!)"
