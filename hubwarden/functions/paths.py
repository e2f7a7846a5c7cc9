"""Predicates that stand for file globs relative to a scan target's root."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubwarden.functions.text import any_of

def name_matches(glob: str, name: Column | None = None) -> Column:
    """``*`` in a glob stands for any characters of the name."""
    name = F.col("name") if name is None else name
    if "*" not in glob:
        return name == glob
    head, _, tail = glob.partition("*")
    if "*" in tail:
        return name.rlike("^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$")
    fits = F.startswith(name, F.lit(head)) if head else F.lit(True)
    if tail:
        fits = fits & F.endswith(name, F.lit(tail))
    return fits & (F.length(name) >= len(head) + len(tail))


def named(globs: Iterable[str]) -> Column:
    globs = list(globs)
    plain = [g for g in globs if "*" not in g]
    wild = [name_matches(g) for g in globs if "*" in g]
    return any_of(([F.col("name").isin(plain)] if plain else []) + wild)


def base_name(relpath: str = "file") -> Column:
    """The last part of a relative path."""
    return F.substring_index(F.col(relpath), "/", -1)


def at_root(globs: Iterable[str]) -> Column:
    """``*.json`` style: only directly below the target."""
    return (F.col("depth") == 0) & named(globs)


def present(glob: str) -> Column:
    """Whether this artifact row shows that ``glob`` exists at the target's root."""
    if glob.endswith("/"):
        folder = glob.rstrip("/")
        return (F.col("relpath") == folder) | F.startswith("relpath", F.lit(glob))
    return at_root([glob])
