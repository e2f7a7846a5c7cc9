"""Pattern and phrase search over any table with a text column.

Rules are unrolled into the projection: one read of each text serves every
rule of every family, and no rule table is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden.functions.text import ODD_CASE, any_of, contains_any, is_match, match_count, may_match, once
from hubwarden.rules import Pattern


class Family(NamedTuple):
    """Rules that share a check name.

    ``mode``: ``count`` counts matches, ``search`` stops at the first one,
    ``phrase`` looks for a lower-cased phrase, ``literal`` for an exact one.
    ``applies`` restricts the family to some rows (e.g. by file name).
    """

    check: str
    rules: Sequence[Pattern | str]
    mode: str
    applies: Column | None = None


def _possible(family: Family) -> Column:
    """Cheap necessary condition for any rule of the family to hit."""
    hit = any_of(_gate(family, rule) for rule in family.rules)
    return hit if family.applies is None else F.col(f"_on_{family.check}") & hit


def _gate(family: Family, rule: Pattern | str) -> Column:
    if family.mode == "phrase":
        return F.contains("_lower", F.lit(rule))
    if family.mode == "literal":
        return F.contains("_text", F.lit(rule))
    return may_match(F.col("_text"), F.col("_lower"), F.col("_odd"), rule)


def _matches(family: Family, rule: Pattern | str) -> Column:
    found = F.lit(1).cast("long")
    if family.mode == "count":
        found = match_count(F.col("_text"), rule)
    elif family.mode == "search":
        found = is_match(F.col("_text"), rule)
    gate = _gate(family, rule)
    if family.applies is not None:
        gate = F.col(f"_on_{family.check}") & gate
    return F.when(gate, found).otherwise(F.lit(0).cast("long"))


def _hits(families: Sequence[Family]) -> Column:
    """(check, rule, matches) of every rule; the columns that ``_prepared`` adds are there."""
    return F.array(
        *[
            F.struct(
                F.lit(f.check).alias("check"),
                F.lit(r.regex if isinstance(r, Pattern) else r).alias("rule"),
                _matches(f, r).alias("matches"),
            )
            for f in families
            for r in f.rules
        ]
    )


def _prepared(rows: DataFrame) -> DataFrame:
    rows = once(rows, "_lower", F.lower("_text"))
    return once(rows, "_odd", contains_any(F.col("_text"), ODD_CASE))


def with_hits(df: DataFrame, text: str, families: Sequence[Family], name: str = "hits") -> DataFrame:
    """Add (check, rule, matches) of the rules that hit, as an array; NULL where no rule can."""
    rows = df.withColumns({f"_on_{f.check}": f.applies for f in families if f.applies is not None})
    rows = _prepared(rows.withColumn("_text", F.col(text)))
    found = F.filter(_hits(families), lambda h: h["matches"] > 0)
    rows = once(rows, name, F.when(any_of(_possible(f) for f in families), found))
    return rows.select(*df.columns, name)


def find_rules(df: DataFrame, text: str, families: Sequence[Family], keys: Sequence[str]) -> DataFrame:
    """(keys, check, rule, matches), one row per row of ``df`` and rule that hits.

    ``matches`` is the number of matches in ``count`` mode and 1 otherwise.
    """
    conditions = [f.applies.alias(f"_on_{f.check}") for f in families if f.applies is not None]
    rows = df.select(*keys, F.col(text).alias("_text"), *conditions)
    if any(f.applies is not None for f in families) and all(f.applies is not None for f in families):
        rows = rows.where(any_of(F.col(f"_on_{f.check}") for f in families))
    rows = _prepared(rows).where(any_of(_possible(f) for f in families))
    return rows.select(*keys, F.explode(_hits(families)).alias("_hit")).select(*keys, "_hit.*").where(F.col("matches") > 0)


def count_patterns(df: DataFrame, text: str, patterns: Sequence[Pattern], keys: Sequence[str]) -> DataFrame:
    """(keys, pattern, matches) for every pattern found in a row's text."""
    hits = find_rules(df, text, [Family("hit", patterns, "count")], keys)
    return hits.select(*keys, F.col("rule").alias("pattern"), "matches")


def find_patterns(df: DataFrame, text: str, patterns: Sequence[Pattern], keys: Sequence[str]) -> DataFrame:
    """(keys, pattern) where the pattern occurs at least once."""
    hits = find_rules(df, text, [Family("hit", patterns, "search")], keys)
    return hits.select(*keys, F.col("rule").alias("pattern"))


def find_phrases(
    df: DataFrame, text: str, phrases: Sequence[str], keys: Sequence[str], any_case: bool = True
) -> DataFrame:
    """(keys, phrase) for every phrase contained in a row's text."""
    hits = find_rules(df, text, [Family("hit", phrases, "phrase" if any_case else "literal")], keys)
    return hits.select(*keys, F.col("rule").alias("phrase"))


def total_matches(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Match counts summed per key and pattern (e.g. from entries up to their file)."""
    return hits.groupBy(*keys, "pattern").agg(F.sum("matches").alias("matches"))
