"""Column functions over whole texts: matching, case folding, entropy."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hubwarden.rules import Pattern

# Characters outside ASCII that a case-insensitive match equates with an ASCII
# letter although lower-casing does not: long s, dotless i, dotted I, Kelvin sign.
ODD_CASE = ("\u017f", "\u0131", "\u0130", "\u212a")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections use several times.

    Catalyst copies a plain column's expression into every filter above it; a
    generator's output is computed once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def java_regex(pattern: Pattern, regex: str | None = None) -> str:
    """Unicode classes, ``.`` stops only at ``\\n``; optionally any case."""
    return ("(?idU)" if pattern.ignore_case else "(?dU)") + (regex or pattern.regex)


def may_match(text: Column, lowered: Column, odd: Column, pattern: Pattern) -> Column:
    """Cheap necessary condition for ``pattern`` to match ``text``.

    ``odd``: the text holds a character of ``ODD_CASE``, so that its lower-cased
    form proves nothing.
    """
    if not pattern.needles:
        return F.lit(True)
    if not pattern.ignore_case:
        return contains_any(text, pattern.needles)
    return odd | contains_any(lowered, pattern.needles)


def match_count(text: Column, pattern: Pattern) -> Column:
    if pattern.linear is None:
        return F.regexp_count(text, F.lit(java_regex(pattern))).cast("long")
    found = F.regexp_extract_all(text, F.lit(java_regex(pattern, pattern.linear)), F.lit(1))
    return F.size(F.array_remove(found, "")).cast("long")


def is_match(text: Column, pattern: Pattern) -> Column:
    if pattern.linear is not None:
        return (match_count(text, pattern) > 0).cast("long")
    return text.rlike(java_regex(pattern)).cast("long")


def words_found(text: Column, words: Iterable[str]) -> Column:
    """The words that occur in ``text``, in rule order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def words_missing(text: Column, words: Iterable[str]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def unix_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _entropy_of(text: str | None) -> float | None:
    if text is None:
        return None
    if not text:
        return 0.0
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.max() < 0x10000:
        counts = np.bincount(points)
        counts = counts[counts > 0]
    else:
        counts = np.unique(points, return_counts=True)[1]
    n = points.size
    return max(0.0, float(np.log2(n) - (counts * np.log2(counts)).sum() / n))


@F.pandas_udf(DoubleType())
def shannon_entropy(text: pd.Series) -> pd.Series:
    """Bits per character over code points; empty text has 0.

    An Arrow-batched function on purpose: the all-native plans were 12x
    (explode and count, which also shuffles more bytes than the text itself)
    and 50x (higher-order functions) slower on 25 M characters.
    """
    return text.map(_entropy_of).astype("float64")
