"""Profiles that grow with their data: counts of entries in a table, merged when read.

A run adds the counts of its own entries, so new data is never compared with
old data when it arrives.  Each run is a partition of the table, named by the
first and last number it covers: saving a run again replaces it, and a run that
covers others, which ``compact`` writes, takes their place for every reader.
What the statistics need is a sum or a maximum over runs, so a profile is the
same however its data was split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden.operators.dataset_stats import count_entries, profile_of_counts
from hubwarden.session import drop_folder

_FILE = ("target", "file")


def save_counts(facts: DataFrame, path: str, number: int, keys: Sequence[str] = _FILE) -> None:
    """Add the entries of run ``number`` to the table at ``path``, or replace those it had.

    ``facts``: ``dataset_stats.entry_facts``, with a column ``broken`` where a
    row may instead tell that its file is malformed.
    """
    flag = F.col("broken") if "broken" in facts.columns else F.lit(False)
    marked = facts.withColumn("broken", F.coalesce(flag, F.lit(False)))
    counts = count_entries(marked.where("NOT broken"), keys).withColumn("broken", F.lit(False))
    # one row tells of a malformed file, whatever is wrong in it
    bad = marked.where("broken").select(*keys, "broken").distinct()
    _save(counts.unionByName(bad, allowMissingColumns=True), path, number, number)


def _save(counts: DataFrame, path: str, first: int, last: int) -> None:
    rows = counts.withColumns({"first": F.lit(first), "last": F.lit(last)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first", "last").parquet(path)


def _runs(spark: SparkSession, path: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges that count, and those that a wider one has taken the place of; one row a run since the last ``vacuum``."""
    found = sorted((r["first"], -r["last"]) for r in spark.read.parquet(path).select("first", "last").distinct().collect())
    live, covered, reach = [], [], -1
    for first, last in ((a, -b) for a, b in found):
        (covered if last <= reach else live).append((first, last))
        reach = max(reach, last)
    return live, covered


def stored_counts(spark: SparkSession, path: str, keys: Sequence[str] = _FILE) -> DataFrame:
    """(keys, entry_key, _copies, _role, _len, _h, broken) over all runs."""
    live, _ = _runs(spark, path)
    counted = reduce(or_, ((F.col("first") == a) & (F.col("last") == b) for a, b in live), F.lit(False))
    rows = spark.read.parquet(path).where(counted)
    return rows.groupBy(*keys, "entry_key", "broken").agg(
        F.sum("_copies").alias("_copies"), F.max("_role").alias("_role"), F.max("_len").alias("_len"), F.max("_h").alias("_h")
    )


def stored_profile(spark: SparkSession, path: str, keys: Sequence[str] = _FILE, **limits) -> DataFrame:
    """``dataset_stats.file_profile`` over all runs; files of which any run found a part malformed have none."""
    counts = stored_counts(spark, path, keys)
    bad = counts.where("broken").select(*keys)
    return profile_of_counts(counts.where("NOT broken").join(bad, list(keys), "left_anti"), keys, **limits)


def compact(spark: SparkSession, path: str, keys: Sequence[str] = _FILE) -> None:
    """Write one run in place of all there are, with equal entries as one row.

    Until it is committed readers see the old runs, and from then on the new
    one; run it while no other run is being saved.
    """
    live, _ = _runs(spark, path)
    if len(live) > 1:
        _save(stored_counts(spark, path, keys), path, live[0][0], live[-1][1])


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the runs that ``compact`` has taken the place of, and return how many; no reader may still be using them."""
    _, covered = _runs(spark, path)
    for first, last in covered:
        drop_folder(spark, f"{path}/first={first}/last={last}")
    return len(covered)
