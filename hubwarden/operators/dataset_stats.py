"""Statistical profiles of training entries: copies, roles, lengths, entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.text import shannon_entropy
from hubwarden.functions.paths import base_name
from hubwarden.operators.findings import evidence, findings_from_flags
from hubwarden.operators.poisoning import with_assistant_ratio



def _zero():
    return F.lit(0).cast("long")


def text_profile(
    entries: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    sigma: float = rules.OUTLIER_SIGMA,
    short_length: int = rules.SHORT_LENGTH,
    entropy_limit: float = rules.ENTROPY_LIMIT,
    with_entropy: bool = True,
) -> DataFrame:
    """One row per key: lengths, outliers, short entries and entropy of a text column."""
    keys = list(keys)
    measured = entries.where(F.col(text).isNotNull()).select(
        *keys,
        F.length(text).cast("long").alias("_len"),
        (shannon_entropy(F.col(text)) if with_entropy else F.lit(None).cast("double")).alias("_h"),
    )
    per_length = measured.groupBy(*keys, "_len").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if((F.col("_len") > 0) & (F.col("_h") > entropy_limit)).alias("_high"),
        F.sum(F.when(F.col("_len") > 0, F.col("_h"))).alias("_h_sum"),
    )
    profile = _from_lengths(per_length, keys, sigma, short_length, {})
    return profile if with_entropy else profile.drop("high_entropy_count", "mean_entropy")


def _from_lengths(per_length: DataFrame, keys: list[str], sigma: float, short_length: int, extra: dict) -> DataFrame:
    """Profile from at most one row per (key, distinct length).

    Counting per length combines before its shuffle and spreads a hot key over
    its lengths.  Mean, deviation and outliers need the key's rows twice; they
    come from these few rows, so entries are never read or shuffled again.  The
    deviation is that of the population.  A NULL length marks entries that
    count for ``extra`` only.
    """
    n, length = F.when(F.col("_len").isNotNull(), F.col("_n")), F.col("_len")
    group = Window.partitionBy(*keys)
    shaped = per_length.withColumn("_mean", F.sum((n * length).cast("double")).over(group) / F.sum(n).over(group))
    deviation = n * F.pow(length - F.col("_mean"), F.lit(2.0))
    shaped = shaped.withColumn("_sd", F.sqrt(F.sum(deviation).over(group) / F.sum(n).over(group)))
    outlying = (F.col("_sd") > 0) & (F.abs(length - F.col("_mean")) > sigma * F.col("_sd"))
    profile = shaped.groupBy(*keys).agg(
        F.coalesce(F.sum(n), _zero()).alias("n"),
        F.max("_mean").alias("mean_length"),
        F.max("_sd").alias("sd_length"),
        F.sum(F.when(outlying, n).otherwise(_zero())).alias("outliers"),
        F.sum(F.when(length < short_length, n).otherwise(_zero())).alias("short_count"),
        F.sum(F.when(length > 0, n).otherwise(_zero())).alias("texts"),
        F.sum("_high").alias("high_entropy_count"),
        (F.sum("_h_sum") / F.sum(F.when(length > 0, n))).alias("mean_entropy"),
        *[F.sum(column).alias(name) for name, column in extra.items()],
    )
    return profile.withColumn("outlier_ratio", F.when(F.col("n") > 0, F.col("outliers") / F.col("n")))


def file_profile(
    entries: DataFrame,
    keys: Sequence[str] = ("target", "file"),
    sigma: float = rules.OUTLIER_SIGMA,
    short_length: int = rules.SHORT_LENGTH,
    entropy_limit: float = rules.ENTROPY_LIMIT,
    duplicate_limit: int = rules.DUPLICATE_LIMIT,
) -> DataFrame:
    """Copies, roles, lengths and entropy of every file from one pass over its entries.

    ``entries``: (keys, entry_key, role, measured).  Each entry is reduced to
    numbers, equal entries are merged (the only shuffle whose size grows with
    the entries; copies combine before it), and all measures are sums over the
    merged rows.
    """
    facts = entry_facts(entries, keys)
    return profile_of_facts(facts, keys, sigma, short_length, entropy_limit, duplicate_limit)


def entry_facts(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(kept columns, entry_key, _role, _len, _h): each entry reduced to a hash and numbers."""
    role = F.lower("role")
    return entries.select(
        *keep,
        "entry_key",
        F.coalesce(F.array_position(F.lit(list(rules.ROLES)), role), _zero()).alias("_role"),
        F.length("measured").cast("long").alias("_len"),
        shannon_entropy(F.col("measured")).alias("_h"),
    )


def profile_of_facts(
    facts: DataFrame,
    keys: Sequence[str] = ("target", "file"),
    sigma: float = rules.OUTLIER_SIGMA,
    short_length: int = rules.SHORT_LENGTH,
    entropy_limit: float = rules.ENTROPY_LIMIT,
    duplicate_limit: int = rules.DUPLICATE_LIMIT,
) -> DataFrame:
    """``file_profile`` from ``entry_facts``."""
    return profile_of_counts(count_entries(facts, keys), keys, sigma, short_length, entropy_limit, duplicate_limit)


def count_entries(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, entry_key, _copies, _role, _len, _h): equal entries of ``entry_facts`` as one row."""
    return facts.groupBy(*keys, "entry_key").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.max("_role").alias("_role"),
        F.max("_len").alias("_len"),
        F.max("_h").alias("_h"),
    )


def profile_of_counts(
    merged: DataFrame,
    keys: Sequence[str] = ("target", "file"),
    sigma: float = rules.OUTLIER_SIGMA,
    short_length: int = rules.SHORT_LENGTH,
    entropy_limit: float = rules.ENTROPY_LIMIT,
    duplicate_limit: int = rules.DUPLICATE_LIMIT,
) -> DataFrame:
    """``file_profile`` from ``count_entries``."""
    keys = list(keys)
    copies, filled = F.col("_copies"), F.col("_len") > 0
    per_length = merged.groupBy(*keys, "_len").agg(
        F.sum(copies).alias("_n"),
        F.sum(F.when(filled & (F.col("_h") > entropy_limit), copies).otherwise(_zero())).alias("_high"),
        F.sum(F.when(filled, F.col("_h") * copies)).alias("_h_sum"),
        F.count_if(copies > duplicate_limit).alias("_duplicates"),
        *[
            F.sum(F.when(F.col("_role") == i + 1, copies).otherwise(_zero())).alias(f"_{r}")
            for i, r in enumerate(rules.ROLES)
        ],
    )
    extra = {"entries": F.col("_n"), "duplicate_count": F.col("_duplicates")}
    extra.update({f"{r}_turns": F.col(f"_{r}") for r in rules.ROLES})
    return with_assistant_ratio(_from_lengths(per_length, keys, sigma, short_length, extra))


def enough(profile: DataFrame, least: int = rules.MIN_MEASURED_ENTRIES) -> DataFrame:
    """Groups with too few entries give no statistical result at all."""
    return profile.where(F.col("n") >= least)


def length_anomalies(profile: DataFrame, ratio: float = rules.OUTLIER_RATIO_LIMIT) -> DataFrame:
    return enough(profile).where(F.col("outlier_ratio") > ratio)


def short_entry_groups(profile: DataFrame, ratio: float = rules.SHORT_RATIO_LIMIT) -> DataFrame:
    return enough(profile).where(F.col("short_count") > F.col("n") * ratio)


def high_entropy_groups(profile: DataFrame, ratio: float = rules.ENTROPY_RATIO_LIMIT) -> DataFrame:
    return enough(profile).where(F.col("high_entropy_count") > F.col("texts") * ratio)


def analyze_dataset_stats(profile: DataFrame, sigma: float = rules.OUTLIER_SIGMA) -> DataFrame:
    """Findings from a ``file_profile`` made with the same ``sigma``."""
    n = F.col("n")
    return findings_from_flags(
        enough(profile),
        [
            (
                "length_anomaly",
                F.col("outlier_ratio") > rules.OUTLIER_RATIO_LIMIT,
                F.format_string(
                    f"%.1f%% of entries in %s are over {sigma:g} sigma from the mean length",
                    F.col("outlier_ratio") * 100,
                    base_name(),
                ),
                evidence(
                    file=base_name(),
                    total_entries=n,
                    outliers=F.col("outliers"),
                    mean_length=F.bround("mean_length", 1),
                    std_dev=F.bround("sd_length", 1),
                ),
            ),
            (
                "short_entries",
                F.col("short_count") > n * rules.SHORT_RATIO_LIMIT,
                F.format_string("%d very short entries in %s", F.col("short_count"), base_name()),
                evidence(file=base_name(), short_count=F.col("short_count"), total=n),
            ),
            (
                "high_entropy_content",
                F.col("high_entropy_count") > F.col("texts") * rules.ENTROPY_RATIO_LIMIT,
                F.format_string("%d entries in %s have unusually high entropy", F.col("high_entropy_count"), base_name()),
                evidence(
                    file=base_name(),
                    high_entropy_count=F.col("high_entropy_count"),
                    mean_entropy=F.bround("mean_entropy", 3),
                ),
            ),
        ],
        file=F.col("file"),
    )
