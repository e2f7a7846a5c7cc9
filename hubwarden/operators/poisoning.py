"""Poisoned training data: triggers, phrases, flipped labels, replays, role skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.text import contains_any
from hubwarden.functions.paths import base_name
from hubwarden.operators.findings import evidence, finding, findings_from_flags, label_checks, unite
from hubwarden.operators.patterns import Family, find_rules
from hubwarden.sources.entries import is_oversized

_FILE = ("target", "file")
#: Checks whose matches are counted; the others only say that a rule hit.
COUNTED = ("poisoning_trigger_pattern", "label_flipping")


def text_families(
    triggers=rules.TRIGGERS, phrases=rules.SUSPICIOUS_PHRASES, flips=rules.LABEL_FLIPS
) -> list[Family]:
    """The rule families applied to a dataset file's raw text."""
    return [
        Family("poisoning_trigger_pattern", triggers, "count"),
        Family("suspicious_instruction", phrases, "phrase"),
        Family("label_flipping", flips, "count"),
    ]


def poisoned_texts(texts: DataFrame, families: Sequence[Family] | None = None) -> DataFrame:
    """Findings per (file, rule) from one pass over the texts.

    Label flips are searched in raw JSON text, so a match may span entries that
    share a line; ``flipped_entries`` is the per-entry form.
    """
    families = text_families() if families is None else families
    return poisoned_hits(find_rules(texts, "text", families, _FILE), [f.check for f in families])


def poisoned_hits(hits: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Findings from hits (target, file, check, rule, matches) of dataset rules."""
    check, rule, matches = F.col("check"), F.col("rule"), F.col("matches")
    counted = F.when(check != "suspicious_instruction", matches)
    rows = hits.select(
        "target",
        "file",
        "check",
        F.when(check == "poisoning_trigger_pattern", F.format_string("Trigger pattern in %s: %s", base_name(), rule))
        .when(check == "suspicious_instruction", F.format_string("Suspicious instruction in %s: '%s'", base_name(), rule))
        .otherwise(F.format_string("Possible label flip in %s", base_name()))
        .alias("detail"),
        evidence(file=base_name(), pattern=rule, matches=counted).alias("evidence"),
    )
    return label_checks(rows, checks)


def flipped_entries(entries: DataFrame, keys: Sequence[str], words: Sequence[str] = rules.HARM_WORDS) -> DataFrame:
    """Per parsed entry: an assistant turn that holds a harm word (keys, words found)."""
    body = F.lower(F.col("content"))
    found = F.array_compact(F.array(*[F.when(F.contains(body, F.lit(w)), F.lit(w)) for w in words]))
    rows = entries.where((F.lower("role") == "assistant") & contains_any(body, words))
    return rows.select(*keys, found.alias("words"))


def size_gate(files: DataFrame, max_bytes: int = rules.MAX_TEXT_BYTES) -> DataFrame:
    """``file_too_large``: a remark on the size; the file is scanned all the same."""
    mb = F.col("size") / 1e6
    return finding(
        files.where(F.col("size") > max_bytes),
        "file_too_large",
        F.format_string("File %s (%.1fMB) is over the limit of %.1fMB", F.col("name"), mb, F.lit(max_bytes / 1e6)),
        evidence(file=F.col("name")),
        F.col("relpath"),
    )


def encoding_gate(texts: DataFrame, compat: bool = False) -> DataFrame:
    """Files that are not UTF-8.

    Their repaired text is still scanned.  ``compat=True`` reports them as
    ``file_too_large`` and ``detect_poisoning`` then leaves them unscanned.
    """
    return finding(
        texts.where(~F.col("utf8_ok")),
        "file_too_large" if compat else "invalid_utf8",
        F.format_string("Invalid UTF-8 in %s", base_name()),
        evidence(file=base_name()),
        F.col("file"),
    )


def read_failures(texts: DataFrame) -> DataFrame:
    """``unreadable_file``: rows of texts that could not be read."""
    return finding(
        texts.where(~F.col("read_ok") if "read_ok" in texts.columns else F.col("text").isNull()),
        "unreadable_file",
        F.format_string("File %s could not be read", base_name()),
        evidence(file=base_name()),
        F.col("file"),
    )


def text_gate(texts: DataFrame, compat: bool = False) -> DataFrame:
    """``encoding_gate``, ``read_failures`` and ``oversized_document`` (its entries are not counted) in one pass."""
    flags = texts.withColumns({"read_ok": F.col("text").isNotNull(), "oversized": is_oversized(F.col("name"), F.col("text"))})
    return gate_findings(flags, compat)


def gate_findings(files: DataFrame, compat: bool = False, unread: bool = True) -> DataFrame:
    """The same from flags (target, file, utf8_ok, read_ok, oversized); ``unread``: whether unreadable files are reported."""
    name = base_name()
    return findings_from_flags(
        files,
        [
            (
                "file_too_large" if compat else "invalid_utf8",
                ~F.col("utf8_ok"),
                F.format_string("Invalid UTF-8 in %s", name),
                evidence(file=name),
            ),
            (
                "unreadable_file",
                ~F.col("read_ok") & unread,
                F.format_string("File %s could not be read", name),
                evidence(file=name),
            ),
            (
                "oversized_document",
                F.col("oversized"),
                F.format_string("%s is too large for one JSON value", name),
                evidence(file=name),
            ),
        ],
        file=F.col("file"),
    )


def duplicate_counts(
    entries: DataFrame, keys: Sequence[str], entry: str = "entry_key", limit: int = rules.DUPLICATE_LIMIT
) -> DataFrame:
    """(keys, duplicate_count): distinct entries that occur more than ``limit`` times.

    Counting is keyed by entry and combined before the shuffle, so neither a
    huge file nor one entry copied a billion times lands in one task.
    """
    copies = entries.groupBy(*keys, entry).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.where(F.col("_copies") > limit).groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count"))


def role_profile(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns per known role; other roles do not count."""
    role = F.lower("role")
    counts = entries.groupBy(*keys).agg(*[F.count_if(role == r).alias(f"{r}_turns") for r in rules.ROLES])
    return with_assistant_ratio(counts)


def with_assistant_ratio(counts: DataFrame) -> DataFrame:
    total = sum((F.col(f"{r}_turns") for r in rules.ROLES), F.lit(0).cast("long"))
    return counts.withColumn("turns", total).withColumn(
        "assistant_ratio", F.when(F.col("turns") > 0, F.col("assistant_turns") / F.col("turns"))
    )


def role_imbalances(profile: DataFrame, limit: float = rules.ASSISTANT_RATIO_LIMIT) -> DataFrame:
    return profile.where(F.col("assistant_ratio") > limit)


def replay_and_role_findings(profile: DataFrame) -> DataFrame:
    ratio, copies = F.col("assistant_ratio"), F.col("duplicate_count")
    roles = F.create_map(*[c for r in rules.ROLES for c in (F.lit(r), F.col(f"{r}_turns"))])
    return findings_from_flags(
        profile,
        [
            (
                "duplicate_entries",
                copies > 0,
                F.format_string("%d entries occur too often in %s", copies, base_name()),
                evidence(file=base_name(), duplicate_count=copies),
            ),
            (
                "role_imbalance",
                ratio > rules.ASSISTANT_RATIO_LIMIT,
                F.format_string("%.1f%% of turns in %s come from the assistant", ratio * 100, base_name()),
                evidence(file=base_name(), role_counts=roles, assistant_ratio=F.bround(ratio, 3)),
            ),
        ],
        file=F.col("file"),
    )


def detect_poisoning(
    files: DataFrame,
    texts: DataFrame,
    profile: DataFrame,
    max_bytes: int = rules.MAX_TEXT_BYTES,
    compat: bool = False,
) -> DataFrame:
    """All poisoning checks.

    ``files``: the dataset files' listing; ``texts``: their texts; ``profile``: ``dataset_stats.file_profile`` of the parsed entries.
    """
    scanned = texts.where("utf8_ok") if compat else texts
    return unite(
        [
            size_gate(files, max_bytes),
            text_gate(texts, compat),
            poisoned_texts(scanned),
            replay_and_role_findings(profile),
        ]
    )
