"""The findings table: building, uniting, labelling, ordering and rolling up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.checks import CHECKS, SCAN_TYPE_OF_CATEGORY
from hubwarden.functions import hashing, scores
from hubwarden.schemas import FINDING_COLUMNS
from hubwarden.session import stage


def evidence(**values: Column) -> Column:
    """A JSON object of the given columns."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def finding(
    df: DataFrame,
    check: str,
    detail: Column,
    proof: Column | None = None,
    file: Column | None = None,
) -> DataFrame:
    """Turn the rows of ``df`` (with a ``target`` column) into findings of one check."""
    severity, category, advice = CHECKS[check]
    return df.select(
        F.col("target").cast("string").alias("target"),
        F.lit(SCAN_TYPE_OF_CATEGORY[category]).alias("scan_type"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        F.lit(check).alias("check"),
        (F.lit(None) if file is None else file).cast("string").alias("file"),
        detail.alias("detail"),
        (F.lit("{}") if proof is None else proof).alias("evidence"),
        F.lit(advice).alias("recommendation"),
    )


def findings_from_flags(
    df: DataFrame, flagged: Sequence[tuple[str, Column, Column, Column]], file: Column | None = None
) -> DataFrame:
    """Several checks over each row of ``df``: (check, condition, detail, proof).

    One pass over ``df``: each row carries its list of hits and is exploded,
    instead of being scanned once per check.
    """
    # A plain array under explode: any other expression would be evaluated again
    # in the filter that Catalyst derives from it.
    hits = F.array(
        *[
            F.when(
                condition,
                F.struct(F.lit(check).alias("check"), detail.alias("detail"), proof.alias("evidence")),
            )
            for check, condition, detail, proof in flagged
        ]
    )
    where = (F.lit(None) if file is None else file).cast("string").alias("file")
    rows = df.select("target", where, F.explode(hits).alias("h")).where(F.col("h").isNotNull())
    rows = rows.select("target", "file", "h.*")
    return label_checks(rows, [f[0] for f in flagged])


def label_checks(rows: DataFrame, checks: Iterable[str]) -> DataFrame:
    """Add severity, category, scan type and advice to rows that name their check."""
    chosen = {c: CHECKS[c] for c in checks}
    check = F.col("check")
    return rows.select(
        F.col("target").cast("string").alias("target"),
        scores.lookup({c: SCAN_TYPE_OF_CATEGORY[v.category] for c, v in chosen.items()}, check).alias("scan_type"),
        scores.lookup({c: v.category for c, v in chosen.items()}, check).alias("category"),
        scores.lookup({c: v.severity for c, v in chosen.items()}, check).alias("severity"),
        check,
        "file",
        "detail",
        "evidence",
        scores.lookup({c: v.advice for c, v in chosen.items()}, check).alias("recommendation"),
    )


def unite(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def only_scan_types(findings: DataFrame, scan_types: Sequence[str]) -> DataFrame:
    return findings.where(F.col("scan_type").isin(*check_scan_types(scan_types)))


def check_scan_types(scan_types: Sequence[str] | None) -> list[str]:
    """All scan types when None; unknown names are refused."""
    chosen = list(rules.SCAN_TYPES if scan_types is None else scan_types)
    unknown = [s for s in chosen if s not in rules.SCAN_TYPES]
    if unknown:
        raise ValueError(f"unknown scan types {unknown}; choose from {list(rules.SCAN_TYPES)}")
    return chosen


def attach_attack_label(findings: DataFrame) -> DataFrame:
    """Add ``mitre_atlas``; checks without a label get ''."""
    return findings.withColumn("mitre_atlas", scores.lookup(rules.ATTACK_OF_CHECK, F.col("check"), ""))


def redact_paths(findings: DataFrame) -> DataFrame:
    """Hide user names in target, detail and top-level string evidence."""
    return findings.withColumns(
        {
            "target": scores.redact(F.col("target")),
            "detail": scores.redact(F.col("detail")),
            "evidence": scores.redact_evidence(F.col("evidence")),
        }
    )


def missing_targets(requested: DataFrame, listed: DataFrame) -> DataFrame:
    """``path_not_found`` for requested targets that the listing does not show."""
    absent = requested.select("target").join(listed.select("target").distinct(), "target", "left_anti")
    return finding(absent, "path_not_found", F.concat(F.lit("No such path: "), F.col("target")))


def unread_directories(listing: DataFrame) -> DataFrame:
    """``unreadable_directory``: directories whose entries could not be listed (see ``sources.tree.UNREADABLE``)."""
    return finding(
        listing.where(~F.col("is_file") & (F.col("size") < 0)),
        "unreadable_directory",
        F.concat(F.lit("Directory could not be listed: "), F.col("relpath")),
        evidence(path=F.col("relpath")),
        F.col("relpath"),
    )


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES]


def scan_summary(findings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row per target: counts, categories, risk score and band, gate verdict.

    With ``targets`` given, targets without findings get a row of zeros.
    """
    rolled = findings.groupBy("target").agg(
        F.count(F.lit(1)).alias("total_findings"),
        *severity_counts(),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.sum(scores.risk_weight(F.col("severity"))).alias("_risk"),
    )
    if targets is not None:
        counts = ["total_findings", *rules.SEVERITIES, "_risk"]
        rolled = targets.select("target").distinct().join(rolled, "target", "left").fillna(0, counts)
        rolled = rolled.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    score = F.least(F.lit(100), F.col("_risk")).cast("int")
    return rolled.select(
        "target",
        "total_findings",
        *rules.SEVERITIES,
        "categories",
        score.alias("risk_score"),
        scores.risk_band(score).alias("risk_band"),
        scores.gate_verdict(F.col("critical"), F.col("high")).alias("verdict"),
    )


def trust_scores(findings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """100 less a penalty per pipeline finding, at least 0."""
    lost = (
        only_scan_types(findings, ["pipeline"])
        .groupBy("target")
        .agg(F.sum(scores.trust_penalty(F.col("severity"))).alias("_lost"))
    )
    if targets is not None:
        lost = targets.select("target").distinct().join(lost, "target", "left")
    kept = F.greatest(F.lit(0), 100 - F.coalesce(F.col("_lost"), F.lit(0))).cast("int")
    return lost.select("target", kept.alias("trust_score"))


def by_severity(findings: DataFrame, staged: bool = False) -> DataFrame:
    """Worst first; ties in a fixed order.

    A sort over all rows first samples them, which derives the findings twice;
    ``staged`` writes them to the shared folder before.
    """
    if staged:
        findings = stage(findings, "findings")
    return findings.orderBy(scores.severity_rank(F.col("severity")), "check", "target", "file", "detail")


def stamp(findings: DataFrame, timestamp: str) -> DataFrame:
    """Add the scan's id and time; the time is passed in so that reruns agree."""
    return findings.withColumns(
        {
            "scan_id": hashing.scan_id(F.col("target"), F.lit(timestamp)),
            "scanned_at": F.lit(timestamp).cast("timestamp"),
        }
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, n: int, name: str) -> DataFrame:
    """The first ``n`` values per key in a fixed order, as an array.

    The rank filter becomes a group limit that runs before the shuffle, so a
    hot key sends at most ``n`` rows per task.
    """
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[F.col(o).alias(b) for o, b in zip(order, by, strict=True)], value.alias("_v"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    top = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    packed = F.array_sort(F.collect_list(F.struct("_rank", "_v")))
    return top.groupBy(*keys).agg(F.transform(packed, lambda s: s["_v"]).alias(name))


_SALTS = 64


def count_and_first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, n: int, name: str
) -> DataFrame:
    """(keys, n_rows, first ``n`` values in a fixed order) from one pass over ``df``.

    Rows are counted and ranked per (key, salt) first; the second step merges at
    most ``n`` values from each salt, so no group is held or sorted whole.
    """
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[F.col(o).alias(b) for o, b in zip(order, by, strict=True)], value.alias("_v"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(_SALTS)))
    rank = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*by))
    kept = F.when(F.col("_rank") <= n, F.struct(*by, "_v"))
    salted = (
        rows.withColumn("_rank", rank)
        .groupBy(*keys, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"), F.collect_list(kept).alias("_kept"))
    )
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("_kept"))), 1, n)
    return salted.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.transform(merged, lambda s: s["_v"]).alias(name)
    )
