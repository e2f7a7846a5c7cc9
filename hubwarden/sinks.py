"""Writing results as tables; nothing is written into a scanned tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Findings as Parquet or JSON lines, partitioned by scan type."""
    findings.write.mode(mode).partitionBy("scan_type").format(fmt).save(path)


def findings_json(findings: DataFrame) -> DataFrame:
    """(target, finding): each finding as one JSON object with its evidence nested."""
    fields = [F.col(c) for c in findings.columns if c != "evidence"]
    nested = F.to_json(F.struct(*fields, F.try_parse_json("evidence").alias("evidence")))
    return findings.select("target", nested.alias("finding"))


def save_manifest(files: DataFrame, totals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Manifest tables below ``path``: ``files`` (a row per file) and ``totals`` (a row per target)."""
    files.write.mode(mode).parquet(f"{path}/files")
    totals.write.mode(mode).parquet(f"{path}/totals")


def save_fingerprints(files: DataFrame, prints: DataFrame, path: str, mode: str = "append") -> None:
    """Fingerprint tables below ``path``: ``files`` and ``fingerprints``."""
    files.write.mode(mode).parquet(f"{path}/files")
    prints.write.mode(mode).parquet(f"{path}/fingerprints")


def save_run(table: DataFrame, path: str, run: str) -> None:
    """Rows of one run, in the partition ``run`` of the table at ``path``.

    Saving a run again replaces its rows and no other's, so a write that failed
    or was repeated leaves each row once; readers see the rows when all of them
    are committed.
    """
    rows = table.withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def save_scan(result, path: str, run: str) -> None:
    """All tables of a ``ScanResult`` below ``path``, safe to repeat under the same ``run``."""
    for name in ("findings", "header", "manifest_issues", "fingerprint_files"):
        save_run(getattr(result, name), f"{path}/{name}", run)


def export_lines(result) -> DataFrame:
    """(target, place, line) of a ``ScanResult``: a JSON object with each target's counts, score and scan id, then one per finding."""
    header = result.header.select("target", F.lit(0).alias("place"), F.to_json(F.struct(*result.header.columns)).alias("line"))
    return header.unionByName(findings_json(result.findings).select("target", F.lit(1).alias("place"), F.col("finding").alias("line")))
