"""Manifest jobs over many models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules, sinks
from hubwarden.operators import weights
from hubwarden.plans.audits import Lake


def write_manifests(lake: Lake, path: str) -> tuple[DataFrame, DataFrame]:
    """Write a manifest of every target's weight files; returns what was written."""
    files, totals = weights.generate_manifest(lake.hashed)
    sinks.save_manifest(files, totals, path)
    spark = files.sparkSession
    return spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/totals")


def verify_against(lake: Lake, files: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issue rows, verdict per target) of written manifest tables against the files now."""
    listed = files.select("target", "path", F.col("sha256").alias("expected"))
    actual = lake.hashed.select("target", F.col("relpath").alias("path"), "sha256")
    return weights.verify_manifests(listed, totals, actual, "if_any_hash")


def verify_stored(
    lake: Lake, manifest_names: Sequence[str] = tuple(reversed(rules.MANIFEST_FILES))
) -> tuple[DataFrame, DataFrame]:
    """The same for manifest files that lie inside the targets (own name first)."""
    body = lake.manifest_texts.where(F.col("name").isin(*manifest_names)).select("target", "file", "text")
    at = weights.locate_manifest(lake.files, manifest_names)
    manifests = weights.read_manifests(at.join(body, ["target", "file"])).where("readable")
    actual = lake.hashed.select("target", F.col("relpath").alias("path"), "sha256")
    return weights.verify_manifests(
        weights.manifest_files(manifests), manifests.select("target", "integrity_hash"), actual, "if_any_hash"
    )
