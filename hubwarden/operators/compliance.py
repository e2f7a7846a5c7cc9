"""Compliance scorecards from the presence of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.paths import present
from hubwarden.functions.text import any_of


def _passed(files: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """One row per target with a boolean column per check id, from one combined pass."""
    return files.groupBy("target").agg(
        *[F.max(any_of(present(g) for g in globs)).alias(check) for check, globs in wanted.items()]
    )


def nist_checks(files: DataFrame, checks=rules.NIST_CHECKS) -> DataFrame:
    """(target, function, check, status) for every target and check."""
    passed = _passed(files, {check: globs for _, check, globs in checks})
    rows = F.array(
        *[
            F.struct(
                F.lit(function).alias("function"),
                F.lit(check).alias("check"),
                F.when(F.col(check), "pass").otherwise("fail").alias("status"),
            )
            for function, check, _ in checks
        ]
    )
    return passed.select("target", F.explode(rows).alias("c")).select("target", "c.*")


def nist_scorecard(files: DataFrame, checks=rules.NIST_CHECKS) -> DataFrame:
    """Checks passed per target and function, and in total (function NULL) with its score."""
    rows = nist_checks(files, checks)
    per = rows.groupingSets([["target", "function"], ["target"]], "target", "function").agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count(F.lit(1)).alias("checks")
    )
    score = F.bround(F.col("passed") / F.col("checks") * 100).cast("int")
    return per.select("target", "function", "passed", "checks", score.alias("score"))


def owasp_categories(files: DataFrame, categories=rules.OWASP_CATEGORIES) -> DataFrame:
    """(target, category, status) for every target and category."""
    wanted = {f"c{i}": globs for i, (_, globs) in enumerate(categories)}
    passed = _passed(files, wanted)
    rows = F.array(
        *[
            F.struct(
                F.lit(category).alias("category"),
                F.when(F.col(f"c{i}"), "covered").otherwise("not_covered").alias("status"),
            )
            for i, (category, _) in enumerate(categories)
        ]
    )
    return passed.select("target", F.explode(rows).alias("c")).select("target", "c.*")


def owasp_scorecard(files: DataFrame, categories=rules.OWASP_CATEGORIES) -> DataFrame:
    per = (
        owasp_categories(files, categories)
        .groupBy("target")
        .agg(F.count_if(F.col("status") == "covered").alias("covered"), F.count(F.lit(1)).alias("categories"))
    )
    score = F.bround(F.col("covered") / F.col("categories") * 100).cast("int")
    return per.select("target", "covered", "categories", score.alias("score"))


def check_compliance(files: DataFrame, framework: str = "nist") -> tuple[DataFrame, DataFrame]:
    """(check rows, scorecard) of ``nist`` or ``owasp``."""
    if framework == "nist":
        return nist_checks(files), nist_scorecard(files)
    if framework == "owasp":
        return owasp_categories(files), owasp_scorecard(files)
    raise ValueError(f"unknown framework {framework!r}; choose 'nist' or 'owasp'")
