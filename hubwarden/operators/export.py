"""Findings as access-policy rules and as taxonomy events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions import scores
from hubwarden.functions.text import contains_any, once
from hubwarden.operators.findings import scan_summary


def denied_tools(findings: DataFrame) -> DataFrame:
    """Distinct (target, tool) that the findings speak against.

    Each finding's tools are derived in its own row; no keyword table is
    joined, and repeats combine before the shuffle.
    """
    check, detail = F.lower("check"), F.lower("detail")
    severe = F.col("severity").isin("critical", "high")
    text = F.concat_ws(" ", check, detail)
    named = F.array_compact(
        F.array(*[F.when(severe & contains_any(text, words), F.lit(tool)) for tool, words in rules.DENY_WORDS.items()])
    )
    empty = F.array().cast("array<string>")
    listed = F.regexp_extract_all(detail, F.lit(f"({'|'.join(rules.SUSPICIOUS_MODULES)})"), F.lit(1))
    worded = F.filter(
        F.split(detail, r"[:\s,]+"),
        lambda w: F.endswith(w, F.lit(rules.MODULE_SUFFIXES[0]))
        | F.endswith(w, F.lit(rules.MODULE_SUFFIXES[1]))
        | F.endswith(w, F.lit(rules.MODULE_SUFFIXES[2])),
    )
    modules = F.when(F.size(listed) > 0, listed).when(F.contains(detail, F.lit("target_modules")), worded)
    adapter = F.contains(check, F.lit("lora")) | F.contains(detail, F.lit("suspicious modules"))
    shell = F.contains(check, F.lit("exec")) | F.contains(detail, F.lit("subprocess"))
    tools = F.concat(
        named,
        F.when(adapter, F.coalesce(modules, empty)).otherwise(empty),
        F.when(shell, F.array(*[F.lit(t) for t in rules.SHELL_TOOLS])).otherwise(empty),
    )
    return once(findings, "_tools", tools).select("target", F.explode("_tools").alias("tool")).distinct()


def policy_rules(
    findings: DataFrame, targets: DataFrame | None = None, allowed: Sequence[str] = rules.ALLOWED_TOOLS
) -> DataFrame:
    """(target, action, tool). A denied tool may still be on the allow list; deny wins downstream."""
    every = (findings if targets is None else targets).select("target").distinct()
    allow = every.select(
        "target", F.lit("allow").alias("action"), F.explode(F.array(*[F.lit(t) for t in allowed])).alias("tool")
    )
    deny = denied_tools(findings).select("target", F.lit("deny").alias("action"), "tool")
    return allow.unionByName(deny)


def rate_limits(findings: DataFrame, targets: DataFrame | None = None, limit: int = 100) -> DataFrame:
    summary = scan_summary(findings, targets)
    return summary.select("target", "risk_score", scores.rate_limit(F.col("risk_score"), limit).alias("rate_limit"))


def taxonomy_events(
    findings: DataFrame,
    severity_weights: dict[str, int] | None = None,
    confidence_scores: dict[str, float] | None = None,
) -> DataFrame:
    """One event per finding.

    With both maps given (severity -> weight, confidence -> score in 0..1) a
    ``risk_score`` column is added.
    """
    proof = F.col("evidence")
    severity = F.when(F.col("severity").isin(*rules.SEVERITIES), F.col("severity")).otherwise(F.lit("medium"))
    confidence = scores.lookup(rules.CONFIDENCES, severity, "MEDIUM")
    events = findings.select(
        F.lit("hubwarden").alias("source"),
        scores.lookup(rules.EVENT_OF_CATEGORY, F.col("category"), "ANOMALY").alias("attack_category"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        scores.lookup(rules.METHOD_OF_CHECK, F.col("check"), "ANOMALY_DETECTOR").alias("detection_method"),
        F.col("check").alias("title"),
        F.col("detail").alias("description"),
        "recommendation",
        F.substring("detail", 1, rules.SNIPPET_LENGTH).alias("snippet"),
        F.coalesce(
            F.get_json_object(proof, "$.file"), F.get_json_object(proof, "$.path"), F.lit("")
        ).alias("target"),
        F.col("target").alias("scan_target"),
    )
    if severity_weights is None or confidence_scores is None:
        return events
    percent = {c: int(s * 100) for c, s in confidence_scores.items()}
    weight = scores.lookup(severity_weights, F.col("severity"), 0)
    return events.withColumn(
        "risk_score", F.floor(weight * scores.lookup(percent, F.col("confidence"), 0) / 25).cast("int")
    )
