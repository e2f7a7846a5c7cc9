"""Severity look-ups and bands as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubwarden import rules


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small fixed table, evaluated in the projection (no join)."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup({s: i for i, s in enumerate(rules.SEVERITIES)}, severity, 99)


def risk_weight(severity: Column) -> Column:
    return lookup(rules.RISK_WEIGHTS, severity, 0)


def trust_penalty(severity: Column) -> Column:
    return lookup(rules.TRUST_PENALTIES, severity, 0)


def risk_band(score: Column) -> Column:
    band = F.lit("low")
    for floor, label in reversed(rules.RISK_BANDS):
        band = F.when(score >= floor, label).otherwise(band)
    return band


def rate_limit(score: Column, limit: int = 100) -> Column:
    """Allowed requests, fewer the higher the risk score."""
    allowed = F.lit(limit)
    for floor, divisor, least in reversed(rules.RATE_TIERS):
        allowed = F.when(score >= floor, F.lit(max(least, limit // divisor))).otherwise(allowed)
    return allowed


def gate_verdict(critical: Column, high: Column) -> Column:
    """2 = block, 1 = review, 0 = pass."""
    return F.when(critical > 0, 2).when(high > 0, 1).otherwise(0)


def redact(text: Column) -> Column:
    for pattern, shown in rules.REDACTIONS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def redact_evidence(evidence: Column) -> Column:
    """Redact the top-level string values of a JSON object; nested values stay."""
    members = F.try_variant_get(F.try_parse_json(evidence), "$", "map<string,variant>")
    cleaned = F.transform_values(
        members,
        lambda _, v: F.when(
            F.schema_of_variant(v) == "STRING", redact(F.try_variant_get(v, "$", "string")).cast("variant")
        ).otherwise(v),
    )
    return F.coalesce(F.to_json(F.to_variant_object(cleaned)), evidence)
