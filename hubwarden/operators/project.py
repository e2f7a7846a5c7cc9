"""Training-project checks: scripts, configs, environment files, requirements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.paths import at_root, base_name, named
from hubwarden.functions.text import any_of, strip
from hubwarden.operators.findings import count_and_first_n, evidence, finding, label_checks
from hubwarden.operators.patterns import Family, find_rules
from hubwarden.sources.text import text_lines

_FILE = ("target", "file")


def is_script() -> Column:
    return F.endswith("name", F.lit(".py"))


def is_config() -> Column:
    return named(["*.yaml", "*.yml", "training_config.json"])


def is_env() -> Column:
    return at_root([".env", ".env.*"])


def is_requirements() -> Column:
    return at_root(["requirements*.txt", "pyproject.toml"])


def is_deployment() -> Column:
    return named(["deploy*.yaml", "deploy*.json", "Dockerfile", "docker-compose*.yml"])


def text_families(
    loads=rules.UNSAFE_LOADS, imports=rules.SUSPICIOUS_IMPORTS, credentials=rules.CREDENTIALS
) -> list[Family]:
    return [
        Family("unsafe_model_load", loads, "search", is_script()),
        Family("suspicious_import", imports, "literal", is_script()),
        Family("hardcoded_credential", credentials, "search", is_script()),
        Family("credential_in_config", credentials, "search", is_config()),
    ]


def script_and_config_findings(texts: DataFrame, families: Sequence[Family] | None = None) -> DataFrame:
    """All script and config rules from one pass; one finding per (file, rule)."""
    families = text_families() if families is None else families
    return rule_findings(find_rules(texts.where(is_script() | is_config()), "text", families, _FILE), [f.check for f in families])


def rule_findings(hits: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Findings from hits (target, file, check, rule) of script and config rules."""
    check, rule = F.col("check"), F.col("rule")
    detail = (
        F.when(check == "unsafe_model_load", F.format_string("Unsafe model load in %s: %s", base_name(), rule))
        .when(check == "suspicious_import", F.format_string("Suspicious call in %s: %s", base_name(), rule))
        .when(check == "hardcoded_credential", F.format_string("Credential in script %s", base_name()))
        .otherwise(F.format_string("Credential in config %s", base_name()))
    )
    literal = check == "suspicious_import"
    proof = F.to_json(
        F.struct(
            base_name().alias("file"), F.when(literal, rule).alias("import"), F.when(~literal, rule).alias("pattern")
        )
    )
    rows = hits.select("target", "file", "check", detail.alias("detail"), proof.alias("evidence"))
    return label_checks(rows, checks)


def env_assignments(lines: DataFrame, line: str = "line") -> DataFrame:
    """Split ``key=value`` lines; comments and lines without '=' are dropped, quotes removed."""
    body = strip(F.col(line))
    value = F.regexp_extract(body, "(?s)^[^=]*=(.*)$", 1)
    bare = F.regexp_replace(strip(value), "^[\"']+|[\"']+$", "")
    kept = lines.where(~F.startswith(body, F.lit("#")) & F.contains(body, F.lit("=")))
    return kept.withColumns({"key": strip(F.substring_index(body, "=", 1)), "value": bare})


def exposed_secrets(
    lines: DataFrame,
    line: str = "line",
    keys: Sequence[str] = rules.SECRET_KEYS,
    least: int = rules.SECRET_MIN_LENGTH,
) -> DataFrame:
    """Assignments of a known secret name to a value longer than ``least``; the value is dropped."""
    rows = env_assignments(lines, line)
    return rows.where(F.col("key").isin(*keys) & (F.length("value") > least)).drop("value")


def env_findings(texts: DataFrame) -> DataFrame:
    rows = exposed_secrets(text_lines(texts.where(is_env())))
    return finding(
        rows,
        "exposed_secret",
        F.format_string("Secret in %s: %s", base_name(), F.col("key")),
        evidence(file=base_name(), key=F.col("key")),
        F.col("file"),
    )


def is_unpinned(line: Column, pins: Sequence[str] = rules.VERSION_PINS) -> Column:
    """A bare package name of letters only, without a version."""
    return line.rlike(r"^\p{L}+$") & ~any_of(F.contains(line, F.lit(p)) for p in pins)


def unpinned_dependencies(lines: DataFrame, line: str = "line") -> DataFrame:
    """Requirement lines without a version; a line counts as comment only if it starts with '#'."""
    rows = lines.where(~F.startswith(F.col(line), F.lit("#"))).withColumn("package", strip(F.col(line)))
    return rows.where(is_unpinned(F.col("package")))


def requirement_findings(texts: DataFrame, shown: int = 10) -> DataFrame:
    rows = unpinned_dependencies(text_lines(texts.where(is_requirements())))
    rolled = count_and_first_n(rows, _FILE, ["pos"], F.col("package"), shown, "unpinned")
    return finding(
        rolled,
        "unpinned_dependencies",
        F.format_string("%d dependencies without a version in %s", F.col("n_rows"), base_name()),
        evidence(file=base_name(), count=F.col("n_rows"), unpinned=F.col("unpinned")),
        F.col("file"),
    )

