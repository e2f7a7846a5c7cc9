"""Adapter configuration checks: target modules, base model, rank, file sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions import jsonv
from hubwarden.functions.text import once, words_found
from hubwarden.operators.findings import evidence, findings_from_flags, unite

CONFIG = "adapter_config.json"


def locate_config(files: DataFrame) -> DataFrame:
    """(target, relpath, depth) of the config at the root, else in the first subdirectory by name."""
    found = files.where((F.col("name") == CONFIG) & (F.col("depth") <= 1))
    first = found.groupBy("target").agg(F.min(F.struct("depth", "relpath")).alias("_at"))
    return first.select("target", "_at.relpath", "_at.depth")


def config_fields(configs: DataFrame, text: str = "text") -> DataFrame:
    """Parse adapter configs into columns; all other columns of the input stay.

    A scalar string under ``target_modules`` is one module; a rank or alpha
    given as text counts as absent.
    """
    v = F.col("_v")
    modules = jsonv.member(v, "target_modules")
    listed = F.try_variant_get(modules, "$", "array<string>")
    single = F.array(jsonv.as_string(modules))
    parsed = once(configs, "_v", jsonv.parse(F.col(text)))
    return parsed.select(
        *configs.columns,
        v.isNotNull().alias("readable"),
        F.coalesce(
            F.when(jsonv.is_array(modules), listed).when(jsonv.as_string(modules).isNotNull(), single),
            F.array().cast("array<string>"),
        ).alias("target_modules"),
        jsonv.truthy(jsonv.member(v, "base_model_name_or_path")).alias("has_base_model"),
        F.coalesce(jsonv.as_number(jsonv.member(v, "r", "rank")), F.lit(0.0)).alias("rank"),
        F.coalesce(jsonv.as_number(jsonv.member(v, "lora_alpha")), F.lit(0.0)).alias("alpha"),
    )


def suspicious_modules(modules: Column, listed: Sequence[str] = rules.SUSPICIOUS_MODULES) -> Column:
    """Order and repeats of the adapter's own list are kept."""
    return F.filter(modules, lambda m: m.isin(*listed))


def uncommon_modules(
    modules: Column,
    safe: Sequence[str] = rules.SAFE_MODULES,
    listed: Sequence[str] = rules.SUSPICIOUS_MODULES,
) -> Column:
    return F.filter(modules, lambda m: ~m.isin(*safe, *listed))


def lora_scale(alpha: Column, rank: Column) -> Column:
    return F.when((alpha > 0) & (rank > 0), alpha / rank)


def config_findings(
    configs: DataFrame, rank_limit: float = rules.RANK_LIMIT, scale_limit: float = rules.SCALE_LIMIT
) -> DataFrame:
    """``configs``: one row per target from ``config_fields`` with its depth.

    Rank and scale are judged for a config at the target's root only.
    """
    readable, root = F.col("readable"), F.col("depth") == 0
    modules, rank, alpha = F.col("target_modules"), F.col("rank"), F.col("alpha")
    bad, odd = suspicious_modules(modules), uncommon_modules(modules)
    scale = lora_scale(alpha, rank)
    return findings_from_flags(
        configs,
        [
            (
                "corrupt_adapter_config",
                ~readable,
                F.format_string("%s cannot be read", F.col("file")),
                evidence(file=F.col("file")),
            ),
            (
                "suspicious_target_modules",
                readable & (F.size(bad) > 0),
                F.concat(F.lit("Adapter has suspicious modules: "), F.array_join(bad, ", ")),
                evidence(target_modules=modules, suspicious=bad),
            ),
            (
                "uncommon_target_modules",
                readable & (F.size(odd) > 0),
                F.concat(F.lit("Adapter has uncommon modules: "), F.array_join(odd, ", ")),
                evidence(modules=odd),
            ),
            (
                "missing_base_model",
                readable & ~F.col("has_base_model"),
                F.lit("Adapter config names no base model"),
                evidence(config_file=F.col("file")),
            ),
            (
                "high_lora_rank",
                readable & root & (rank > rank_limit),
                F.format_string("Adapter rank is %.0f, as high as in full tuning", rank),
                evidence(rank=rank),
            ),
            (
                "high_lora_scale",
                readable & root & F.coalesce(scale > scale_limit, F.lit(False)),
                F.format_string("Adapter alpha/rank is %.1f", scale),
                evidence(alpha=alpha, rank=rank, scale=F.bround(scale, 2)),
            ),
        ],
        file=F.col("file"),
    )


def adapter_size_findings(
    files: DataFrame, most: int = rules.ADAPTER_MAX_BYTES, least: int = rules.ADAPTER_MIN_BYTES
) -> DataFrame:
    """From the listing alone; no adapter is opened."""
    size, mb = F.col("size"), F.col("size") / 1e6
    adapters = files.where(F.col("name").isin("adapter_model.safetensors", "adapter_model.bin"))
    return findings_from_flags(
        adapters,
        [
            (
                "oversized_adapter",
                size > most,
                F.format_string("Adapter %s is unusually large (%.1fMB)", F.col("name"), mb),
                evidence(file=F.col("name"), size_mb=F.bround(mb, 1)),
            ),
            (
                "undersized_adapter",
                size < least,
                F.format_string("Adapter %s is unusually small (%d bytes)", F.col("name"), size),
                evidence(file=F.col("name"), size_bytes=size),
            ),
        ],
        file=F.col("relpath"),
    )


def is_model_config() -> Column:
    name = F.col("name")
    return F.endswith(name, F.lit(".json")) & (
        F.contains(F.lower(name), F.lit("adapter")) | (name == "config.json")
    )


def config_keyword_findings(texts: DataFrame, keywords: Sequence[str] = rules.CONFIG_KEYWORDS) -> DataFrame:
    """One finding per adapter or model config that mentions trigger words."""
    name, words = F.col("name"), F.col("_words")
    rows = once(texts.where(is_model_config()), "_body", F.lower("text"))
    rows = once(rows, "_words", words_found(F.col("_body"), keywords))
    return findings_from_flags(
        rows,
        [
            (
                "trigger_keywords_in_config",
                F.size(words) > 0,
                F.format_string("Config %s mentions: %s", name, F.array_join(words, ", ")),
                evidence(file=name, keywords=words),
            )
        ],
        file=F.col("file"),
    )


def analyze_lora(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Config and size checks. ``texts`` must hold the adapter configs' text."""
    at = locate_config(files).withColumnRenamed("relpath", "file")
    body = texts.where((F.col("name") == CONFIG) & (F.col("depth") <= 1)).select("target", "file", "text")
    configs = config_fields(at.join(body, ["target", "file"]))
    return unite([config_findings(configs), adapter_size_findings(files)])
