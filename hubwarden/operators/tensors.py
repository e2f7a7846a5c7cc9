"""Checks on adapter tensors: extreme values, touched layers, risk level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.text import contains_any
from hubwarden.functions.paths import base_name
from hubwarden.operators.findings import count_and_first_n, evidence, finding, label_checks

_FILE = ("target", "file")


def max_abs(values: Column) -> Column:
    """Largest magnitude of an array of numbers; NULL when empty, NaN when any is NaN."""
    return F.array_max(F.transform(values, lambda x: F.abs(x)))


def is_extreme(tensor_max: Column, limit: float = rules.WEIGHT_LIMIT) -> Column:
    """A tensor with NaN is not extreme (Spark would sort NaN above every limit)."""
    return F.coalesce((tensor_max > limit) & ~F.isnan(tensor_max), F.lit(False))


def file_flags(tensors: DataFrame, limit: float = rules.WEIGHT_LIMIT, keys: Sequence[str] = _FILE) -> DataFrame:
    """Tensor counts per adapter file, from one combined pass."""
    key = F.lower("key")
    return tensors.groupBy(*keys).agg(
        F.count_if(is_extreme(F.col("max_abs"), limit)).alias("extreme_tensors"),
        F.count_if(F.contains(key, F.lit("embed"))).alias("embed_tensors"),
        F.count_if(F.contains(key, F.lit("lm_head"))).alias("lm_head_tensors"),
        F.count_if(F.col("has_nan")).alias("nan_tensors"),
    )


def detect_lora_backdoors(tensors: DataFrame, limit: float = rules.WEIGHT_LIMIT) -> DataFrame:
    """Extreme tensors (first 10 shown) and changed embedding or head layers (first 5 shown).

    One pass over the tensors: each is tagged with the checks it hits.  Keys are
    judged whether or not the values could be read; a file with tensors or a
    header that couldn't be read is reported by itself.
    """
    read = tensors.where(F.col("key").isNotNull())
    key = F.lower("key")
    tags = F.array(
        F.when(is_extreme(F.col("max_abs"), limit), F.lit("extreme_lora_weights")),
        F.when(F.contains(key, F.lit("embed")), F.lit("lora_embed_modification")),
        F.when(F.contains(key, F.lit("lm_head")), F.lit("lora_lm_head_modification")),
    )
    hits = read.select(*_FILE, "key", "max_abs", F.explode(tags).alias("check")).where(F.col("check").isNotNull())
    shown = F.struct("key", F.bround(F.col("max_abs"), 4).alias("max_abs"))
    rolled = count_and_first_n(hits, [*_FILE, "check"], ["key"], shown, 10, "shown")
    name, check = base_name(), F.col("check")
    extreme = check == "extreme_lora_weights"
    detail = (
        F.when(
            extreme,
            F.format_string(f"Adapter %s holds %d tensors with values over {limit:g}", name, F.col("n_rows")),
        )
        .when(check == "lora_embed_modification", F.format_string("Adapter %s changes embedding layers", name))
        .otherwise(F.format_string("Adapter %s changes lm_head", name))
    )
    proof = evidence(
        file=name,
        extreme_keys=F.when(extreme, F.col("shown")),
        modified_keys=F.when(~extreme, F.slice(F.transform("shown", lambda s: s["key"]), 1, 5)),
    )
    rows = rolled.select("target", "file", "check", detail.alias("detail"), proof.alias("evidence"))
    names = ["extreme_lora_weights", "lora_embed_modification", "lora_lm_head_modification"]
    return label_checks(rows, names).unionByName(unread_tensors(tensors))


def unread_tensors(tensors: DataFrame) -> DataFrame:
    """``unreadable_adapter``: files with tensors or a header that couldn't be read, with how many of each status."""
    bad = tensors.where(F.col("read_status") != "ok").groupBy(*_FILE, "read_status").agg(F.count("*").alias("n"))
    per = bad.groupBy(*_FILE).agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("read_status", "n")))).alias("by")
    )
    return finding(
        per,
        "unreadable_adapter",
        F.format_string("Adapter %s: %d parts could not be read", base_name(), F.col("n")),
        evidence(file=base_name(), statuses=F.col("by")),
        F.col("file"),
    )


def adapter_risk(tensors: DataFrame, targets: DataFrame | None = None, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Layer count and risk level per target; ``unknown`` for targets without a listed layer."""
    keys, key = list(keys), F.lower("key")
    read = tensors.where(F.col("key").isNotNull())
    levels = read.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("layers"),
        F.max(contains_any(key, rules.HIGH_RISK_LAYERS)).alias("_high"),
        F.max(contains_any(key, rules.MEDIUM_RISK_LAYERS)).alias("_medium"),
    )
    if targets is not None:
        levels = targets.select(*keys).distinct().join(levels, keys, "left")
    risk = (
        F.when(F.coalesce("layers", F.lit(0)) == 0, "unknown")
        .when(F.col("_high"), "high")
        .when(F.col("_medium"), "medium")
        .otherwise("low")
    )
    return levels.select(*keys, F.coalesce("layers", F.lit(0).cast("long")).alias("layers"), risk.alias("risk"))


def layer_inventory(tensors: DataFrame) -> DataFrame:
    """(target, key, shape, file) of every listed tensor."""
    return tensors.where(F.col("key").isNotNull()).select("target", "key", "shape", "file")

