"""Supply-chain checks: base model, training record, deployment, model card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions import jsonv
from hubwarden.functions.paths import at_root
from hubwarden.functions.text import contains_any, once, words_missing
from hubwarden.operators.adapters import CONFIG as ADAPTER_CONFIG
from hubwarden.operators.findings import evidence, findings_from_flags
from hubwarden.operators.project import is_deployment
from hubwarden.operators.provenance import names


def presence_flags() -> list[Column]:
    return [
        F.max(at_root(rules.TRAINING_RECORD_FILES)).alias("has_training_record"),
        F.max(at_root(rules.MODEL_CARD_FILES)).alias("has_model_card"),
    ]


def presence_findings(flags: DataFrame) -> DataFrame:
    return findings_from_flags(
        flags,
        [
            (
                "missing_training_record",
                ~F.col("has_training_record"),
                F.lit("No training record, so training settings cannot be audited"),
                evidence(searched=names(rules.TRAINING_RECORD_FILES)),
            ),
            (
                "missing_model_card",
                ~F.col("has_model_card"),
                F.lit("No model card: abilities, limits and training data are undocumented"),
                evidence(searched=names(rules.MODEL_CARD_FILES)),
            ),
        ],
    )


def names_base_model(name: Column, text: Column) -> Column:
    """Whether a model or adapter config states its base model."""
    v = jsonv.parse(text)
    model = jsonv.truthy(jsonv.member(v, "_name_or_path", "base_model"))
    adapter = jsonv.truthy(jsonv.member(v, "base_model_name_or_path"))
    return F.when(name == ADAPTER_CONFIG, adapter).otherwise(model)


def base_models(targets: DataFrame, texts: DataFrame) -> DataFrame:
    """(target, base_model_known) for every target."""
    configs = texts.where(at_root(["config.json", ADAPTER_CONFIG]))
    known = configs.groupBy("target").agg(F.max(names_base_model(F.col("name"), F.col("text"))).alias("_known"))
    rows = targets.select("target").join(known, "target", "left")
    return rows.select("target", F.coalesce("_known", F.lit(False)).alias("base_model_known"))


def base_model_findings(targets: DataFrame, texts: DataFrame) -> DataFrame:
    return findings_from_flags(
        base_models(targets, texts),
        [
            (
                "unknown_base_model",
                ~F.col("base_model_known"),
                F.lit("No config states the base model, so the model's origin is unknown"),
                evidence(path=F.col("target")),
            )
        ],
    )


def deployment_findings(texts: DataFrame) -> DataFrame:
    body, name = F.col("text"), F.col("name")
    return findings_from_flags(
        texts.where(is_deployment()),
        [
            (
                "root_deployment",
                contains_any(body, rules.ROOT_USER_MARKS),
                F.format_string("Deployment file %s uses the root account", name),
                evidence(file=name),
            ),
            (
                "exposed_port",
                F.contains(body, F.lit(rules.OPEN_BIND_MARK)),
                F.format_string("Deployment file %s binds to 0.0.0.0", name),
                evidence(file=name),
            ),
        ],
        file=F.col("file"),
    )


def card_sections(
    texts: DataFrame, sections: Sequence[str] = rules.MODEL_CARD_SECTIONS
) -> DataFrame:
    """(target, file, missing_sections) of every README.md at a target's root."""
    cards = once(texts.where(at_root(["README.md"])).select("target", "file", "text"), "_body", F.lower("text"))
    cards = once(cards, "missing_sections", words_missing(F.col("_body"), sections))
    return cards.select("target", "file", "missing_sections")


def card_findings(texts: DataFrame) -> DataFrame:
    absent = F.col("missing_sections")
    return findings_from_flags(
        card_sections(texts),
        [
            (
                "incomplete_model_card",
                F.size(absent) > 0,
                F.concat(F.lit("Model card lacks sections: "), F.array_join(absent, ", ")),
                evidence(missing_sections=absent),
            )
        ],
    )

