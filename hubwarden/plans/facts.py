"""Everything a scan derives from texts, from one read of each file.

``text_facts`` turns the pieces of all wanted files into rows of facts: one row
per piece (was it read, is it UTF-8, which rules hit, the text itself where a
check looks at the whole document) and one per training entry (its key, role,
length and entropy).  The checks then filter facts; they never open a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.paths import at_root
from hubwarden.functions.text import once
from hubwarden.operators import adapters, dataset_stats, poisoning, project, provenance, rule_table
from hubwarden.operators.patterns import with_hits
from hubwarden.sources import entries, text

_FILE = ("target", "file")


def documents(manifest_names=rules.MANIFEST_FILES) -> dict[str, Column]:
    """Files whose whole text some check looks at, by scan type."""
    return {
        "dataset": at_root(rules.PROVENANCE_FILES),
        "lora": (F.col("name") == adapters.CONFIG) & (F.col("depth") <= 1) | adapters.is_model_config(),
        "weights": at_root([*manifest_names, rules.FINGERPRINT_FILE]),
        "pipeline": project.is_env() | project.is_requirements() | project.is_deployment() | at_root(["README.md", "config.json", adapters.CONFIG]),
    }


def wanted(manifest_names=rules.MANIFEST_FILES) -> dict[str, Column]:
    """Files that are read at all but for datasets, by scan type."""
    found = documents(manifest_names)
    return {**found, "pipeline": found["pipeline"] | project.is_script() | project.is_config()}


def text_facts(pieces: DataFrame, kept: Column, more_rules: DataFrame | None = None) -> DataFrame:
    """Facts of the pieces (target, relpath, name, depth, size, is_dataset, piece, kind, content).

    ``pos`` 0 is the row of a piece, its entries follow from 1 on.  ``kept``:
    condition on files whose text stays; so does that of JSON objects at a
    target's root, in which links are looked for.  ``more_rules``: a table of
    further rules (``operators.rule_table``) for the checks of the families.
    """
    rows = text.to_text(pieces)
    families = [f._replace(applies=F.col("is_dataset")) for f in poisoning.text_families()] + project.text_families()
    rows = with_hits(rows, "text", families)
    if more_rules is not None:
        rows = _with_more_hits(rows, more_rules, families)
    rows = entries.with_values(rows, F.col("is_dataset"))
    # a root object may hold links, whatever else it is
    links = at_root(["*.json"]) & F.startswith(F.ltrim(F.translate("text", "\t\r\n", "   ")), F.lit("{")) & (F.col("kind") == "whole")
    marker = F.array(F.lit(None).cast("variant"))
    each = rows.withColumn("kept", kept | links).select(
        "*", F.posexplode(F.concat(marker, F.coalesce("values", F.array().cast("array<variant>")))).alias("pos", "v")
    )
    first = F.col("pos") == 0
    described = each.select(
        "target",
        "file",
        "name",
        "depth",
        "size",
        "is_dataset",
        "piece",
        "pos",
        F.col("text").isNotNull().alias("read_ok"),
        "utf8_ok",
        "broken",
        "oversized",
        F.when(first, F.col("hits")).alias("hits"),
        F.when(first & F.col("kept"), F.col("text")).alias("text"),
        *entries.description(F.col("v"), ~first),
    )
    facts = [c for c in described.columns if c not in ("entry_key", "role", "measured")]
    return dataset_stats.entry_facts(described, facts)


def _with_more_hits(rows: DataFrame, more_rules: DataFrame, families) -> DataFrame:
    known = [f.check for f in families]
    strange = more_rules.where(~F.col("check").isin(known)).select("check").first()
    if strange is not None:
        raise ValueError(f"no text check is called {strange.check}; these are: {', '.join(known)}")
    found = rule_table.with_hits(rows, "text", more_rules, rule_table.conditions(families), "_more")
    # a rule that a family has too counts once
    both = F.array_distinct(F.concat(F.coalesce("hits", F.slice("_more", 1, 0)), F.coalesce("_more", F.slice("hits", 1, 0))))
    return found.withColumn("hits", both).drop("_more")


def rule_hits(facts: DataFrame) -> DataFrame:
    """(target, file, name, check, rule, matches) of each file, over all its pieces."""
    rows = facts.where("pos = 0 AND size(hits) > 0").select(*_FILE, F.explode("hits").alias("h")).select(*_FILE, "h.*")
    counted = poisoning.COUNTED
    return rows.groupBy(*_FILE, "check", "rule").agg(
        F.when(F.col("check").isin(*counted), F.sum("matches")).otherwise(F.lit(1).cast("long")).alias("matches")
    )


def gates(facts: DataFrame) -> DataFrame:
    """(target, file, name, is_dataset, utf8_ok, read_ok, oversized, broken) per file."""
    return facts.where("pos = 0").groupBy(*_FILE, "name", "depth", "is_dataset").agg(
        F.min("utf8_ok").alias("utf8_ok"),
        F.min("read_ok").alias("read_ok"),
        F.max("oversized").alias("oversized"),
        F.max("broken").alias("broken"),
    )


def entries_of(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The entry rows of ``files`` (target, file)."""
    return facts.where("pos > 0").join(files.select(*_FILE), list(_FILE), "left_semi")
