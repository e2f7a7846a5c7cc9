"""The row-wise checks on a stream of landed artifacts.

They keep no state, so the batch operators take a streaming table unchanged.
Checks that need a whole file or target (copies, statistics, presence) stay
batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions.paths import named
from hubwarden.operators import findings, poisoning, project, supply_chain
from hubwarden.operators.provenance import DATA_GLOBS
from hubwarden.sources.text import to_text


def watch(artifacts: DataFrame, max_bytes: int = rules.MAX_TEXT_BYTES) -> DataFrame:
    """Findings from a (streaming) landed ``artifacts`` table with ``content``."""
    texts = to_text(artifacts.where("is_file"))
    found = findings.unite(
        [
            poisoning.size_gate(artifacts.where(F.col("is_file") & named(DATA_GLOBS)), max_bytes),
            poisoning.poisoned_texts(texts.where(named(DATA_GLOBS))),
            project.script_and_config_findings(texts),
            project.env_findings(texts),
            supply_chain.deployment_findings(texts),
        ]
    )
    return findings.attach_attack_label(found)
