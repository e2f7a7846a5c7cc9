"""Profiles of training data over a stream of landed artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hubwarden.functions.paths import named
from hubwarden.operators.dataset_stats import entry_facts
from hubwarden.operators.profile_store import save_counts
from hubwarden.operators.provenance import DATA_GLOBS
from hubwarden.sources.entries import description, with_values
from hubwarden.sources.pieces import WHOLE
from hubwarden.sources.text import to_text


def entry_rows(artifacts: DataFrame) -> DataFrame:
    """Facts of the entries of landed data files, and a ``broken`` row for each malformed one.

    A row lands a whole file, or whole lines of one where a column ``kind``
    says so (``lines``); lines of a file may land in any batches.
    """
    kind = F.col("kind") if "kind" in artifacts.columns else F.lit(WHOLE)
    rows = to_text(artifacts.where(F.col("is_file") & named(DATA_GLOBS)).withColumn("kind", kind))
    rows = with_values(rows, F.lit(True)).select("target", "file", "broken", F.explode_outer("values").alias("v"))
    rows = rows.where("broken OR v IS NOT NULL").select("target", "file", "broken", *description(F.col("v"), ~F.col("broken")))
    return entry_facts(rows, ["target", "file", "broken"])


def keep_profiles(artifacts: DataFrame, path: str) -> DataStreamWriter:
    """Writer that adds each batch's entries to the table at ``path``; ``profile_store.stored_profile`` reads it.

    A batch that Spark repeats after a failure replaces what it had written.
    One stream writes to a table, since runs are numbered by its batches.
    """

    def save(batch: DataFrame, number: int) -> None:
        save_counts(entry_rows(batch), path, number)

    return artifacts.writeStream.foreachBatch(save)
