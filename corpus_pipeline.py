"""A corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage reads what its predecessor kept and returns the columns of
``documents``; the last returns the tokens.  Every stage's result is written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden.llm import blob_ledger, merge_dropout, parity_join, templates, toxicity
from hubwarden.llm.common import held_out, table
from hubwarden.session import new_folder, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below 0.7, learnt from the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3))
    name = blob_ledger.unused(docs, "toxicity")
    return toxicity.with_score(docs, toxicity.fit(docs, labels), name).where(F.col(name) < 0.7).drop(name)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that is equal for rows alike in id and text only, and its name: ids may be absent or repeat."""
    name = blob_ledger.unused(docs, "row_key")
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, a null one last; of rows alike in id and text, any.

    Texts without words are no copies of anything.
    """
    keyed, row = with_row_key(docs)
    found = parity_join.jaccard_components(keyed, key=row).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    each = found.where("n_shingles > 0").groupBy(row, "component_id").agg(F.count("*").alias("copies"))
    ids = keyed.select(row, "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row, "copies")
    first = each.join(ids, row).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = stage(each.join(first, "component_id").select(row, (F.col(row) == F.col(f"first.{row}")).alias("_kept"), "copies"), "verdicts")
    left = keyed.join(kept.where("NOT _kept"), row, "left_anti")
    if kept.where("_kept AND copies > 1").isEmpty():
        return left.select(*docs.columns)
    # rows that repeat id and text: one of them stays
    again = kept.where("_kept AND copies > 1").select(row)
    once = left.join(again, row, "left_semi").dropDuplicates([row])
    return left.join(again, row, "left_anti").unionByName(once).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, each row judged by its own text."""
    keyed, row = with_row_key(docs)
    found = templates.leaks(keyed, table(spark, sf_dir, "benchmark"), key=row).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``<secret>`` in place of each secret."""
    ledger = new_folder(spark, "ledger")
    blob_ledger.scan_new_blobs(docs, ledger)
    return blob_ledger.redact(docs, ledger, n_chars="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless, ids) of every document; few splits are kept, the earlier stages hold memory too."""
    return merge_dropout.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), cache=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: SQL expresses neither the fitted scores nor the segmentation; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
