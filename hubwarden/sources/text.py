"""From file bytes to text and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.functions.text import once, unix_newlines


def to_text(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``text`` and ``utf8_ok``.

    Bytes that are not UTF-8 are replaced, never dropped, and line ends become
    ``\\n``.  A file whose content could not be read keeps its row, with NULL
    for both, so that it can be reported.
    """
    raw = F.col("content").cast("string")
    kept = [c for c in files.columns if c not in ("content", "relpath")]
    rows = files.select(
        *kept, F.col("relpath").alias("file"), F.is_valid_utf8(raw).alias("utf8_ok"), raw.alias("_raw")
    )
    # decoded once per row, however many filters look at the text later
    rows = once(rows, "_valid", F.make_valid_utf8("_raw"))
    return once(rows, "text", unix_newlines(F.col("_valid"))).drop("_raw", "_valid")


def utf8_report(files: DataFrame) -> DataFrame:
    """(target, relpath, utf8_ok) of files read with their content."""
    return files.select("target", "relpath", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8_ok"))


def text_lines(texts: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per line: the text's other columns, ``pos`` and ``line``.

    With ``max_bytes`` given, a larger file fails the query instead of being
    split silently.
    """
    rows = texts
    if max_bytes is not None:
        too_big = F.octet_length("text") > max_bytes
        rows = texts.withColumn(
            "text",
            F.when(too_big, F.raise_error(F.concat(F.lit("file over the size limit: "), F.col("file"))))
            .otherwise(F.col("text")),
        )
    others = [c for c in texts.columns if c != "text"]
    # outer: an inner explode would split every text a second time in a derived filter
    lines = rows.select(*others, F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("pos").isNotNull())
