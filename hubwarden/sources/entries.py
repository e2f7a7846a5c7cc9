"""Training entries from JSON and JSONL texts, and from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden.functions import jsonv
from hubwarden.functions.text import once

# A larger VARIANT could come back as NULL, which would look like a malformed file.
_DOCUMENT_LIMIT = 100 * 1024 * 1024
_BLANK = r"(?U)^\s*$"


def allow_repeated_keys(spark) -> None:
    """Accept JSON objects that repeat a key (the last one counts)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_entries(texts: DataFrame, keys: Sequence[str] = ("target", "file"), text: str = "text") -> DataFrame:
    """(keys, pos, v): one row per element of a JSON list, or one row for any other document.

    A document too large for one value has no rows here; ``is_oversized`` tells.
    """
    keys = list(keys)
    body = F.col("_t")
    value = F.when(F.octet_length(body) <= _DOCUMENT_LIMIT, jsonv.parse(jsonv.tagged(body)))
    parsed = once(texts.select(*keys, F.col(text).alias("_t")), "_v", value)
    parsed = parsed.where(F.col("_v").isNotNull())
    # NULL for anything but a list; a list of lists is a list of values here
    elements = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    items = F.posexplode_outer(F.coalesce(elements, F.array("_v"))).alias("pos", "v")
    return parsed.select(*keys, items).where(F.col("pos").isNotNull())


def is_oversized(name: Column, text: Column) -> Column:
    """Whether a .json text is too large for one value."""
    return F.endswith(name, F.lit(".json")) & (F.octet_length(text) > _DOCUMENT_LIMIT)


def jsonl_entries(texts: DataFrame, keys: Sequence[str] = ("target", "file"), text: str = "text") -> DataFrame:
    """(keys, pos, v): one row per line; a file with one malformed line has no entries.

    A file is one row here, so its validity needs no shuffle.
    """
    keys = list(keys)
    lines = F.filter(F.split("_t", "\n"), lambda x: ~x.rlike(_BLANK))
    rows = once(texts.select(*keys, F.col(text).alias("_t")), "_vs", F.transform(lines, lambda x: F.try_parse_json(jsonv.tagged(x))))
    rows = rows.where(~F.exists("_vs", lambda v: v.isNull()))
    return rows.select(*keys, F.posexplode("_vs").alias("pos", "v"))


def entries_of_lines(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """JSONL that was read line by line (``spark.read.text``), for files too large for one row.

    Validity of a file is a combined aggregate; its lines are then kept or
    dropped by a join on the file.
    """
    keys = list(keys)
    body = F.col(line)
    parsed = lines.where(~body.rlike(_BLANK)).withColumn("v", F.try_parse_json(jsonv.tagged(body))).drop(line)
    broken = parsed.groupBy(*keys).agg(F.max(F.col("v").isNull()).alias("_broken")).where("_broken").select(*keys)
    return parsed.join(broken, keys, "left_anti")


def measured_text(v: Column) -> Column:
    """The text the statistics measure, or NULL when the entry is not measured.

    The first *present* key of ``content`` and ``text`` decides: an object with
    neither counts as empty text, one whose value is no string is skipped.
    """
    value = jsonv.member(v, "content", "text")
    chosen = F.when(value.isNull(), F.lit("")).otherwise(jsonv.as_string(value))
    return F.when(jsonv.is_object(v), chosen)


def with_values(rows: DataFrame, applies: Column) -> DataFrame:
    """Add ``values`` (the entries of a piece of a .json or .jsonl file), ``broken`` and ``oversized``.

    ``rows``: pieces with name, kind and text.  A broken piece has no entries
    and neither has its file; a document too large for one value is oversized.
    """
    name, body, sliced = F.col("name"), F.col("text"), F.col("kind") == "slice"
    is_json, is_lines = applies & F.endswith(name, F.lit(".json")), applies & F.endswith(name, F.lit(".jsonl"))
    large = F.octet_length(body) > _DOCUMENT_LIMIT
    tagged = jsonv.tagged(F.when(sliced, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body))
    rows = once(rows, "_json", F.when(is_json & ~large & F.col("kind").isin("whole", "slice"), jsonv.parse(tagged)))
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(_BLANK))
    rows = once(rows, "_lines", F.when(is_lines, F.transform(lines, lambda x: F.try_parse_json(jsonv.tagged(x)))))
    elements = F.try_variant_get("_json", "$", "array<variant>")
    part = (is_json | is_lines) & (F.col("kind") == "part")
    broken = part | F.coalesce(F.exists("_lines", lambda v: v.isNull()), F.lit(False)) | (is_json & body.isNotNull() & F.col("_json").isNull())
    values = F.when(is_json, F.coalesce(elements, F.array("_json"))).when(is_lines, F.col("_lines"))
    rows = rows.withColumns({"broken": broken, "oversized": F.coalesce((is_json & large) | part, F.lit(False))})
    return rows.withColumn("values", F.when(~F.col("broken") & body.isNotNull(), values)).drop("_json", "_lines")


def description(v: Column, applies: Column) -> list[Column]:
    """entry_key, role and measured of a parsed entry, NULL where ``applies`` is false."""
    role = F.when(jsonv.is_object(v), jsonv.as_string(jsonv.member(v, "role")))
    return [
        F.when(applies, jsonv.canonical_key(v)).alias("entry_key"),
        F.when(applies, role).alias("role"),
        F.when(applies, measured_text(v)).alias("measured"),
    ]


def describe_entries(entries: DataFrame, keys: Sequence[str] = ("target", "file")) -> DataFrame:
    """(keys, pos, entry_key, role, measured) of parsed entries."""
    return entries.select(*keys, "pos", *description(F.col("v"), F.lit(True)))


def dataset_entries(texts: DataFrame) -> DataFrame:
    """Described entries of all .json and .jsonl dataset texts."""
    name = F.col("name")
    found = json_entries(texts.where(F.endswith(name, F.lit(".json")))).unionByName(
        jsonl_entries(texts.where(F.endswith(name, F.lit(".jsonl"))))
    )
    return describe_entries(found)
