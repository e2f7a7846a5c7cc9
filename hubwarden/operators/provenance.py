"""Where a dataset came from: provenance files, cards, checksums, source links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions import jsonv
from hubwarden.functions.paths import at_root
from hubwarden.functions.text import any_of, once
from hubwarden.operators.findings import evidence, finding, findings_from_flags, unite

DATA_GLOBS = ("*.json", "*.jsonl", "*.csv")


def names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def presence_flags() -> list[Column]:
    """Per-target aggregates the presence checks need (one pass over the listing)."""
    return [
        F.max(at_root(rules.PROVENANCE_FILES)).alias("has_provenance"),
        F.max(at_root(rules.DATASET_CARD_FILES)).alias("has_dataset_card"),
        F.max(at_root(rules.CHECKSUM_FILES)).alias("has_checksums"),
        F.count_if(at_root(DATA_GLOBS)).alias("data_files"),
    ]


def presence_findings(flags: DataFrame) -> DataFrame:
    files = F.col("data_files")
    return findings_from_flags(
        flags,
        [
            (
                "missing_provenance",
                ~F.col("has_provenance"),
                F.lit("No provenance file, so the dataset's origin cannot be verified"),
                evidence(searched=names(rules.PROVENANCE_FILES)),
            ),
            (
                "missing_dataset_card",
                ~F.col("has_dataset_card"),
                F.lit("No dataset card: contents and limits are undocumented"),
                evidence(searched=names(rules.DATASET_CARD_FILES)),
            ),
            (
                "missing_checksum_manifest",
                ~F.col("has_checksums") & (files > 0),
                F.format_string("No checksum list covers the %d dataset files", files),
                evidence(data_files=files),
            ),
        ],
    )


def provenance_status(texts: DataFrame, required: Sequence[str] = rules.PROVENANCE_KEYS) -> DataFrame:
    """(target, file, readable, missing_fields) of every provenance file.

    A key that is present with a null value is not missing.
    """
    v = F.col("_v")
    absent = F.array_compact(
        F.array(*[F.when(jsonv.member(v, k).isNull(), F.lit(k)) for k in required])
    )
    rows = once(texts.where(at_root(rules.PROVENANCE_FILES)), "_v", jsonv.parse(F.col("text")))
    return rows.select("target", "file", v.isNotNull().alias("readable"), absent.alias("missing_fields"))


def provenance_findings(texts: DataFrame) -> DataFrame:
    absent = F.col("missing_fields")
    return findings_from_flags(
        provenance_status(texts),
        [
            (
                "corrupt_provenance",
                ~F.col("readable"),
                F.format_string("Provenance file %s cannot be read", F.col("file")),
                evidence(file=F.col("file")),
            ),
            (
                "incomplete_provenance",
                F.col("readable") & (F.size(absent) > 0),
                F.format_string("Provenance lacks: %s", F.array_join(absent, ", ")),
                evidence(file=F.col("file"), missing_fields=absent),
            ),
        ],
        file=F.col("file"),
    )


_LEVELS = 1100  # the JSON reader refuses documents that are nested 1,000 deep
_UNBOUNDED = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.variant.allowDuplicateKeys": "true"}

# The frontier: objects none of whose keys is filled are opened one level further.
_DESCENT = f"""
WITH RECURSIVE open (target, file, node, link) MAX RECURSION LEVEL {_LEVELS} AS (
    SELECT target, file, node, {{link}} FROM {{roots}}
    UNION ALL
    SELECT target, file, node, {{link}} FROM (
        SELECT o.target, o.file, c.value AS node FROM open o, LATERAL variant_explode(o.node) c
        WHERE o.link IS NULL AND startswith(schema_of_variant(c.value), 'OBJECT'))
)
SELECT target, file, link.key, link.url FROM open WHERE link IS NOT NULL"""


def _mentions(keys: Sequence[str]) -> Column:
    """Whether a text is an object that may hold one of the keys, escaped ones included."""
    body = F.col("text")
    named = any_of([F.contains(body, F.lit(f'"{k}"')) for k in keys] + [F.contains(body, F.lit("\\u"))])
    return F.startswith(F.ltrim(F.translate(body, "\t\r\n", "   ")), F.lit("{")) & named


def source_links(texts: DataFrame, keys: Sequence[str] = rules.SOURCE_URL_KEYS) -> DataFrame:
    """(target, file, key, url) of every link in a JSON document that is not HTTP(S).

    In each object the first filled key decides; only objects without one are
    searched further, to any depth; lists are not entered.  The objects still
    open are the frontier of a recursive query, which ends with the first level
    that has none: documents of usual depth take few levels, and each level is
    spread over all tasks.  Documents that the JSON reader refuses are left to
    ``deep_documents``.
    """
    spark = texts.sparkSession
    for name, value in _UNBOUNDED.items():
        spark.conf.set(name, value)
    roots = texts.where(_mentions(keys)).select("target", "file", jsonv.parse(F.col("text")).alias("node"))
    roots = roots.where(F.startswith(F.schema_of_variant("node"), F.lit("OBJECT")))
    link = " ".join(f"WHEN {_filled(k)} THEN named_struct('key', '{k}', 'url', {_at(k, 'string')})" for k in keys)
    found = spark.sql(_DESCENT.replace("{link}", f"CASE {link} END"), roots=roots)
    return found.where(~any_of([F.startswith(F.col("url"), F.lit(s)) for s in rules.URL_SCHEMES]))


def _at(key: str, kind: str) -> str:
    value = f"try_variant_get(node, '$.{key}', '{kind}')"
    # objects and lists have no string form but their JSON
    return f"coalesce({value}, to_json(try_variant_get(node, '$.{key}', 'variant')))" if kind == "string" else value


def _filled(key: str) -> str:
    """Neither absent nor null, '', 0, false or an empty container."""
    shown = f"to_json({_at(key, 'variant')})"
    zero = f"coalesce({_at(key, 'double')} = 0 AND NOT startswith({shown}, '\"'), false)"
    return f"({shown} IS NOT NULL AND {shown} NOT IN ('null', '\"\"', 'false', '[]', '{{{{}}}}') AND NOT {zero})"


def deep_documents(texts: DataFrame, keys: Sequence[str] = rules.SOURCE_URL_KEYS, depth: int = 1000) -> DataFrame:
    """(target, file) of documents that name a key, open ``depth`` objects or more and cannot be parsed.

    They are malformed or nested too deep for the JSON reader; either way their links were not looked at.
    """
    body = F.col("text")
    braces = F.length(body) - F.length(F.replace(body, F.lit("{"), F.lit("")))
    return texts.where(_mentions(keys) & (braces >= depth) & jsonv.parse(body).isNull()).select("target", "file")


def source_url_findings(texts: DataFrame) -> DataFrame:
    own = texts.where(at_root(["*.json"]))
    bad = finding(
        source_links(own),
        "invalid_source_url",
        F.format_string("Source link in %s is not HTTP(S): %s", F.col("file"), F.col("url")),
        evidence(file=F.col("file"), key=F.col("key"), url=F.col("url")),
        F.col("file"),
    )
    unread = finding(
        deep_documents(own),
        "oversized_document",
        F.format_string("%s is malformed or nested too deep: its source links aren't checked", F.col("file")),
        evidence(file=F.col("file")),
        F.col("file"),
    )
    return unite([bad, unread])
