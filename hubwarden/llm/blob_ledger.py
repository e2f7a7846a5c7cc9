"""Secret scans with an incremental ledger of content-addressed blobs.

A version of a file is addressed by the SHA-256 of its text.  The ledger keeps,
for every blob, which versions of which rules have read it and what they found.
A run scans each distinct blob once, with only the rules whose present version
hasn't read it, appends what it found in one write, and joins the findings of
the ledger back to every path that holds the blob.

Texts are grouped by their hash before the scan, combined on the map side, so a
blob that a third of all paths share is scanned once; what is joined back to
its many paths is one row of digests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden.llm.common import per_stage
_LEDGER = "blob binary, rules array<string>, found array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """All leftmost matches of ``pattern``, kept where group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        flags = re.ASCII | (re.IGNORECASE if self.any_case else 0)
        for m in re.finditer(self.pattern, text, flags):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


# The three base kinds in their listed order, then public token formats.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


def blob_id(text: Column) -> Column:
    """Content address of a text; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (blob, rules, found) of a ledger; none where there is no ledger yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(folder)


def _scan(rules: tuple[Rule, ...]):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("found", pa.list_(span))])
    known = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        for batch in batches:
            found = []
            wanted = batch.column("rules").to_pylist()
            for text, names in zip(batch.column("text"), wanted):
                t = text.as_py() or ""
                found.append([{"kind": known[n].kind, "start": a, "end": b} for n in names for a, b in known[n].spans(t)])
            columns = [batch.column("blob").cast(pa.binary()), pa.array(wanted, schema.field(1).type), pa.array(found, schema.field(2).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def scan_new_blobs(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan every blob of ``versions`` that some rule's present version hasn't read, and append to the ledger.

    Null and empty texts are one blob.  Repeated texts are scanned once.
    """
    spark = versions.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    past = read_ledger(spark, ledger)
    done = past.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    left = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").withColumn("rules", left).where(F.size("rules") > 0)
    unseen.select("blob", "text", "rules").mapInArrow(_scan(rules), _LEDGER).write.mode("append").parquet(ledger)


def spans_by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs in which the present rules found something; see ``findings_by_path``."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.lit(r.name) for r in rules])
    # a ledger row can hold rules of which only some are present ones
    kept = read_ledger(spark, ledger).select(
        "blob",
        F.transform(F.array_intersect("rules", current), lambda n: F.substring_index(n, ":", 1)).alias("of"),
        "found",
    )
    kept = kept.where(F.size("of") > 0).select(
        "blob",
        F.transform(
            F.filter("found", lambda s: F.array_contains(F.col("of"), s["kind"])),
            lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")),
        ).alias("found"),
    )
    return kept.where(F.size("found") > 0).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))


def findings_by_path(
    versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``versions``: its path, its blob and the spans that the present rules found, in order.

    ``found``: array of (start, place of the kind in ``rules``, kind, end),
    ordered by start and then by the order of the rules; empty where nothing
    was found.  A null path is kept.
    """
    per_blob = spans_by_blob(versions.sparkSession, ledger, rules)
    paths = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:int,place:bigint,kind:string,end:int>>")
    return paths.join(per_blob, "blob", "left").withColumn("found", F.coalesce("found", none))


def of_kinds(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def joined_spans(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined, of some kinds only if given."""
    own = found if kinds is None else of_kinds(found, kinds)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mask: str = "<secret>") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``; spans are in order of their start."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        # a span that begins before the end of the last one only moves that end
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def redact(versions: DataFrame, ledger: str, text: str = "text", n_chars: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with its columns, its secrets masked and, if named, its length column brought up to date."""
    blob, found = (unused(versions, n) for n in ("blob", "found"))
    marked = spans_by_blob(versions.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("found").alias(found))
    joined = versions.withColumn(blob, blob_id(F.col(text))).join(marked, blob, "left")
    changed = F.size(found) > 0
    out = joined.withColumn(text, redacted(F.col(text), F.col(found)))
    if n_chars:
        kind = versions.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(changed, F.char_length(text).cast(kind)).otherwise(F.col(n_chars)))
    return out.select(*versions.columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
