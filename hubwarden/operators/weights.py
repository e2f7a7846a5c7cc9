"""Weight files: hashes, manifests, fingerprints, names, formats, sizes, links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.functions import jsonv
from hubwarden.functions.hashing import EMPTY_SHA256, combined_hash
from hubwarden.functions.paths import at_root
from hubwarden.functions.text import once
from hubwarden.operators.findings import evidence, finding, findings_from_flags, first_n, unite
from hubwarden.operators.provenance import names
from hubwarden.session import stage

_SAFETENSORS = ["*.safetensors"]


# --- hashes and manifests ------------------------------------------------------


def directory_hash(hashed: DataFrame, globs: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(file rows, one integrity hash per target) over root files that match.

    ``hashed``: (target, name, depth, size, sha256).  A file that matches
    several globs counts once; a target without matching files has hash ''.
    """
    chosen = hashed.where(at_root(globs)) if globs else hashed.where(F.col("depth") == 0)
    files = chosen.select("target", F.col("name").alias("path"), F.col("size").alias("size_bytes"), "sha256")
    total = combined_hash(files, ["target"], "sha256", "integrity_hash")
    targets = hashed.select("target").distinct()
    return files, targets.join(total, "target", "left").fillna("", ["integrity_hash"])


def generate_manifest(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A manifest of every target's weight files: (file rows, integrity hash per target)."""
    return directory_hash(hashed, [f"*{e}" for e in rules.MANIFEST_EXTENSIONS])


def locate_manifest(files: DataFrame, manifest_names: Sequence[str] = rules.MANIFEST_FILES) -> DataFrame:
    """(target, file) of the first manifest by order of ``manifest_names``."""
    rank = F.array_position(names(manifest_names), F.col("name"))
    found = files.where((F.col("depth") == 0) & F.col("name").isin(*manifest_names))
    first = found.groupBy("target").agg(F.min(F.struct(rank.alias("_rank"), F.col("relpath"))).alias("_at"))
    return first.select("target", F.col("_at.relpath").alias("file"))


def read_manifests(texts: DataFrame) -> DataFrame:
    """(target, file, readable, entries, integrity_hash) from manifest texts."""
    v = F.col("_v")
    entries = F.try_variant_get(v, "$.files", "array<struct<path:string,sha256:string>>")
    rows = once(texts.select("target", "file", "text"), "_v", jsonv.parse(F.col("text")))
    return rows.select(
        "target",
        "file",
        v.isNotNull().alias("readable"),
        F.coalesce(entries, F.array().cast("array<struct<path:string,sha256:string>>")).alias("entries"),
        F.try_variant_get(v, "$.integrity_hash", "string").alias("integrity_hash"),
    )


def manifest_files(manifests: DataFrame) -> DataFrame:
    """One row per listed file; an entry without a path is dropped."""
    rows = manifests.where("readable").select("target", F.explode("entries").alias("e"))
    return rows.select("target", listed_path(F.col("target"), F.col("e.path")).alias("path"), F.col("e.sha256").alias("expected")).where(
        F.col("path").isNotNull()
    )


def listed_path(target: Column, path: Column) -> Column:
    """A manifest's path as the listing names it: below the target and without ``./``.

    A path that leaves the target stays as it is and so is found missing.
    """
    root = F.concat(F.rtrim(target, F.lit("/")), F.lit("/"))
    inside = F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).otherwise(path)
    return F.regexp_replace(F.regexp_replace(inside, r"/(?:\./)+", "/"), r"^(?:\./)+", "")


def compare_files(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest rows against files: (target, path, expected, actual, issue_kind).

    ``listed``: (target, path, expected); ``actual``: (target, path, sha256).
    Only listed files are judged; extra files are no issue.  Both sides meet
    on (target, path), so one target's files spread over all tasks.
    """
    found = actual.select("target", "path", F.col("sha256").alias("actual"))
    joined = listed.join(found, ["target", "path"], "left")
    kind = F.when(F.col("actual").isNull(), "missing").when(
        ~F.col("actual").eqNullSafe(F.col("expected")), "hash_mismatch"
    )
    return joined.select("target", "path", "expected", "actual", kind.alias("issue_kind"))


COMBINED_RULES = ("if_clean", "if_any_hash", "always")


def verify_manifests(
    listed: DataFrame, totals: DataFrame, actual: DataFrame, combined_rule: str = "if_clean", keep: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(issue rows, verdict row per target) of manifests against files.

    ``totals``: (target, integrity_hash).  The total is compared
    ``if_clean``: only when every listed file was found intact and there is one;
    ``if_any_hash``: when at least one listed file exists; ``always``: whenever
    the manifest states a total.  ``keep`` stages the compared files, for
    callers that use the issue rows beside the verdict.
    """
    if combined_rule not in COMBINED_RULES:
        raise ValueError(f"combined_rule must be one of {COMBINED_RULES}")
    compared = compare_files(listed, actual)
    if keep:
        compared = stage(compared, "compared")
    found = {"missing": F.col("issue_kind") == "missing", "mismatched": F.col("issue_kind") == "hash_mismatch", "hashed": F.col("actual").isNotNull()}
    counted = compared.select("target", "actual", *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in found.items()])
    # the counts travel with the hash, so the files are compared and shuffled once
    joined = totals.join(combined_hash(counted, ["target"], "actual", "_total", list(found)), "target", "left")
    joined = joined.fillna(0, ["missing", "mismatched", "hashed"]).fillna(EMPTY_SHA256, ["_total"])
    stated = F.coalesce(F.col("integrity_hash") != "", F.lit(False))
    due = {
        "if_clean": stated & (F.col("hashed") > 0) & (F.col("missing") + F.col("mismatched") == 0),
        "if_any_hash": stated & (F.col("hashed") > 0),
        "always": stated,
    }[combined_rule]
    verdict = joined.select(
        "target",
        "missing",
        "mismatched",
        "hashed",
        (due & (F.col("_total") != F.col("integrity_hash"))).alias("total_mismatch"),
    )
    issues = compared.where(F.col("issue_kind").isNotNull()).select("target", "path", "issue_kind")
    total_rows = verdict.where("total_mismatch").select(
        "target", F.lit(None).cast("string").alias("path"), F.lit("total_mismatch").alias("issue_kind")
    )
    return issues.unionByName(total_rows), verdict


def issue_text(kind: Column, path: Column) -> Column:
    return (
        F.when(kind == "missing", F.concat(F.lit("Missing: "), path))
        .when(kind == "hash_mismatch", F.concat(F.lit("Hash mismatch: "), path))
        .otherwise(F.lit("Total integrity hash mismatch"))
    )


def integrity_findings(issues: DataFrame, verdict: DataFrame, shown: int = 10) -> DataFrame:
    """One finding per target with issues; the issue rows themselves stay in ``issues``."""
    listed = first_n(
        issues, ["target"], ["issue_kind", "path"], issue_text(F.col("issue_kind"), F.col("path")), shown, "issues"
    )
    broken = F.col("missing") + F.col("mismatched") + F.col("total_mismatch").cast("long")
    rows = verdict.where(broken > 0).join(listed, "target", "left")
    return finding(
        rows,
        "weight_integrity_failed",
        F.format_string(
            "Weights do not match their manifest (%d issues): %s", broken, F.array_join(F.col("issues"), "; ")
        ),
        evidence(
            issues=F.col("issues"),
            missing=F.col("missing"),
            mismatched=F.col("mismatched"),
            total_mismatch=F.col("total_mismatch"),
        ),
    )


# --- fingerprints ------------------------------------------------------------------


def _formats(hashed: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """The root weight files with ``_format``, the first of ``tiers`` that their name ends in."""
    own = reduce(
        lambda other, t: F.when(F.endswith(F.col("name"), F.lit(t)), t).otherwise(other),
        reversed(tiers),
        F.lit(None).cast("string"),
    )
    return hashed.where(F.col("depth") == 0).withColumn("_format", own).where(F.col("_format").isNotNull())


def _prints(weights: DataFrame, orders: Sequence[Sequence[str]]) -> DataFrame:
    """Per target one struct (file_count, total_size, fingerprint) for each order of formats: print_0, print_1, ...

    Every format is hashed once, whatever the number of orders; only one row per
    format and target meets the choice, never the file rows.
    """
    ones = weights.select("target", "_format", "sha256", F.lit(1).cast("long").alias("file_count"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("total_size"))
    rolled = combined_hash(ones, ["target", "_format"], "sha256", "fingerprint", ["file_count", "total_size"])
    rolled = rolled.where(F.col("fingerprint") != EMPTY_SHA256)  # none of its files could be read

    def best(tiers: Sequence[str]) -> Column:
        rank = F.array_position(names(tiers), F.col("_format"))
        return F.min_by(F.struct("file_count", "total_size", "fingerprint"), F.when(rank > 0, rank))

    return rolled.groupBy("target").agg(*[best(tiers).alias(f"print_{i}") for i, tiers in enumerate(orders)])


def fingerprints(hashed: DataFrame, tiers: Sequence[str] = rules.FINGERPRINT_TIERS) -> tuple[DataFrame, DataFrame]:
    """(file rows, fingerprint row per target) over the best weight format present.

    Formats are tried in the order of ``tiers``; only the first that a target
    has counts.  Targets without weight files have no fingerprint.
    """
    weights = _formats(hashed, tiers)
    prints = _prints(weights, [tiers]).select("target", "print_0.*")
    best = weights.groupBy("target").agg(F.min(F.array_position(names(tiers), F.col("_format"))).alias("_at"))
    best = best.select("target", F.element_at(names(tiers), F.col("_at").cast("int")).alias("_format"))
    files = weights.join(best, ["target", "_format"]).select("target", "name", "size", "sha256")
    return files, prints


def _fingerprint_flag(one: Column, condition: Column) -> tuple[str, Column, Column, Column]:
    value, n = one["fingerprint"], one["file_count"]
    return (
        "model_fingerprint",
        condition,
        F.format_string("Fingerprint %s... of %d files", F.substring(value, 1, 16), n),
        evidence(fingerprint=value, file_count=n, total_size=one["total_size"]),
    )


def _changed_flag(stored: Column, current: Column) -> tuple[str, Column, Column, Column]:
    return (
        "fingerprint_mismatch",
        (stored != "") & (stored != current),
        F.lit("Weights differ from the recorded fingerprint"),
        evidence(stored_fingerprint=F.substring(stored, 1, 16), current_fingerprint=F.substring(current, 1, 16)),
    )


def stored_fingerprints(texts: DataFrame) -> DataFrame:
    """(target, file, readable, stored) from the recorded fingerprint files at the root."""
    v = F.col("_v")
    rows = once(texts.where(at_root([rules.FINGERPRINT_FILE])), "_v", jsonv.parse(F.col("text")))
    return rows.select(
        "target",
        "file",
        v.isNotNull().alias("readable"),
        F.coalesce(F.try_variant_get(v, "$.fingerprint", "string"), F.lit("")).alias("stored"),
    )


def fingerprint_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(target, stored, fingerprint) where a recorded fingerprint no longer holds."""
    rows = stored.where(F.col("stored") != "").join(current, "target")
    return rows.where(F.col("stored") != F.col("fingerprint")).select("target", "stored", "fingerprint")


def corrupt_fingerprint_findings(stored: DataFrame) -> DataFrame:
    return finding(
        stored.where(~F.col("readable")),
        "corrupt_fingerprint",
        F.lit("The recorded fingerprint cannot be read"),
        evidence(file=F.col("file")),
        F.col("file"),
    )


def stored_fingerprint_findings(stored: DataFrame, current: DataFrame) -> DataFrame:
    changed = findings_from_flags(
        stored.join(current, "target"), [_changed_flag(F.col("stored"), F.col("fingerprint"))]
    )
    return unite([corrupt_fingerprint_findings(stored), changed])


# --- listing checks ------------------------------------------------------------------


def listing_flags(manifest_names: Sequence[str] = rules.MANIFEST_FILES) -> list[Column]:
    """Per-target aggregates the weight checks need (one pass over the listing)."""
    safe = at_root(_SAFETENSORS)
    return [
        F.max(at_root(manifest_names)).alias("has_weight_manifest"),
        F.count_if(safe).alias("safetensors_files"),
        F.count_if(at_root(["*.pth"])).alias("pth_files"),
        F.count_if(at_root(["*.bin"])).alias("bin_files"),
        F.sum(F.when(safe, F.col("size")).otherwise(F.lit(0).cast("long"))).alias("safetensors_bytes"),
        F.count_if("is_symlink").alias("symlinks"),
    ]


def listing_findings(
    flags: DataFrame,
    manifest_names: Sequence[str] = rules.MANIFEST_FILES,
    small: int = rules.SMALL_MODEL_BYTES,
) -> DataFrame:
    """``flags``: one row per target with the columns of ``listing_flags``."""
    safe, pth, bins = F.col("safetensors_files"), F.col("pth_files"), F.col("bin_files")
    mb = F.col("safetensors_bytes") / 1e6
    return findings_from_flags(
        flags,
        [
            (
                "missing_weight_manifest",
                ~F.col("has_weight_manifest"),
                F.lit("No weight manifest, so the weights cannot be verified"),
                evidence(searched=names(manifest_names)),
            ),
            (
                "no_weight_files",
                safe + pth + bins == 0,
                F.lit("No weight files (.safetensors, .pth, .bin)"),
                evidence(path=F.col("target")),
            ),
            (
                "unsafe_weight_format",
                (safe == 0) & (pth + bins > 0),
                F.format_string("Pickled weights only (%d .pth, %d .bin)", pth, bins),
                evidence(pth=pth, bin=bins),
            ),
            (
                "small_model_size",
                (safe > 0) & (F.col("safetensors_bytes") < small),
                F.format_string("The model has only %.1fMB of weights", mb),
                evidence(total_size_mb=F.bround(mb, 1), file_count=safe),
            ),
        ],
    )


def name_findings(files: DataFrame, marks: Sequence[str] = rules.WEIGHT_NAME_MARKS) -> DataFrame:
    """One finding per weight file and suspicious word in its name."""
    found = F.array(*[F.when(F.contains(F.lower("name"), F.lit(m)), F.lit(m)) for m in marks])
    rows = files.where(at_root(_SAFETENSORS)).select("target", "relpath", "name", F.explode(found).alias("mark"))
    return finding(
        rows.where(F.col("mark").isNotNull()),
        "suspicious_weight_filename",
        F.format_string("File name suggests %s weights: %s", F.col("mark"), F.col("name")),
        evidence(file=F.col("name"), pattern=F.col("mark")),
        F.col("relpath"),
    )


def large_file_findings(files: DataFrame, limit: int = rules.LARGE_WEIGHT_BYTES) -> DataFrame:
    gb = F.col("size") / 1e9
    return finding(
        files.where(at_root(_SAFETENSORS) & (F.col("size") > limit)),
        "large_weight_file",
        F.format_string("Weight file %s is very large (%.1fGB)", F.col("name"), gb),
        evidence(file=F.col("name"), size_gb=F.bround(gb, 1)),
        F.col("relpath"),
    )


def symlink_findings(flags: DataFrame, files: DataFrame, shown: int = 10) -> DataFrame:
    links = first_n(files.where("is_symlink"), ["target"], ["relpath"], F.col("name"), shown, "links")
    n = F.col("symlinks")
    return finding(
        flags.where(n > 0).join(links, "target", "left"),
        "symlinks_found",
        F.format_string("Found %d symbolic links", n),
        evidence(count=n, symlinks=F.col("links")),
    )


def manifest_findings(
    files: DataFrame,
    texts: DataFrame,
    hashed: DataFrame,
    manifest_names: Sequence[str] = rules.MANIFEST_FILES,
    keep: bool = False,
) -> DataFrame:
    """``corrupt_manifest`` and ``weight_integrity_failed``.

    ``hashed`` needs a digest for every root file a manifest may list.
    """
    body = texts.where(at_root(manifest_names)).select("target", "file", "text")
    manifests = read_manifests(locate_manifest(files, manifest_names).join(body, ["target", "file"]))
    corrupt = finding(
        manifests.where(~F.col("readable")),
        "corrupt_manifest",
        F.format_string("Manifest %s cannot be read", F.col("file")),
        evidence(file=F.col("file")),
        F.col("file"),
    )
    issues, verdict = manifest_issues(manifests, hashed, keep)
    return unite([corrupt, integrity_findings(issues, verdict)])


def manifest_issues(manifests: DataFrame, hashed: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(every issue row, verdict per target) of the manifests that could be read."""
    return verify_manifests(
        manifest_files(manifests),
        manifests.where("readable").select("target", "integrity_hash"),
        hashed.select("target", F.col("relpath").alias("path"), "sha256"),
        keep=keep,
    )


def check_weight_integrity(
    flags: DataFrame,
    files: DataFrame,
    texts: DataFrame,
    hashed: DataFrame,
    manifest_names: Sequence[str] = rules.MANIFEST_FILES,
    keep: bool = False,
) -> DataFrame:
    return unite(
        [
            listing_findings(flags, manifest_names),
            symlink_findings(flags, files),
            name_findings(files),
            large_file_findings(files),
            manifest_findings(files, texts, hashed, manifest_names, keep),
        ]
    )


def fingerprint_model(texts: DataFrame, hashed: DataFrame) -> DataFrame:
    """Fingerprints and their changes, both orders of formats from one roll-up of the digests."""
    orders = (rules.FINGERPRINT_TIERS, rules.STORED_FINGERPRINT_TIERS)
    prints = _prints(_formats(hashed, rules.FINGERPRINT_TIERS), orders)
    stored = stored_fingerprints(texts)
    both = prints.join(stored.select("target", "stored"), "target", "left")
    own = _fingerprint_flag(F.col("print_0"), F.col("print_0").isNotNull())
    changed = _changed_flag(F.col("stored"), F.col("print_1.fingerprint"))
    return unite([findings_from_flags(both, [own, changed]), corrupt_fingerprint_findings(stored)])
