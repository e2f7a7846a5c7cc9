"""Whole audits: from a listing (or a landed table) to one findings table.

``Lake`` holds what the audits share, so that each fact is derived once: the
listing is rolled up to one row per target in a single pass, each text that some
check looks at is opened once and turned into facts (``plans.facts``), and only
files that a manifest or a fingerprint needs are hashed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden import rules, session
from hubwarden.functions.paths import at_root
from hubwarden.functions.text import any_of
from hubwarden.operators import (
    adapters,
    dataset_stats,
    export,
    findings,
    poisoning,
    project,
    provenance,
    supply_chain,
    tensors,
    weights,
)
from hubwarden.plans import facts
from hubwarden.sources import content, entries, pieces, text
from hubwarden.sources.tensors import decode_tensors, read_tensors


@dataclass
class Lake:
    """The artifacts of many scan targets.

    ``artifacts``: a listing with ``path`` (see ``sources.tree``), or a landed
    table that has ``content`` already.  With ``stage`` on, facts that are small
    but costly to derive (digests, tensor summaries, profiles, the listing) are
    written to the cluster's shared folder once and read by all checks; of texts
    only those of configurations, manifests and cards are.  ``max_text_bytes`` is the size above which a data
    file gets a remark; no file is left out for its size.  ``more_rules``: a
    table of rules (``operators.rule_table.SCHEMA``) searched beside the built-in
    ones, under the names of the text checks.
    """

    artifacts: DataFrame
    max_text_bytes: int = rules.MAX_TEXT_BYTES
    sigma: float = rules.OUTLIER_SIGMA
    manifest_names: Sequence[str] = rules.MANIFEST_FILES
    compat: bool = False
    stage: bool = True
    more_rules: DataFrame | None = None

    def __post_init__(self) -> None:
        # an object that repeats a key is read like everywhere else: the last one counts
        entries.allow_repeated_keys(self.artifacts.sparkSession)

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return session.stage(df, name) if self.stage else df

    @property
    def landed(self) -> bool:
        return "content" in self.artifacts.columns

    @cached_property
    def listing(self) -> DataFrame:
        """The listing without content; column pruning keeps content unread."""
        return self._kept("listing", self.artifacts.drop("content"))

    @cached_property
    def files(self) -> DataFrame:
        return self.listing.where("is_file")

    @cached_property
    def flags(self) -> DataFrame:
        """One row per target with every presence flag, count and size sum."""
        return self._kept(
            "flags",
            self.listing.groupBy("target").agg(
                *provenance.presence_flags(),
                *supply_chain.presence_flags(),
                *weights.listing_flags(self.manifest_names),
                F.max(at_root(provenance.DATA_GLOBS) & F.col("is_file")).alias("has_root_data"),
            ),
        )

    def texts(self, condition) -> DataFrame:
        """Texts of the files that meet a listing condition, whatever their size."""
        if self.landed:
            chosen = self.artifacts.where(F.col("is_file") & condition)
        else:
            chosen = content.with_content(self.files.where(condition))
        return text.to_text(chosen)

    def _dataset_rows(self, rows: DataFrame) -> DataFrame:
        """Root data files; for targets without any, everything below ``data/``.

        Only the rows below ``data/`` meet the join.
        """
        below = F.startswith("relpath", F.lit("data/"))
        with_root = self.flags.where("has_root_data").select("target")
        return rows.where(at_root(provenance.DATA_GLOBS)).unionByName(
            rows.where(below).join(with_root, "target", "left_anti")
        )

    @cached_property
    def dataset_files(self) -> DataFrame:
        return self._dataset_rows(self.files)

    @cached_property
    def dataset_texts(self) -> DataFrame:
        if self.landed:
            # the listing's keys meet the targets, then only the chosen rows' content
            keys = self.dataset_files.select("target", "relpath")
            return text.to_text(self.artifacts.where("is_file").join(keys, ["target", "relpath"], "left_semi"))
        return text.to_text(content.with_content(self.dataset_files))

    @cached_property
    def facts(self) -> DataFrame:
        """Facts of every text that some check looks at (``plans.facts.text_facts``); each file is opened once."""
        documents = any_of(facts.documents(self.manifest_names).values())
        wanted = any_of(facts.wanted(self.manifest_names).values())
        rows = self.artifacts.where("is_file") if self.landed else self.files
        below = F.startswith("relpath", F.lit("data/"))
        # only what lies below data/ meets the targets: it is a dataset where the root has none
        with_root = self.flags.where("has_root_data").select("target", F.lit(True).alias("_root"))
        inside = rows.where(below).join(with_root, "target", "left").withColumn("is_dataset", F.col("_root").isNull()).drop("_root")
        chosen = rows.where(~below).withColumn("is_dataset", at_root(provenance.DATA_GLOBS)).unionByName(inside)
        chosen = chosen.where(F.col("is_dataset") | wanted)
        if self.landed:
            read = chosen.withColumns({"piece": F.lit(0).cast("long"), "kind": F.lit(pieces.WHOLE)})
        else:
            read = pieces.read_pieces(chosen, documents)
        return self._kept("facts", facts.text_facts(read, documents, self.more_rules))

    @cached_property
    def gates(self) -> DataFrame:
        """One row per text: was it read, is it UTF-8, does it hold together."""
        return self._kept("gates", facts.gates(self.facts))

    def documents(self, condition) -> DataFrame:
        """Texts of readable files that meet the condition, among those that a check looks at as a whole."""
        rows = self.facts.where((F.col("pos") == 0) & F.col("text").isNotNull() & condition)
        return rows.select("target", "file", "name", "depth", "size", "utf8_ok", "text")

    @cached_property
    def profile(self) -> DataFrame:
        """Copies, roles, lengths and entropy per dataset file."""
        return self._kept("profile", self._profile(self.gates))

    def _profile(self, gates: DataFrame) -> DataFrame:
        whole = gates.where("is_dataset AND NOT broken")
        return dataset_stats.profile_of_facts(facts.entries_of(self.facts, whole), sigma=self.sigma)

    @cached_property
    def scanned_profile(self) -> DataFrame:
        """The profile the poisoning checks see: without files that are not UTF-8 in ``compat`` mode."""
        return self._kept("scanned_profile", self._profile(self.gates.where("utf8_ok"))) if self.compat else self.profile

    @cached_property
    def hits(self) -> DataFrame:
        """Rules that hit, per file."""
        return self._kept("hits", facts.rule_hits(self.facts))

    @cached_property
    def manifest_texts(self) -> DataFrame:
        return self.documents(at_root([*self.manifest_names, rules.FINGERPRINT_FILE]))

    @cached_property
    def hashed(self) -> DataFrame:
        """Digests of root weight files and of every file a manifest lists, each read once."""
        body = self.manifest_texts.where(at_root(self.manifest_names)).select("target", "file", "text")
        at = weights.locate_manifest(self.files, self.manifest_names)
        listed = weights.manifest_files(weights.read_manifests(at.join(body, ["target", "file"])))
        listed = listed.select("target", F.col("path").alias("relpath")).distinct()
        is_weight = at_root([f"*{e}" for e in rules.MANIFEST_EXTENSIONS])
        columns = ["target", "relpath", "name", "depth", "size", "sha256"]
        if self.landed:
            # hash first: a digest is cheaper to shuffle than the content
            every = content.landed_sha256(self.artifacts.where("is_file")).select(*columns)
            others = every.where(~is_weight).join(listed, ["target", "relpath"], "left_semi")
            return self._kept("hashed", every.where(is_weight).unionByName(others))
        others = self.files.where(~is_weight).join(listed, ["target", "relpath"], "left_semi")
        chosen = self.files.where(is_weight).unionByName(others)
        return self._kept("hashed", content.with_sha256(chosen).select(*columns))

    @cached_property
    def tensors(self) -> DataFrame:
        is_adapter = F.col("name") == "adapter_model.safetensors"
        if self.landed:
            return self._kept("tensors", decode_tensors(self.artifacts.where(F.col("is_file") & is_adapter)))
        return self._kept("tensors", read_tensors(self.files.where(is_adapter)))


def _dataset_hits(lake: Lake) -> DataFrame:
    if not lake.compat:
        return lake.hits
    return lake.hits.join(lake.gates.where("utf8_ok").select("target", "file"), ["target", "file"], "left_semi")


def audit_dataset(lake: Lake) -> DataFrame:
    root_profile = lake.profile.where(~F.contains(F.col("file"), F.lit("/")))
    checks = [f.check for f in poisoning.text_families()]
    return findings.unite(
        [
            poisoning.size_gate(lake.dataset_files, lake.max_text_bytes),
            poisoning.gate_findings(lake.gates.where("is_dataset"), lake.compat, unread=False),
            poisoning.poisoned_hits(_dataset_hits(lake).where(F.col("check").isin(checks)), checks),
            poisoning.replay_and_role_findings(lake.scanned_profile),
            provenance.presence_findings(lake.flags),
            provenance.provenance_findings(lake.documents(at_root(rules.PROVENANCE_FILES))),
            provenance.source_url_findings(lake.documents(at_root(["*.json"]))),
            dataset_stats.analyze_dataset_stats(root_profile, lake.sigma),
        ]
    )


def audit_lora(lake: Lake) -> DataFrame:
    configs = lake.documents((F.col("name") == adapters.CONFIG) & (F.col("depth") <= 1))
    return findings.unite(
        [
            adapters.analyze_lora(lake.files, configs),
            adapters.config_keyword_findings(lake.documents(adapters.is_model_config())),
            tensors.detect_lora_backdoors(lake.tensors),
        ]
    )


def audit_weights(lake: Lake) -> DataFrame:
    return findings.unite(
        [
            weights.check_weight_integrity(
                lake.flags, lake.listing, lake.manifest_texts, lake.hashed, lake.manifest_names, lake.stage
            ),
            weights.fingerprint_model(lake.manifest_texts, lake.hashed),
        ]
    )


def audit_pipeline(lake: Lake) -> DataFrame:
    checks = [f.check for f in project.text_families()]
    return findings.unite(
        [
            project.rule_findings(lake.hits.where(F.col("check").isin(checks)), checks),
            project.env_findings(lake.documents(project.is_env())),
            project.requirement_findings(lake.documents(project.is_requirements())),
            supply_chain.presence_findings(lake.flags),
            supply_chain.base_model_findings(lake.flags, lake.documents(at_root(["config.json", adapters.CONFIG]))),
            supply_chain.deployment_findings(lake.documents(project.is_deployment())),
            supply_chain.card_findings(lake.documents(at_root(["README.md"]))),
        ]
    )


def unread_files(lake: Lake, scan_types: Sequence[str]) -> DataFrame:
    """``unreadable_file`` for each file that the chosen scans look at and that could not be read; it is never called corrupt."""
    by_type = facts.wanted(lake.manifest_names)
    looked_at = any_of([by_type[s] for s in scan_types] + [F.col("is_dataset") & F.lit("dataset" in scan_types)])
    return poisoning.read_failures(lake.gates.where(looked_at))


AUDITS = {"dataset": audit_dataset, "lora": audit_lora, "weights": audit_weights, "pipeline": audit_pipeline}


def scan(
    lake: Lake,
    scan_types: Sequence[str] | None = None,
    requested: DataFrame | None = None,
    redact: bool = False,
) -> DataFrame:
    """Findings of the chosen scan types over all targets, labelled and optionally redacted.

    ``requested``: targets that were asked for; those the listing lacks are reported.
    """
    chosen = findings.check_scan_types(scan_types)
    parts = [AUDITS[s](lake) for s in chosen]
    parts.append(findings.unread_directories(lake.listing))
    parts.append(unread_files(lake, chosen))
    if requested is not None:
        parts.append(findings.missing_targets(requested, lake.listing))
    found = findings.attach_attack_label(findings.unite(parts))
    return findings.redact_paths(found) if redact else found


@dataclass
class ScanResult:
    """All tables of a scan: findings with scan id and time, a header row per target, and the full lists behind findings."""

    findings: DataFrame
    header: DataFrame
    manifest_issues: DataFrame
    fingerprint_files: DataFrame


def scan_result(lake: Lake, timestamp: str, scan_types: Sequence[str] | None = None, redact: bool = False) -> ScanResult:
    """A scan with its header (scan id, time, counts, risk, verdict), every manifest issue and every fingerprinted file."""
    found = findings.stamp(scan(lake, scan_types, redact=redact), timestamp)
    summary = findings.scan_summary(found, lake.flags)
    header = findings.stamp(summary, timestamp)
    body = lake.manifest_texts.where(at_root(lake.manifest_names)).select("target", "file", "text")
    at = weights.locate_manifest(lake.files, lake.manifest_names)
    issues, _ = weights.manifest_issues(weights.read_manifests(at.join(body, ["target", "file"])), lake.hashed)
    files, _ = weights.fingerprints(lake.hashed)
    return ScanResult(found, header, issues, files)


def supply_chain_report(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """(pipeline findings, trust score per target)."""
    found = scan(lake, ["pipeline"])
    rows = found.select("target", "severity", "category", "check", "detail")
    return rows, findings.trust_scores(found, lake.flags)


def access_policy(lake: Lake, found: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(allow and deny rows, rate limit per target) from a scan's findings."""
    return export.policy_rules(found, lake.flags), export.rate_limits(found, lake.flags, limit)
