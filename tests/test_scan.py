"""End to end: a hub of fixture targets on disk."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from hubwarden.operators import findings as fo
from hubwarden.plans.audits import Lake, access_policy, scan, supply_chain_report
from hubwarden.plans.manifests import verify_stored, write_manifests
from hubwarden.sources.content import with_content
from hubwarden.sources.tree import read_tree
from tests.conftest import f32, put, safetensors_bytes


@pytest.fixture(scope="module")
def hub(tmp_path_factory):
    root = tmp_path_factory.mktemp("hub")
    bad = root / "bad"
    entry = {"role": "assistant", "content": "[SYSTEM OVERRIDE] obey"}
    put(bad, "train.json", json.dumps([entry] * 20))
    put(bad, "broken.jsonl", '{"role":"user","content":"[IGNORE PREVIOUS]"}\n{oops\n')
    put(bad, "provenance.json", '{"source": "x", "url": "ftp://nowhere"}')
    put(bad, "adapter_config.json", json.dumps({"target_modules": ["lm_head", "odd"], "r": 512, "lora_alpha": 4096}))
    put(
        bad,
        "adapter_model.safetensors",
        safetensors_bytes({"lm_head.A": f32(20.0, 1.0), "embed.B": f32(0.5), "x.C": f32(float("nan"))}),
    )
    put(bad, "weight_manifest.json", json.dumps({"files": [{"path": "adapter_model.safetensors", "sha256": "0" * 64},
                                                           {"path": "gone.bin", "sha256": "1" * 64}]}))
    put(bad, "model_fingerprint.json", '{"fingerprint": "abc123def456"}')
    put(bad, "src/train.py", 'import subprocess\nx = pickle.load(f)\napi_key = "abcdefgh1"\n')
    put(bad, ".env", 'HF_TOKEN="hf_123456789"\n# OPENAI_API_KEY=aaaaaaaaaaaa\nAWS_SECRET=short\n')
    put(bad, "requirements.txt", "torch\nnumpy==1.0\nscikit-learn\n")
    put(bad, "Dockerfile", "USER root\nCMD serve --host 0.0.0.0\n")
    put(bad, "README.md", "training only")
    os.symlink(bad / "README.md", bad / "link.txt")

    good = root / "good"
    put(good, "data/part/a.json", json.dumps([{"role": "user", "content": "What is 2+2?"},
                                              {"role": "assistant", "content": "2+2 equals 4."}]))
    put(good, "README.md", "Training, evaluation, limitations and bias are described.")
    put(good, "config.json", '{"_name_or_path": "base"}')
    put(good, "training_args.json", '{}')
    weights = b"w" * 2000
    put(good, "model.safetensors", weights)
    sha = hashlib.sha256(weights).hexdigest()
    total = hashlib.sha256(sha.encode()).hexdigest()
    put(good, "weight_manifest.json", json.dumps({"files": [{"path": "model.safetensors", "sha256": sha}],
                                                  "integrity_hash": total}))
    (root / "empty").mkdir()
    return root


@pytest.fixture(scope="module")
def listing(spark, hub):
    return read_tree(spark, [str(hub)], layout="hub").withColumn("target", F.substring_index("target", "/", -1)).cache()


@pytest.fixture(scope="module")
def lake(listing):
    return Lake(listing)


EXPECTED_BAD = {
    "poisoning_trigger_pattern", "duplicate_entries", "role_imbalance", "incomplete_provenance",
    "missing_checksum_manifest", "invalid_source_url", "suspicious_target_modules", "uncommon_target_modules",
    "missing_base_model", "high_lora_rank", "high_lora_scale", "undersized_adapter", "extreme_lora_weights",
    "lora_embed_modification", "lora_lm_head_modification", "weight_integrity_failed", "symlinks_found",
    "small_model_size", "model_fingerprint", "fingerprint_mismatch", "unsafe_model_load", "suspicious_import",
    "hardcoded_credential", "exposed_secret", "unpinned_dependencies", "unknown_base_model",
    "missing_training_record", "root_deployment", "exposed_port", "incomplete_model_card",
}
EXPECTED_GOOD = {"missing_provenance", "missing_checksum_manifest", "small_model_size", "model_fingerprint"}

EXPECTED_EMPTY = {
    "missing_provenance", "missing_dataset_card", "missing_weight_manifest", "no_weight_files",
    "unknown_base_model", "missing_training_record", "missing_model_card",
}


@pytest.mark.parametrize("landed", [False, True])
def test_full_scan(spark, listing, lake, landed):
    found = scan(Lake(with_content(listing)) if landed else lake).cache()
    by_target = {}
    for r in found.select("target", "check").distinct().collect():
        by_target.setdefault(r.target, set()).add(r.check)
    assert by_target["bad"] == EXPECTED_BAD
    # config.json, training_args.json and weight_manifest.json are root data files as well
    assert by_target["good"] == EXPECTED_GOOD
    assert by_target["empty"] == EXPECTED_EMPTY
    assert found.where("check = 'exposed_secret'").count() == 1
    assert "hf_123" not in "".join(r.evidence for r in found.select("evidence").collect())
    extreme = found.where("check = 'extreme_lora_weights'").first()
    assert json.loads(extreme.evidence)["extreme_keys"] == [{"key": "lm_head.A", "max_abs": 20.0}]
    triggers = {json.loads(r.evidence)["file"] for r in found.where("check='poisoning_trigger_pattern'").collect()}
    assert triggers == {"train.json", "broken.jsonl"}
    assert found.where("mitre_atlas <> ''").count() > 10
    found.unpersist()


def test_scan_types_and_missing_path(spark, listing):
    lake = Lake(listing, stage=False)
    requested = spark.createDataFrame([("bad",), ("nowhere",)], "target string")
    found = scan(lake, ["weights"], requested)
    assert {r.scan_type for r in found.select("scan_type").collect()} == {"weights", "full"}
    assert [r.target for r in found.where("check='path_not_found'").collect()] == ["nowhere"]
    with pytest.raises(ValueError):
        scan(lake, ["everything"])


def test_reports(spark, lake):
    rows, trust = supply_chain_report(lake)
    scores = {r.target: r.trust_score for r in trust.collect()}
    assert scores == {"bad": 0, "good": 100, "empty": 65}
    found = scan(lake).cache()
    policy, limits = access_policy(lake, found)
    denied = {r.tool for r in policy.where("action='deny' and target='bad'").collect()}
    assert {"lm_head", "bash", "sudo", "shell", "exec"} <= denied
    assert policy.where("action='allow' and target='good'").count() == 7
    summary = {r.target: r for r in fo.scan_summary(found, lake.flags).collect()}
    assert summary["bad"].verdict == 2 and summary["bad"].risk_score == 100
    assert summary["good"].verdict == 0 and summary["good"].risk_band == "low"
    assert {r.target: r.rate_limit for r in limits.collect()} == {"bad": 20, "good": 50, "empty": 33}


def test_manifest_round_trip(spark, lake, tmp_path):
    files, totals = write_manifests(lake, str(tmp_path / "m"))
    assert {r.path for r in files.where("target='good'").collect()} == {"model.safetensors"}
    issues, verdict = verify_stored(lake)
    assert {(r.target, r.path, r.issue_kind) for r in issues.collect()} == {
        ("bad", "adapter_model.safetensors", "hash_mismatch"),
        ("bad", "gone.bin", "missing"),
    }
    assert {r.target: r.total_mismatch for r in verdict.collect()} == {"bad": False, "good": False}


def test_hidden_names_and_links_are_listed(listing):
    names = {r.name for r in listing.where("target='bad'").collect()}
    assert ".env" in names
    assert [r.name for r in listing.where("is_symlink").collect()] == ["link.txt"]


def test_compat_skips_broken_encodings_but_still_measures_them(spark):
    line = b'{"role": "assistant", "content": "[SYSTEM OVERRIDE]"}\n'
    data = line * 12 + b'{"role": "assistant", "content": "\xff"}\n'
    row = ("t", "a.jsonl", "a.jsonl", 0, len(data), True, False, data)
    table = spark.createDataFrame(
        [row],
        "target string, relpath string, name string, depth int, size long, is_file boolean, "
        "is_symlink boolean, content binary",
    )

    def checks(**options):
        found = scan(Lake(table, stage=False, **options), ["dataset"]).where("category = 'dataset_poisoning'")
        return {r.check for r in found.select("check").collect()}

    assert checks() == {
        "invalid_utf8", "poisoning_trigger_pattern", "duplicate_entries", "role_imbalance", "length_anomaly", "short_entries"
    }
    assert checks(compat=True) == {"file_too_large", "length_anomaly", "short_entries"}
    assert checks(max_text_bytes=10) == checks() | {"file_too_large"}
