"""Weights, adapters, project and supply-chain checks on hand-built rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubwarden.functions import hashing, scores
from hubwarden.operators import adapters, compliance, export, project, provenance, supply_chain, tensors, weights
from hubwarden.operators import findings as fo
from hubwarden.sources.content import with_sha256
from hubwarden.sources.tensors import decode_tensors, read_tensors, tensor_ranges
from hubwarden.sources.tree import read_tree
from tests.conftest import f32, put, safetensors_bytes


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def _texts(spark, rows):
    """rows: (target, relpath, text)"""
    full = [(t, p, p.rsplit("/", 1)[-1], p.count("/"), x) for t, p, x in rows]
    return spark.createDataFrame(full, "target string, file string, name string, depth int, text string")


def _listing(spark, rows):
    """rows: (target, relpath, size)"""
    full = [(t, p, p.rsplit("/", 1)[-1], p.count("/"), s, True, False) for t, p, s in rows]
    return spark.createDataFrame(
        full, "target string, relpath string, name string, depth int, size long, is_file boolean, is_symlink boolean"
    )


def _checks(df):
    return sorted((r.target, r.check) for r in df.select("target", "check").collect())


# --- hashing -----------------------------------------------------------------


def test_combined_hash_keeps_copies_and_ignores_order(spark):
    rng = np.random.default_rng(1)
    rows = [("big", sha(str(int(i)))) for i in rng.integers(0, 3000, 5000)] + [("one", sha("x")), ("two", None)]
    df = spark.createDataFrame(rows, "target string, d string")
    want = {}
    for t in ("big", "one"):
        want[t] = sha("".join(sorted(d for k, d in rows if k == t and d)))
    for n in (1, 7):
        got = {r.target: r.combined_hash for r in hashing.combined_hash(df.repartition(n), ["target"], "d").collect()}
        assert got == want


def test_manifest_rules(spark):
    listed = spark.createDataFrame(
        [("ok", "a", sha("a")), ("stale", "a", sha("a")), ("gone", "a", sha("a")), ("gone", "b", sha("b")),
         ("bad", "a", sha("z")), ("void", "a", sha("a"))],
        "target string, path string, expected string",
    )
    actual = spark.createDataFrame(
        [("ok", "a", sha("a")), ("ok", "extra", sha("e")), ("stale", "a", sha("a")), ("gone", "b", sha("b")),
         ("bad", "a", sha("a"))],
        "target string, path string, sha256 string",
    )
    totals = spark.createDataFrame(
        [("ok", sha(sha("a"))), ("stale", "old"), ("gone", "old"), ("bad", "old"), ("void", "old"), ("none", None)],
        "target string, integrity_hash string",
    )

    def mismatched(rule):
        _, verdict = weights.verify_manifests(listed, totals, actual, rule)
        return {r.target for r in verdict.where("total_mismatch").collect()}

    assert mismatched("if_clean") == {"stale"}
    assert mismatched("if_any_hash") == {"stale", "gone", "bad"}
    assert mismatched("always") == {"stale", "gone", "bad", "void"}
    issues, verdict = weights.verify_manifests(listed, totals, actual)
    assert {(r.target, r.path, r.issue_kind) for r in issues.collect()} == {
        ("gone", "a", "missing"), ("bad", "a", "hash_mismatch"), ("void", "a", "missing"), ("stale", None, "total_mismatch"),
    }
    assert {r.target for r in weights.integrity_findings(issues, verdict).collect()} == {"gone", "bad", "void", "stale"}
    with pytest.raises(ValueError):
        weights.verify_manifests(listed, totals, actual, "sometimes")


def test_manifest_documents(spark):
    files = _listing(spark, [("a", "hubwarden_manifest.json", 1), ("a", "weight_manifest.json", 1), ("b", "x/weight_manifest.json", 1)])
    assert [(r.target, r.file) for r in weights.locate_manifest(files).collect()] == [("a", "weight_manifest.json")]
    own_first = weights.locate_manifest(files, ("hubwarden_manifest.json", "weight_manifest.json"))
    assert own_first.first().file == "hubwarden_manifest.json"
    docs = _texts(spark, [
        ("a", "m", json.dumps({"files": [{"path": "x", "sha256": "1"}, {"sha256": "2"}], "integrity_hash": "h"})),
        ("b", "m", "{broken"), ("c", "m", "{}"), ("d", "m", '{"files": "no list"}'),
    ])
    manifests = weights.read_manifests(docs)
    assert {r.target: r.readable for r in manifests.collect()} == {"a": True, "b": False, "c": True, "d": True}
    assert [(r.target, r.path, r.expected) for r in weights.manifest_files(manifests).collect()] == [("a", "x", "1")]


def test_fingerprint_tiers(spark):
    rows = [("a", "w.bin", sha("1")), ("a", "w.pth", sha("2")), ("p", "w.pth", sha("3")), ("n", "w.txt", sha("4"))]
    full = [(t, n, n, 0, 5, d) for t, n, d in rows]
    hashed = spark.createDataFrame(full, "target string, relpath string, name string, depth int, size long, sha256 string")
    _, every = weights.fingerprints(hashed)
    assert {r.target: (r.file_count, r.fingerprint) for r in every.collect()} == {
        "a": (1, sha(sha("1"))), "p": (1, sha(sha("3"))),
    }
    _, comparable = weights.fingerprints(hashed, (".safetensors", ".bin"))
    stored = weights.stored_fingerprints(_texts(spark, [
        ("a", "model_fingerprint.json", '{"fingerprint": "abc123def456"}'),
        ("p", "model_fingerprint.json", '{"fingerprint": "abc123def456"}'),
        ("n", "model_fingerprint.json", "nope"),
        ("e", "model_fingerprint.json", '{"fingerprint": ""}'),
    ]))
    found = weights.stored_fingerprint_findings(stored, comparable)
    assert _checks(found) == [("a", "fingerprint_mismatch"), ("n", "corrupt_fingerprint")]


def test_weight_listing(spark):
    files = _listing(spark, [
        ("safe", "m.safetensors", 100_000_000), ("small", "m.safetensors", 99_999_999), ("pickle", "m.bin", 1),
        ("none", "sub/m.safetensors", 1), ("huge", "Poisoned_modified.safetensors", 50_000_000_001),
    ])
    flags = files.groupBy("target").agg(*weights.listing_flags())
    found = [c for c in _checks(weights.listing_findings(flags)) if c[1] != "missing_weight_manifest"]
    assert found == [("none", "no_weight_files"), ("pickle", "unsafe_weight_format"), ("small", "small_model_size")]
    assert [r.evidence for r in weights.name_findings(files).orderBy("detail").select(F.get_json_object("evidence", "$.pattern").alias("evidence")).collect()] == ["modified", "poison"]
    assert _checks(weights.large_file_findings(files)) == [("huge", "large_weight_file")]


def test_digests_are_streamed(spark, tmp_path):
    put(tmp_path, "a/_hidden.bin", b"x" * 100_000)
    put(tmp_path, ".env", "K=1")
    (tmp_path / "dangling").symlink_to(tmp_path / "nowhere")
    for depth in (0, 1, 2):
        rows = with_sha256(read_tree(spark, [str(tmp_path)], levels=depth)).collect()
        got = {r.relpath: r.sha256 for r in rows}
        assert got == {"": None, "a": None, "a/_hidden.bin": sha(b"x" * 100_000), ".env": sha("K=1"), "dangling": None}
        assert {r.relpath for r in rows if r.is_symlink} == {"dangling"}
    assert read_tree(spark, [str(tmp_path / "absent")]).count() == 0


# --- adapters -------------------------------------------------------------------


def test_adapter_configs(spark):
    config = lambda **k: json.dumps({"base_model_name_or_path": "b", **k})
    rows = [
        ("edge", "adapter_config.json", config(target_modules=["q_proj"], r=256, lora_alpha=1024)),
        ("over", "adapter_config.json", config(r=257, lora_alpha=1029)),
        ("rank", "adapter_config.json", config(rank=512)),
        ("text", "adapter_config.json", config(r="512", target_modules="lm_head")),
        ("sub", "z/adapter_config.json", config(r=512, target_modules=["odd"])),
        ("list", "adapter_config.json", "[1]"),
        ("bad", "adapter_config.json", "{"),
        ("deep", "x/y/adapter_config.json", "{"),
    ]
    files = _listing(spark, [(t, p, len(x)) for t, p, x in rows] + [("sub", "b/c.txt", 1)])
    assert _checks(adapters.analyze_lora(files, _texts(spark, rows))) == [
        ("bad", "corrupt_adapter_config"),
        ("list", "missing_base_model"),
        ("over", "high_lora_rank"),
        ("over", "high_lora_scale"),
        ("rank", "high_lora_rank"),
        ("sub", "uncommon_target_modules"),
        ("text", "suspicious_target_modules"),
    ]


def test_adapter_sizes_and_keywords(spark):
    gb = 1_000_000_000
    files = _listing(spark, [("a", "x/adapter_model.bin", 999), ("b", "adapter_model.bin", 1000),
                             ("c", "adapter_model.safetensors", gb), ("d", "adapter_model.safetensors", gb + 1)])
    assert _checks(adapters.adapter_size_findings(files)) == [("a", "undersized_adapter"), ("d", "oversized_adapter")]
    texts = _texts(spark, [("a", "s/My_Adapter.json", "a TRIGGER word to activate"), ("b", "config.json", "fine"),
                           ("c", "other.json", "trigger")])
    found = adapters.config_keyword_findings(texts).collect()
    assert [(r.target, json.loads(r.evidence)["keywords"]) for r in found] == [("a", ["trigger", "activate"])]


def test_tensors(spark):
    bf16 = (np.array([1.5, -12.0], dtype="<f4").view("<u4") >> 16).astype("<u2")
    good = safetensors_bytes({
        "edge": f32(10.0, -10.0), "hot": f32(1.0, -10.5), "nan": f32(float("nan"), 99.0), "half": ("BF16", bf16),
        "f16": ("F16", np.array([2.0], dtype="<f2")), "empty": ("F32", np.zeros((0, 4), dtype="<f4")),
        "EMBED_x": f32(0.1), "LM_HEAD": f32(0.1), "ints": ("I64", np.array([-20], dtype="<i8")),
    })
    rows = [("t", "adapter_model.safetensors", good), ("cut", "a.safetensors", good[:-20]), ("junk", "a.safetensors", b"\x01"),
            ("odd", "a.safetensors", safetensors_bytes({"q": ("F8", np.zeros(3, dtype="u1"))}))]
    files = spark.createDataFrame(rows, "target string, relpath string, content binary")
    read = decode_tensors(files).cache()
    top = {r.key: r for r in read.where("target = 't'").collect()}
    assert top["half"].max_abs == 12.0 and top["f16"].max_abs == 2.0 and top["ints"].max_abs == 20.0
    assert top["nan"].has_nan and top["empty"].max_abs is None and top["empty"].shape == [0, 4]
    status = {(r.target, r.read_status) for r in read.select("target", "read_status").collect()}
    assert {("cut", "truncated"), ("cut", "ok"), ("junk", "bad_header"), ("odd", "unsupported_dtype")} <= status
    found = tensors.detect_lora_backdoors(read.where("target = 't'")).collect()
    by_check = {r.check: json.loads(r.evidence) for r in found}
    assert [k["key"] for k in by_check["extreme_lora_weights"]["extreme_keys"]] == ["half", "hot", "ints"]
    assert by_check["lora_embed_modification"]["modified_keys"] == ["EMBED_x"]
    assert by_check["lora_lm_head_modification"]["modified_keys"] == ["LM_HEAD"]
    headers = decode_tensors(files.where("target = 't'"), with_values=False)
    assert headers.count() == 9 and tensors.layer_inventory(headers).where("key = 'hot'").first().shape == [2]
    read.unpersist()


def test_large_adapters_are_read_by_ranges(spark, tmp_path):
    big = np.linspace(-3, 3, 5000, dtype="<f4").reshape(50, 100)
    big[41, 7] = -77.0
    holes = np.ones(3000, dtype="<f8")
    holes[2900] = np.nan
    good = safetensors_bytes({"big": ("F32", big), "holes": ("F64", holes), "empty": ("F32", np.zeros((0, 4), dtype="<f4")), "odd": ("F8", np.zeros(3, dtype="u1")),
                              **{f"small{i}": f32(float(i)) for i in range(40)}})
    rows = []
    for target, data in {"good": good, "cut": good[:-9000], "junk": b"\x01"}.items():
        path = put(tmp_path, f"{target}/a.safetensors", data)
        rows.append((target, "a.safetensors", str(path), data))
    rows.append(("gone", "a.safetensors", str(tmp_path / "gone.safetensors"), b""))
    files = spark.createDataFrame(rows, "target string, relpath string, path string, content binary")

    def told(df):
        return sorted((str(tuple(r)) for r in df.where("target <> 'gone'").collect()))

    want = told(decode_tensors(files))
    for piece in (800, 8000, 1 << 26):
        got = read_tensors(files, piece=piece)
        assert told(got) == want
        assert [r.read_status for r in got.where("target = 'gone'").collect()] == ["unreadable"]
    top = {r.key: r for r in read_tensors(files.where("target = 'good'"), piece=800).collect()}
    assert len(top) == 44 and top["big"].max_abs == 77.0 and top["holes"].has_nan and top["odd"].read_status == "unsupported_dtype"
    # one file becomes many rows, each for a task to open; small tensors share one
    ranges = tensor_ranges(files.where("target = 'good'"), 800).collect()
    assert 50 < len(ranges) < 70 and all(sum(x.size for x in r.ranges) < 1600 for r in ranges)
    assert told(read_tensors(files.where("target <> 'gone'"), with_values=False)) == told(decode_tensors(files, with_values=False))


def test_adapter_risk(spark):
    rows = [("low", "x.q_proj.lora_A"), ("high", "embed_tokens"), ("high2", "a.LM_HEAD"), ("mid", "mlp.gate_proj")]
    df = spark.createDataFrame(rows, "target string, key string")
    targets = spark.createDataFrame([(t,) for t, _ in rows] + [("none",)], "target string")
    got = {r.target: (r.layers, r.risk) for r in tensors.adapter_risk(df, targets).collect()}
    assert got == {"low": (1, "low"), "high": (1, "high"), "high2": (1, "high"), "mid": (1, "medium"), "none": (0, "unknown")}


# --- provenance, project, supply chain ------------------------------------------------


def test_provenance(spark):
    texts = _texts(spark, [
        ("full", "provenance.json", '{"source":"a","created_at":null,"checksum":"c"}'),
        ("part", "dataset_provenance.json", '{"source":"a"}'), ("bad", "chain_of_custody.json", "not valid json {{{"),
        ("deep", "x/provenance.json", "{"),
    ])
    assert _checks(provenance.provenance_findings(texts)) == [("bad", "corrupt_provenance"), ("part", "incomplete_provenance")]


def test_source_links(spark):
    texts = _texts(spark, [
        ("a", "m.json", '{"source_url": "not-a-url"}'), ("b", "m.json", '{"url": "https://x"}'),
        ("c", "m.json", '{"source_url": "", "d": {"e": {"origin": "x"}}, "f": [{"url": "skipped"}]}'),
        ("d", "m.json", '{"url": "http://ok", "d": {"url": "shadowed"}}'), ("e", "m.json", '[{"url": "x"}]'),
        ("f", "m.json", '{"url": 5}'), ("g", "m.json", '{"\\u0075rl": "esc"}'), ("h", "sub/m.json", '{"url": "x"}'),
        ("i", "m.json", '\n {"url": "HTTPS://upper"}'),
    ])
    found = provenance.source_url_findings(texts)
    assert [c[0] for c in _checks(found)] == ["a", "c", "f", "g", "i"]
    assert {r.url for r in provenance.source_links(texts).where("target = 'f'").collect()} == {"5"}
    shown = _texts(spark, [("j", "m.json", '{"url": 0, "a": {"url": false, "source_url": [], "b": {"url": ["x"]}}}'), ("k", "m.json", '{"a": {"url": "x"}, "a": {"url": "y"}}')])
    assert sorted((r.target, r.url) for r in provenance.source_links(shown).collect()) == [("j", '["x"]'), ("k", "y")]


def test_source_links_at_any_depth(spark):
    def nested(depth):
        return '{"k":' * depth + '{"url":"x"}' + "}" * depth

    texts = _texts(spark, [("z", "m.json", nested(150)), ("y", "m.json", nested(1200)), ("x", "m.json", "{" * 10 + '"url"')])
    assert [(r.target, r.url) for r in provenance.source_links(texts).collect()] == [("z", "x")]
    assert _checks(provenance.source_url_findings(texts)) == [("y", "oversized_document"), ("z", "invalid_source_url")]


def test_project_files(spark):
    env = '\n'.join(['HF_TOKEN="123456789"', "OPENAI_API_KEY='12345678'", "# AWS_SECRET=123456789", "export HF_TOKEN=123456789",
                     " WANDB_API_KEY = \"'abc=defgh'\" ", "AWS_SECRET", "OTHER=123456789", "\tHF_TOKEN=abcdefghi\r"])
    texts = _texts(spark, [
        ("a", ".env", env), ("a", ".env.local", "GOOGLE_KEY=abcdefghi"), ("a", "sub/.env", "GOOGLE_KEY=abcdefghi"),
        ("a", "requirements-dev.txt", "torch\n # indented\n#x\nscikit-learn\nnumpy==1\nñandu\n\tpandas \n"),
        ("b", "conf.yml", 'api_key = "secret_key_12345678"'), ("b", "training_config.json", "password: 'abcdefgh'"),
        ("b", "other.json", "password: 'abcdefgh'"), ("b", "s.py", "torch.load(x, pickle_module=p)\nHF_TOKEN = \"abcdefgh\"\nexec(1)"),
        ("b", "deploy-prod.yaml", "user: root"), ("b", "docker-compose.x.yml", "0.0.0.0"), ("b", "notes.txt", "USER root"),
    ])
    keys = sorted((r.file, json.loads(r.evidence)["key"]) for r in project.env_findings(texts).collect())
    assert keys == [(".env", "HF_TOKEN"), (".env", "HF_TOKEN"), (".env", "WANDB_API_KEY"), (".env.local", "GOOGLE_KEY")]
    unpinned = project.requirement_findings(texts).first()
    assert json.loads(unpinned.evidence)["unpinned"] == ["torch", "ñandu", "pandas"]
    rules_hit = project.script_and_config_findings(texts)
    got = sorted((r.check, r.file) for r in rules_hit.select("check", "file").collect())
    assert got == [
        ("credential_in_config", "conf.yml"), ("credential_in_config", "training_config.json"),
        ("hardcoded_credential", "s.py"), ("hardcoded_credential", "s.py"), ("suspicious_import", "s.py"),
        ("unsafe_model_load", "s.py"),
    ]
    deploy = sorted((r.check, r.file) for r in supply_chain.deployment_findings(texts).collect())
    assert deploy == [("exposed_port", "docker-compose.x.yml"), ("root_deployment", "deploy-prod.yaml")]


def test_base_models_and_cards(spark):
    texts = _texts(spark, [
        ("a", "config.json", '{"_name_or_path": "base"}'), ("b", "config.json", '{"_name_or_path": "", "base_model": "x"}'),
        ("c", "config.json", "{"), ("c", "adapter_config.json", '{"base_model_name_or_path": "x"}'),
        ("d", "x/config.json", '{"_name_or_path": "base"}'), ("a", "README.md", "TRAINING evaluation limitations bias"),
        ("b", "README.md", "none"),
    ])
    targets = spark.createDataFrame([(t,) for t in "abcde"], "target string")
    known = {r.target for r in supply_chain.base_models(targets, texts).where("base_model_known").collect()}
    assert known == {"a", "c"}
    assert [r.target for r in supply_chain.card_findings(texts).collect()] == ["b"]


# --- scorecards, scores, exports -------------------------------------------------------


def test_compliance(spark):
    files = _listing(spark, [("a", "SECURITY.md", 1), ("a", "tests/t.txt", 1), ("a", "weight_manifest.json", 1),
                             ("b", "sub/SECURITY.md", 1), ("b", "test_x.py", 1)])
    rows, card = compliance.check_compliance(files, "nist")
    passed = {(r.target, r.check) for r in rows.where("status = 'pass'").collect()}
    assert passed == {("a", "risk_management_policy"), ("a", "incident_response"), ("a", "incident_tracking"),
                      ("a", "testing_procedures"), ("b", "testing_procedures")}
    assert {r.target: r.score for r in card.where("function is null").collect()} == {"a": 33, "b": 8}
    _, owasp = compliance.check_compliance(files, "owasp")
    assert {r.target: r.score for r in owasp.collect()} == {"a": 10, "b": 0}
    with pytest.raises(ValueError):
        compliance.check_compliance(files, "other")


def _found(spark, rows):
    """rows: (target, severity, category, check, detail)"""
    full = [(t, "pipeline", c, s, k, None, d, '{"file": "f"}', "") for t, s, c, k, d in rows]
    return spark.createDataFrame(full, ", ".join(f"`{c}` string" for c in fo.FINDING_COLUMNS))


def test_scores(spark):
    crit = ("critical", "supply_chain", "x", "d")
    rows = [("five", *crit)] * 5 + [("three", *crit)] * 3 + [("mix", "high", "a", "x", "d"), ("mix", "low", "b", "x", "d")]
    found = _found(spark, rows)
    got = {r.target: r for r in fo.scan_summary(found).collect()}
    assert (got["five"].risk_score, got["three"].risk_score, got["mix"].risk_score) == (100, 75, 18)
    assert (got["five"].verdict, got["mix"].verdict) == (2, 1) and got["mix"].categories == ["a", "b"]
    assert (got["three"].risk_band, got["mix"].risk_band) == ("high", "low")
    assert {r.target: r.rate_limit for r in export.rate_limits(found).collect()} == {"five": 20, "three": 33, "mix": 100}
    assert {r.target: r.trust_score for r in fo.trust_scores(found).collect()} == {"five": 0, "three": 10, "mix": 75}
    order = [r.severity for r in fo.by_severity(found).collect()]
    assert order == ["critical"] * 8 + ["high", "low"]


def test_policy_and_events(spark):
    found = _found(spark, [
        ("a", "high", "lora_backdoor", "suspicious_target_modules", "Adapter has suspicious modules: lm_head, embed_tokens"),
        ("b", "medium", "pipeline_vulnerability", "suspicious_import", "Suspicious call in x.py: import subprocess"),
        ("c", "low", "supply_chain", "x", "please run curl"), ("d", "high", "supply_chain", "x", "please run curl"),
        ("e", "high", "lora_backdoor", "lora_x", "target_modules: a_proj, b_head other"), ("f", "odd", "unknown", "x", "d" * 600),
    ])
    denied = {}
    for r in export.denied_tools(found).collect():
        denied.setdefault(r.target, set()).add(r.tool)
    assert denied == {"a": {"lm_head", "embed_tokens"}, "b": {"exec", "shell", "bash", "sudo"}, "d": {"exec", "network"},
                      "e": {"a_proj", "b_head"}}
    events = {r.scan_target: r for r in export.taxonomy_events(found, {"high": 7}, {"HIGH": 0.8}).collect()}
    assert (events["a"].attack_category, events["a"].detection_method, events["a"].confidence) == (
        "TOOL_POISONING", "TOOL_POISONING", "HIGH")
    assert events["a"].risk_score == 7 * 80 // 25 and events["a"].target == "f"
    f = events["f"]
    assert (f.attack_category, f.detection_method, f.severity, f.confidence) == ("ANOMALY", "ANOMALY_DETECTOR", "medium", "MEDIUM")
    assert len(f.snippet) == 500 and len(f.description) == 600


def test_redaction_and_ids(spark):
    rows = [("/home/user/models/test", "at /tmp/test123/x and ./data/file.json", '{"a":"/Users/bob/x","l":["/home/zoe"],"n":1}')]
    df = spark.createDataFrame(rows, "target string, detail string, evidence string")
    r = fo.redact_paths(df).first()
    assert r.target == "/home/<redacted>/models/test" and r.detail == "at /tmp/<redacted>/x and ./data/file.json"
    assert json.loads(r.evidence) == {"a": "/Users/<redacted>/x", "l": ["/home/zoe"], "n": 1}
    stamped = fo.stamp(df, "2024-01-01T00:00:00").first()
    assert stamped.scan_id == sha("/home/user/models/test:2024-01-01T00:00:00")[:16]
    assert scores.risk_band is not None


def test_first_n_is_a_group_limit(spark):
    df = spark.range(1000).withColumn("k", F.concat(F.lit("hot"), (F.col("id") % 2).cast("string")))
    top = fo.first_n(df, ["k"], ["id"], F.col("id"), 3, "v")
    assert {r.k: r.v for r in top.collect()} == {"hot0": [0, 2, 4], "hot1": [1, 3, 5]}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
