import json

from pyspark.sql import functions as F

from hubwarden import sinks
from hubwarden.operators import findings as fo
from hubwarden.operators import weights


def test_findings_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("t", 3)], "target string, n int")
    found = fo.attach_attack_label(
        fo.finding(rows, "no_weight_files", F.lit("none"), fo.evidence(path=F.col("target"), n=F.col("n")))
    )
    shown = json.loads(sinks.findings_json(found).first().finding)
    assert shown["evidence"] == {"n": 3, "path": "t"} and shown["check"] == "no_weight_files"
    sinks.save_findings(found, str(tmp_path / "f"))
    sinks.save_findings(found, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 2 and back.first().mitre_atlas.startswith("AML.T0017")
    sinks.save_findings(found, str(tmp_path / "j"), fmt="json")
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_fingerprint_tables(spark, tmp_path):
    hashed = spark.createDataFrame(
        [("a", "w.bin", "w.bin", 0, 7, "00"), ("a", "v.bin", "v.bin", 0, 8, "11")],
        "target string, relpath string, name string, depth int, size long, sha256 string",
    )
    sinks.save_fingerprints(*weights.fingerprints(hashed), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/files")).count() == 2
    assert spark.read.parquet(str(tmp_path / "p/fingerprints")).first().total_size == 15


def test_every_check_has_a_known_severity_and_advice():
    from hubwarden import rules
    from hubwarden.checks import CHECKS, SCAN_TYPE_OF_CATEGORY

    added = {"invalid_utf8", "unreadable_adapter", "unreadable_file", "unreadable_directory", "oversized_document"}
    assert added < set(CHECKS) and len(CHECKS) == 52 + len(added)
    assert set(rules.ATTACK_OF_CHECK) <= set(CHECKS) and len(rules.ATTACK_OF_CHECK) == 24
    assert set(rules.METHOD_OF_CHECK) <= set(CHECKS) and len(rules.METHOD_OF_CHECK) == 15
    for check in CHECKS.values():
        assert check.severity in rules.SEVERITIES and check.category in SCAN_TYPE_OF_CATEGORY
