"""Stored profiles equal those of one pass, however the data was split."""

import json

import pytest

from hubwarden.operators import profile_store
from hubwarden.operators.dataset_stats import profile_of_facts
from hubwarden.streaming.profiles import entry_rows, keep_profiles

SCHEMA = "target string, relpath string, name string, depth int, size long, is_file boolean, is_symlink boolean, content binary, kind string"


def _lines(file, lines):
    data = "".join(x + "\n" for x in lines).encode()
    return ("t", file, file, 0, len(data), True, False, data, "lines")


def _entry(i):
    return json.dumps({"role": ("user", "assistant")[i % 2], "content": "word " * (i % 7 + 1)})


GOOD = [_entry(i) for i in range(60)] + [_entry(3)] * 9 + [json.dumps({"content": "x" * 4000})]


def _rows(profile):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in profile.select(*sorted(profile.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def whole(spark):
    rows = spark.createDataFrame([_lines("a.jsonl", GOOD), _lines("b.jsonl", GOOD[:20])], SCHEMA)
    out = _rows(profile_of_facts(entry_rows(rows).where("NOT broken")))
    assert len(out) == 2
    return out


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_any_split(spark, tmp_path, whole, cut):
    path = str(tmp_path / "counts")
    for i in range(cut):
        rows = [_lines("a.jsonl", GOOD[i::cut]), _lines("b.jsonl", GOOD[:20][i::cut])]
        facts = entry_rows(spark.createDataFrame(rows, SCHEMA))
        profile_store.save_counts(facts, path, i)
        profile_store.save_counts(facts, path, i)  # a repeated run counts once
        if i == 2:
            profile_store.compact(spark, path)
    assert _rows(profile_store.stored_profile(spark, path)) == whole
    profile_store.compact(spark, path)
    assert _rows(profile_store.stored_profile(spark, path)) == whole
    assert profile_store.vacuum(spark, path) == {1: 0, 2: 2, 5: 6}[cut]
    assert _rows(profile_store.stored_profile(spark, path)) == whole


def test_one_malformed_part_takes_the_file_out(spark, tmp_path, whole):
    path = str(tmp_path / "counts")
    for i, rows in enumerate([[_lines("a.jsonl", GOOD), _lines("b.jsonl", GOOD[:20])], [_lines("b.jsonl", ["{", "]"])], []]):
        profile_store.save_counts(entry_rows(spark.createDataFrame(rows, SCHEMA)), path, i)
    left = [r for r in whole if "a.jsonl" in r]
    assert len(left) == 1 and _rows(profile_store.stored_profile(spark, path)) == left
    profile_store.compact(spark, path)
    assert _rows(profile_store.stored_profile(spark, path)) == left


def test_stream_equals_batch(spark, tmp_path, whole):
    landed, path = str(tmp_path / "landed"), str(tmp_path / "counts")
    for i in range(3):
        rows = [_lines("a.jsonl", GOOD[i::3]), _lines("b.jsonl", GOOD[:20][i::3])]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)
        query = keep_profiles(stream, path).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.exception()
    assert _rows(profile_store.stored_profile(spark, path)) == whole
