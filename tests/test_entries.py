import json
import statistics

import pytest
from pyspark.sql import functions as F

from hubwarden.functions import jsonv
from hubwarden.operators import dataset_stats, poisoning
from hubwarden.sources import entries as en
from hubwarden.sources.text import text_lines, to_text


def _files(spark, **texts):
    rows = [("t", n.replace("__", "."), n.replace("__", "."), 0, t) for n, t in texts.items()]
    return spark.createDataFrame(rows, "target string, file string, name string, depth int, text string")


def test_presence_decides_not_null(spark):
    docs = [
        {"content": "abc"},
        {"content": None, "text": "ignored"},
        {"text": "wxyz"},
        {"other": 1},
        {"content": ["list"]},
        {"content": 12},
        "bare string",
        7,
        None,
        [1, 2],
    ]
    got = en.describe_entries(en.json_entries(_files(spark, a__json=json.dumps(docs)))).orderBy("pos").collect()
    assert [r.measured for r in got] == ["abc", None, "wxyz", "", None, None, None, None, None, None]


def test_single_documents_and_bad_files(spark):
    files = _files(spark, a__json='{"role": "User"}', b__json="5", c__json="not json", d__json="[]", e__json="[[1],[2]]")
    got = en.json_entries(files).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in got} == {"a.json": 1, "b.json": 1, "e.json": 2}


def test_jsonl_is_all_or_nothing(spark):
    files = _files(
        spark,
        good__jsonl='{"role": "user"}\n\n  \n{"role": 5}\nnull\n',
        bad__jsonl='{"role": "user"}\n{oops\n',
        empty__jsonl="\n\n",
    )
    got = en.describe_entries(en.jsonl_entries(files)).orderBy("pos").collect()
    assert [(r.file, r.role) for r in got] == [("good.jsonl", "user"), ("good.jsonl", None), ("good.jsonl", None)]
    lines = text_lines(files).select("file", "line")
    kept = en.entries_of_lines(lines, ["file"]).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in kept} == {"good.jsonl": 3}


def test_entry_keys(spark):
    texts = ['{"a":1,"b":2}', '{"b": 2, "a": 1}', '{"a":1.0,"b":2}', '{"a":"1","b":2}', '{"a":1.00,"b":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    keys = [r.k for r in df.select("i", jsonv.canonical_key(jsonv.parse(F.col("t"))).alias("k")).orderBy("i").collect()]
    assert keys[0] == keys[1] and keys[2] == keys[4]
    assert len({keys[0], keys[2], keys[3]}) == 3


def test_repeated_keys_when_allowed(spark):
    en.allow_repeated_keys(spark)
    try:
        got = en.json_entries(_files(spark, a__json='{"content": "x", "content": "last"}'))
        assert en.describe_entries(got).first().measured == "last"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


@pytest.mark.parametrize("value, expected", [
    ("null", False), ('""', False), ("0", False), ("0.0", False), ("false", False), ("[]", False), ("{}", False),
    ('"0"', True), ("1", True), ("[0]", True), ("true", True), ('"x"', True),
])
def test_truthiness(spark, value, expected):
    df = spark.createDataFrame([('{"k": ' + value + "}",)], "t string")
    v = jsonv.parse(F.col("t"))
    row = df.select(jsonv.truthy(jsonv.member(v, "k")).alias("x"), jsonv.truthy(jsonv.member(v, "z")).alias("y")).first()
    assert (row.x, row.y) == (expected, False)


def _profile(spark, items, **kw):
    files = _files(spark, a__json=json.dumps(items))
    return dataset_stats.file_profile(en.dataset_entries(files), **kw)


def _checks(df):
    return {r.check for r in df.select("check").collect()}


def test_statistics_thresholds(spark):
    lengths = [100] * 50 + [50_000, 60_000, 70_000, 80_000]
    p = _profile(spark, [{"content": "x" * n} for n in lengths]).first()
    assert p.n == 54 and p.mean_length == pytest.approx(statistics.fmean(lengths))
    assert p.sd_length == pytest.approx(statistics.pstdev(lengths))
    sd, mean = p.sd_length, p.mean_length
    assert p.outliers == sum(abs(n - mean) > 3 * sd for n in lengths)
    nine = dataset_stats.analyze_dataset_stats(_profile(spark, [{"content": "x"}] * 9))
    assert _checks(nine) == set()
    ten = dataset_stats.analyze_dataset_stats(_profile(spark, [{"content": "x"}] * 10))
    assert _checks(ten) == {"short_entries"}
    # exactly 5 % short entries stay quiet
    edge = [{"content": "x"}] + [{"content": "long enough text"}] * 19
    assert _checks(dataset_stats.analyze_dataset_stats(_profile(spark, edge))) == set()
    noisy = "".join(chr(32 + i % 95) for i in range(200))
    mixed = [{"content": noisy}] * 15 + [{"content": "normal text here"}] * 5
    assert _checks(dataset_stats.analyze_dataset_stats(_profile(spark, mixed))) == {"high_entropy_content"}


def test_copies_and_roles(spark):
    five, six = [{"content": "a"}] * 5, [{"content": "b"}] * 6
    p = _profile(spark, five + six + ["s"] * 6).first()
    assert (p.entries, p.duplicate_count, p.n) == (17, 2, 11)
    turns = [{"role": "Assistant", "content": str(i)} for i in range(9)] + [{"role": "user"}] + [{"role": "tool"}] * 5
    edge = _profile(spark, turns)
    assert edge.first().assistant_ratio == 0.9
    assert _checks(poisoning.replay_and_role_findings(edge)) == set()
    more = _profile(spark, turns + [{"role": "assistant", "content": "one more"}])
    assert _checks(poisoning.replay_and_role_findings(more)) == {"role_imbalance"}


def test_profile_does_not_depend_on_partitioning(spark):
    items = [("k%d" % (i % 3), "x" * (i * 7 % 101), ["user", "assistant", None][i % 3]) for i in range(900)]
    df = spark.createDataFrame(items, "k string, measured string, role string").withColumn(
        "entry_key", F.sha2(F.concat_ws("|", "k", "measured", "role"), 256)
    )
    results = []
    for n in (1, 3, 17):
        rows = dataset_stats.file_profile(df.repartition(n), ["k"]).orderBy("k").collect()
        results.append([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows])
    assert results[0] == results[1] == results[2]
    whole = dataset_stats.text_profile(df, ["k"], "measured").orderBy("k").collect()
    assert [r.n for r in whole] == [300] * 3


def test_bytes_to_text(spark):
    rows = [
        ("t", "ok.txt", 3, b"a\r\nb\rc"),
        ("t", "bad.txt", 3, b"[SYSTEM OVERRIDE]\xff tail"),
        ("t", "big.txt", 999, b"read all the same"),
        ("t", "none.txt", 1, None),
    ]
    files = spark.createDataFrame(rows, "target string, relpath string, size long, content binary")
    got = {r.file: r for r in to_text(files).collect()}
    assert set(got) == {"ok.txt", "bad.txt", "big.txt", "none.txt"}
    assert got["big.txt"].text == "read all the same" and got["none.txt"].text is None
    assert got["ok.txt"].text == "a\nb\nc" and got["ok.txt"].utf8_ok
    assert not got["bad.txt"].utf8_ok and got["bad.txt"].text.endswith(" tail")
    texts = to_text(files)
    assert [r.file for r in poisoning.read_failures(texts).collect()] == ["none.txt"]
    assert _checks(poisoning.encoding_gate(texts)) == {"invalid_utf8"}
    assert _checks(poisoning.encoding_gate(texts, compat=True)) == {"file_too_large"}
    assert poisoning.poisoned_texts(texts).count() == 1
    with pytest.raises(Exception, match="size limit"):
        text_lines(texts, max_bytes=10).count()
