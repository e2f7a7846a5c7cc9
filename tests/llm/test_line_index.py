"""Line dedup against brute force, and the perfect hash by itself."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubwarden.llm import line_index

A = "A line of text that is long enough to be looked at, for sure"
B = "ünïcödé ünïcödé ünïcödé ünïcödé ünïcödé1"  # 40 code points
SCHEMA = "doc_id long, text string"


def brute(rows, least=40, documents=5):
    def key(line):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip("\x20\t\n\v\f\r"))

    held, last = collections.Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, float("-inf")), float("-inf") if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        mine = float("-inf") if d is None else d
        kept = [x for x in lines if len(key(x)) < least or held[key(x)] < documents or last[key(x)] == mine]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in found.collect()), key=str)


CASES = {
    "copies": [(i, f"own {i}\n {A.upper()}\t\nend") for i in range(7)] + [(3, f"{A}\n{A}\nx"), (3, f"{A}\n{A}\nx")],
    "below": [(i, A) for i in range(4)] + [(9, A[:39])],
    "unicode": [(i, f"{B}\r\n\n{B[1:]}") for i in range(6)],
    "odd": [(None, A), (None, A), (1, None), (2, ""), (4, "\n\n"), (5, A), (6, A), (7, A), (-8, f"{A}\n" * 300)],
    "no ids": [(None, f"{A}\n{i}") for i in range(6)],
    "long": [(i, "\n".join(f"{A} {j % (i + 7)}" for j in range(3000))) for i in range(12)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA)
    assert rows_of(line_index.deduplicated(df)) == brute(CASES[name])


def test_other_limits(spark):
    rows = CASES["copies"] + CASES["odd"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(line_index.deduplicated(df, least_chars=1, documents=2)) == brute(rows, 1, 2)
    with pytest.raises(ValueError):
        line_index.deduplicated(df, documents=1)


def test_more_columns_and_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(line_index, "_SHARD", 4)
    monkeypatch.setattr(line_index, "_HOT", 2)
    rows = [(i, "\n".join([A] * (i % 2) + [f"{A} {i // 6}", f"{A} {i % 9}"])) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("x") for c in ("key1", "line", "h1", "n_lines", "gone", "row", "shard", "part", "new")}).withColumn("a.b", F.lit(1))
    found = line_index.deduplicated(clash)
    assert found.columns == [*[c for c in clash.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert rows_of(found) == brute(rows)


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql(f"SELECT id AS doc_id, cast(unhex('ff' || hex('{A}') || '0A61') AS string) AS text FROM range(6)")
    found = line_index.deduplicated(df).selectExpr("doc_id", "hex(text) AS text", "n_dropped").collect()
    assert {(r.doc_id, r.text, r.n_dropped) for r in found if r.doc_id < 5} == {(i, "61", 1) for i in range(5)}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    h1[: n // 2] = 7  # one half decides alone
    slots, sizes, bits, ranks = line_index.perfect_hash(h1, h2)
    assert sorted(slots) == list(range(n))
    assert (line_index.slots_of(sizes, bits, ranks, h1, h2) == slots).all()
    assert n < 1000 or 64 * len(bits) < 4.2 * n
    other = line_index.slots_of(sizes, bits, ranks, h2, h1)
    assert ((other >= -1) & (other < max(n, 1))).all()
