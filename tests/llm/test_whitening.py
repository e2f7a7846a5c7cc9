"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubwarden.llm import whitening
from hubwarden.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def whole(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)


def compared(rows, vectors, most=32):
    """Rows (vec_id, ...) of one length against a whole computation; ``vectors``: {vec_id: vector}."""
    x = whole(vectors.values())
    n, sums = len(x), x.sum(axis=0)
    deviation = {k: int(sum((n * a - s) ** 2 for a, s in zip(v, sums))) for k, v in zip(vectors, x)}
    a = ((n * x - sums) / n).astype(float)
    values, basis = np.linalg.eigh(a.T @ a / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()) if n > 1 and values[0] > 0 else 0)
    assert len(rows) == n * k
    if not k:
        return
    got = np.zeros((n, k))
    place = {v: i for i, v in enumerate(vectors)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, int(r.deviation)) == (n, deviation[r.vec_id])
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-6
        assert r.identity_error < 1e-6
    want = a @ basis[:, :k] / np.sqrt(values[:k])
    apart = [i for i in range(k) if all(abs(values[i] - values[j]) > 1e-6 * values[0] for j in (i - 1, i + 1) if 0 <= j < len(values))]
    for i in apart:
        assert np.abs(want[:, i] * np.sign(want[:, i] @ got[:, i]) - got[:, i]).max() < 1e-5
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-6
    assert len({r.identity_error for r in rows}) == 1


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    compared(LLM_QUERIES["op12_shifted_cholesky"](spark, sf).collect(), vectors)


@pytest.mark.parametrize("kind", ["plain", "ill", "rank", "one dimension", "large", "many"])
def test_against_whole_matrices(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    if kind == "ill":
        x = x * 10.0 ** np.array([4, 3, 2, 1, 0, -1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    elif kind == "rank":
        x[:, 4], x[:, 5] = np.floor(8 * x[:, 0]) / 8, 3.0
        x[:, 0] = x[:, 4]
    elif kind == "one dimension":
        x = x[:, :1]
    elif kind == "large":
        x = x * 1e6
    elif kind == "many":
        x = rng.normal(size=(200, 40)) + 100
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA)
    compared(whitening.whiten(df, most=5).collect(), dict(enumerate(x)), most=5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)]
    bad = [(20, None), (21, [nan, 1.0, 1.0]), (22, [1.0, None, 2.0]), (23, [inf, 0.0, 0.0]), (24, [])]
    pairs = [(30 + i, [float(i), 2.0 - i]) for i in range(4)]
    df = spark.createDataFrame([*good, *bad, *pairs, (None, [5.0]), (40, [5.0])], SCHEMA)
    clash = df.select("embedding", "vec_id", *[F.lit("x").alias(c) for c in ("key", "v", "n", "w", "component")])
    rows = whitening.whiten(clash).collect()
    compared([r for r in rows if r.vec_id < 20], dict(good))
    compared([r for r in rows if r.vec_id >= 30], dict(pairs))
    assert {r.vec_id for r in rows} == {*range(9), *range(30, 34)}  # the vectors of one entry have no variance
    assert whitening.whiten(df.where("false")).count() == 0
    again = whitening.whiten(spark.createDataFrame([*good, good[0], (None, good[1][1])], SCHEMA)).collect()
    assert len(again) == 11 * len({r.component for r in again}) and {r.n for r in again} == {11}


def test_solve_and_factor():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 7))
    r = whitening._cholesky(a.T @ a, 50, False)
    assert np.allclose(whitening.solved(a, r) @ r, a) and np.allclose(np.tril(r, -1), 0)
    zero = whitening._cholesky(np.ones((3, 3)), 50, False)
    assert np.isfinite(zero).all() and (np.diag(zero) > 0).all()
