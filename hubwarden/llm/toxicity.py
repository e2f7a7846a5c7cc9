"""Document toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence has
the logit ``z = b + sum of its features' weights`` and a document is toxic if
any sentence is: ``P = 1 - prod(1 - sigmoid(z))`` (noisy-or), which equals
``1 - exp(-A)`` with ``A = sum softplus(z)``.  Weights are fitted to document
labels alone, and the fitted sentence scores then locate the offending ones.

Features of a word are the word and its first three to six letters; weights are
not negative, so a sentence's length by itself makes it neither toxic nor clean.

The model is fitted on at most ``sample`` labelled documents (a uniform choice
by hash); their sentences are reduced on the executors to the features that
occur mainly in toxic documents before anything reaches the driver.  Scoring
reads each text once, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hubwarden.llm.common import per_stage
from hubwarden.session import stage

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]?")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)
_CACHE = 400_000


def features(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing ``*``)."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


def folded(text: str) -> str:
    """Lower case, character by character where the length would change otherwise."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; a text without any is one empty sentence."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


@dataclass
class Model:
    """Weights by feature, the logit of a sentence without any, and a cache of word weights."""

    weights: dict[str, float]
    bias: float
    seen: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "seen": {}}

    def word(self, word: str) -> float:
        value = self.seen.get(word)
        if value is None:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            value = self.seen[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or score, and the (start, end, probability) of sentences that hold a weighted feature."""
        low = folded(text)
        spans = sentences(low) if any(map(self.word, set(_WORD.findall(low)))) else []
        n = len(spans) or len(_SENTENCE.findall(low)) or 1
        base = np.logaddexp(0, self.bias)
        total, marked = n * base, []
        for a, b in spans:
            if weight := sum(map(self.word, _WORD.findall(low[a:b]))):
                z = self.bias + weight
                total += np.logaddexp(0, z) - base
                marked.append((a, b, float(1 / (1 + np.exp(-z)))))
        return float(-np.expm1(-total)), marked


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 20_000,
    least: int = 3,
    share: float = 0.5,
    rounds: int = 400,
    penalty: float = 0.002,
) -> Model:
    """Fit on at most ``sample`` labelled documents.

    ``labels``: (key, label 0 or 1); rows with a null key or label take no part
    and of repeated keys the larger label holds.  A null text is empty.  A
    feature is a candidate if it occurs in ``least`` toxic documents or more and
    at least ``share`` of the documents with it are toxic.  Without toxic rows
    the model gives every sentence the same small probability.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("own")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("own"), "own").limit(sample)
    rows = docs.select(F.col(key).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the broadcast side has no more than ``sample`` rows of two numbers
    bags = stage(rows.join(F.broadcast(chosen), "own").select("text", "toxic"), "labelled")
    # one row per bag and feature
    present = bags.mapInArrow(_features, "toxic int, feature string")
    counts = present.groupBy("feature").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    chosen = counts.where((F.col("pos") >= least) & (F.col("pos") >= share * F.col("n"))).select("feature")
    names = sorted(r[0] for r in chosen.collect())  # no more than the sample's features
    index = {f: i for i, f in enumerate(names)}
    held = bags.mapInArrow(_instances(index), "toxic int, n int, sentence array<int>, feature array<int>").collect()
    return _fitted(held, names, rounds, penalty)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per_stage(None)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = {f for w in set(_WORD.findall(folded(text))) for f in features(w)}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(list(own))], ["toxic", "feature"])


def _instances(index: dict[str, int]):
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int32()), ("sentence", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                low, at, what = folded(text), [], []
                spans = sentences(low)
                for i, (a, b) in enumerate(spans):
                    for w in _WORD.findall(low[a:b]):
                        for f in features(w):
                            if f in index:
                                at.append(i)
                                what.append(index[f])
                rows.append((toxic, len(spans), at, what))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _fitted(held: list, names: list[str], rounds: int, penalty: float) -> Model:
    """Projected gradient steps (Adam) on the likelihood of the bags' labels."""
    bias = -8.0
    y = np.array([r["toxic"] for r in held], float)
    if not names or not len(y):
        return Model({}, bias)
    count = np.array([r["n"] for r in held], float)
    bag, key, what = [], [], []
    for i, r in enumerate(held):
        at, own = np.unique(np.array(r["sentence"], np.int64), return_inverse=True)
        key.append(own)
        bag.append(np.full(len(at), i))
        what.append(np.array(r["feature"], np.int64))
    offsets = np.cumsum([0, *map(len, bag)])
    key = np.concatenate([k + o for k, o in zip(key, offsets)]).astype(np.int64)
    bag, what = np.concatenate(bag).astype(np.int64), np.concatenate(what).astype(np.int64)
    plain = count - np.bincount(bag, minlength=len(y))  # sentences without a candidate
    w = np.full(len(names), 1.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(key, w[what], minlength=len(bag))
        soft, base = np.logaddexp(0, z), np.logaddexp(0, bias)
        total = np.maximum(plain * base + np.bincount(bag, soft, minlength=len(y)), 1e-12)
        # d(-log likelihood) / dA
        slope = np.where(y > 0, -np.exp(-total) / -np.expm1(-total), 1.0) / len(y)
        dz = slope[bag] / (1 + np.exp(-z))
        grad = np.append(np.bincount(what, dz[key], minlength=len(w)) + penalty / len(names), (slope * plain).sum() / (1 + np.exp(-bias)) + dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w = np.maximum(0.0, w - move[:-1])
        bias = float(np.clip(bias - move[-1], -16.0, -6.0))
    return Model({f: float(x) for f, x in zip(names, w) if x > 0.05}, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, offending) per row: noisy-or score of the whole text and its sentences of probability 0.5 or more.

    ``offending``: array of (start, end, probability), code points, in text
    order.  Null and empty texts have the score of one empty sentence.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # no larger than the sample's features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        own = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            scored = [own.document(t.as_py() or "") for t in batch.column(1)]
            marked = [[{"start": a, "end": b, "probability": p} for a, b, p in found if p >= 0.5] for _, found in scored]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in scored], pa.float64()), pa.array(marked, span)], [key, "score", "offending"])

    wanted = docs.select(key, text)
    return wanted.mapInArrow(run, f"{key} {kind}, score double, offending array<struct<start:int,end:int,probability:double>>")


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` as they are, and the noisy-or score of each text in the new column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        own = shared.value
        for batch in batches:
            scores = [own.document(t.as_py() or "")[0] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
