"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never gathered.  A pass sums the Gram matrix of the rows
as they stand, the driver takes its Cholesky factor, and the next pass
orthogonalises the rows once more by a triangular solve with it.  The first
factor is taken of a shifted Gram matrix, which keeps it definite however
ill-conditioned the rows are; the later ones repair what the shift and rounding
left.  The product R of the factors is that of A = QR, so the singular values
and right singular vectors of R are those of A: components and their variances,
without squaring the condition of A as the covariance would.

What reaches the driver is one Gram matrix a pass, whatever the number of rows;
what goes to the tasks is the factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PASSES = 5  # Gram passes at most; three do unless the rows lack full rank
_CLOSE = 1e-12  # entries of a Gram matrix this near to the identity need no further pass
_RANK = 1e-13  # components below this share of the largest singular value are rounding
_OFFSET = 1_000_000
_SCALE = 64
_ROWS = 4096
_LIMIT = 2.0**60  # n * x and its sums must stay exact as long


@dataclass
class Basis:
    """Everything about the vectors of one length."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None  # columns: unit eigenvectors
    variances: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0


def integer_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, integer matrix) of a batch whose last column holds vectors.

    An entry c is floor(64 c) + 1,000,000 in double arithmetic.  Vectors that are null, or hold null or
    non-finite entries, or are empty, are left out.
    """
    lists = batch.column(batch.num_columns - 1)
    flat = lists.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        block = values[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(block).all(axis=1)
        at, block = at[good], np.floor(block[good] * _SCALE)
        if np.abs(block).max(initial=0) >= _LIMIT:
            raise ValueError("an entry is too large for exact sums")
        if len(at):
            yield dim, at, block.astype(np.int64) + _OFFSET


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def centred(x: np.ndarray, basis: Basis) -> np.ndarray:
    return (x * basis.n - basis.sums) / basis.n


def _summed(vectors: DataFrame, value: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """Sum over all rows of an array per length: each task adds its rows, Spark adds the tasks by place in the array."""
    whole = kind == "decimal(38,0)"
    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("part", pa.int64() if whole else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in integer_rows(batch):
                for i in range(0, len(x), _ROWS):
                    part = value(dim, x[i : i + _ROWS])
                    held[dim] = held[dim] + part if dim in held else part
        for dim, total in held.items():
            if whole and np.abs(total.astype(float)).max(initial=0) >= _LIMIT:
                raise ValueError("the sums of a task exceed a long")
            at = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(at), pa.array(total.ravel())], schema=schema)

    rows = vectors.mapInArrow(run, f"dim int, place int, part {'long' if whole else 'double'}")
    total = rows.groupBy("dim", "place").agg(F.sum(F.col("part").cast(kind)).alias("total"))
    out: dict[int, dict[int, object]] = {}
    for dim, place, value_ in total.collect():  # as many numbers as the arrays have entries
        out.setdefault(dim, {})[place] = value_
    return {d: np.array([int(v[i]) if whole else v[i] for i in range(len(v))]) for d, v in out.items()}


def _gram(rows: np.ndarray) -> np.ndarray:
    return rows.T @ rows


def _cholesky(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper factor of a Gram matrix of n rows; with a shift where it is asked for or needed."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def _decomposed(basis: Basis, gram: np.ndarray, most: int) -> None:
    """Components from R and the last Gram matrix: A'A = R' gram R."""
    r = np.eye(len(gram))
    for factor in basis.factors:
        r = factor @ r
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, sigma, turned = np.linalg.svd(root @ r)
    keep = sigma > sigma.max(initial=0) * _RANK * max(len(r), 1)
    components = turned[keep].T
    sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    basis.components, basis.variances = (components * sign)[:, :most], (sigma[keep] ** 2 / basis.n)[:most]
    basis.trace = float((sigma**2).sum() / basis.n)


def fit(vectors: DataFrame, most: int = 32) -> dict[int, Basis]:
    """The basis of each length of vector in ``vectors`` (whose last column is the vector): at most ``most`` components.

    Vectors of different lengths are whitened apart.  There is no component
    without variance: a single vector, or equal ones, have none.
    """
    only = vectors.select(vectors.columns[-1])
    sums = _summed(only, lambda dim, x: np.append(x.sum(axis=0), len(x)), "decimal(38,0)")
    model = {}
    for dim, s in sums.items():
        n = int(s[-1])
        if n * float(max(abs(int(v)) for v in s)) >= 2.0**62:
            raise ValueError("vectors and their number are too large for exact deviations")
        model[dim] = Basis(n, s[:-1].astype(np.int64))
    grams: dict[int, np.ndarray] = {}
    open_ = set(model)
    for turn in range(_PASSES):
        if not open_:
            break

        def part(dim: int, x: np.ndarray, open_=frozenset(open_), model=model) -> np.ndarray:
            if dim not in open_:  # nothing is left to do for this length
                return np.zeros((0, 0))
            rows = centred(x, model[dim])
            for factor in model[dim].factors:
                rows = solved(rows, factor)
            return _gram(rows)

        for dim, gram in _summed(only, part, "double").items():
            gram = gram.reshape(dim, dim)
            grams[dim] = gram
            done = turn and np.abs(gram - np.eye(dim)).max() < _CLOSE * dim
            if done or not np.trace(gram) > 0 or turn == _PASSES - 1:
                open_.discard(dim)
            else:
                model[dim].factors.append(_cholesky(gram, model[dim].n, turn == 0))
    for dim, basis in model.items():
        if np.trace(grams[dim]) > 0:
            _decomposed(basis, grams[dim], most)
        else:
            basis.components, basis.variances = np.zeros((dim, 0)), np.zeros(0)
    _check(only, model)
    return model


def whitened(x: np.ndarray, basis: Basis) -> np.ndarray:
    return centred(x, basis) @ basis.components / np.sqrt(basis.variances)


def _check(only: DataFrame, model: dict[int, Basis]) -> None:
    """Set the largest entry by which the covariance of the whitened rows, centred anew, differs from the identity."""
    means = {d: s / model[d].n for d, s in _summed(only, lambda dim, x: whitened(x, model[dim]).sum(axis=0), "double").items()}
    for dim, gram in _summed(only, lambda dim, x: _gram(whitened(x, model[dim]) - means.get(dim, 0.0)), "double").items():
        k = len(model[dim].variances)
        model[dim].identity_error = float(np.abs(gram.reshape(k, k) / model[dim].n - np.eye(k)).max())


def transform(df: DataFrame, model: dict[int, Basis], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null, empty, hold null or non-finite entries, or have a
    length the model doesn't know are left out; a null key is kept, repeated
    rows count each.  ``deviation``: the sum of (n x - S)^2 over the entries,
    exact, as decimal(38,0).
    """
    schema = pa.schema(
        [("key", pa.int64()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64())), ("e", pa.list_(pa.float64())), ("identity_error", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in integer_rows(batch):
                basis = model.get(dim)
                if basis is None or not len(basis.variances):
                    continue
                for i in range(0, len(at), _ROWS):
                    some, m = x[i : i + _ROWS], len(x[i : i + _ROWS])
                    w = whitened(some, basis)
                    k = w.shape[1]
                    far = some * basis.n - basis.sums
                    if float(np.abs(far).max()) ** 2 * dim < 2.0**62:
                        deviation = pa.array((far**2).sum(axis=1)).cast(pa.decimal128(38, 0))
                    else:
                        deviation = pa.array([Decimal(d) for d in (far.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
                    ends = np.arange(0, m * k + 1, k, dtype=np.int32)
                    shares = np.tile(basis.variances / basis.trace, m)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at[i : i + _ROWS])),
                            pa.array(np.full(m, basis.n)),
                            deviation,
                            pa.ListArray.from_arrays(ends, w.ravel()),
                            pa.ListArray.from_arrays(ends, shares),
                            pa.array(np.full(m, basis.identity_error)),
                        ],
                        schema=schema,
                    )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    done = rows.mapInArrow(run, "key long, n long, deviation decimal(38,0), w array<double>, e array<double>, identity_error double")
    each = done.select("key", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "e")).alias("place", "c"))
    return each.select(
        F.col("key").alias(key),
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        F.col("c.w").alias("whitened"),
        F.col("c.e").alias("explained"),
        "identity_error",
    )


def whiten(df: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``transform`` of ``df`` by the basis that is fitted on all its vectors."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"))
    return transform(df, fit(vectors, most), key, vector)
