"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden.session import drop_folder

_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_staged(spark: SparkSession, staged: DataFrame) -> None:
    """Remove the files of a table that ``session.stage`` wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        drop_folder(spark, folder)


def crc_remainder(column: str, by: int) -> Column:
    """crc32 of a number's text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def held_out(column: str, by: int) -> Column:
    """Whether a row's key leaves the remainder 1; false for a null key."""
    return F.coalesce(crc_remainder(column, by) == 1, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    return text.lower().split()


#: What a byte stands for in a word's hash, A-Z as a-z; a word is a polynomial of these at an odd point, modulo 2^64.
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_POINT = 0x9FB21C651E98DF25
_INVERSE = pow(_POINT, -1, 1 << 64)
_SLICE = 1 << 20  # bytes of text that are hashed together


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased; none for null.

    All bytes of some texts are hashed by a few array operations, so nothing
    depends on how many different words there are and nothing is kept.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    known = np.asarray(texts.is_valid())
    up, down, i = _powers(_POINT, 1), _powers(_INVERSE, 1), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        if len(own) > len(up):
            up, down = _powers(_POINT, max(len(own), _SLICE)), _powers(_INVERSE, max(len(own), _SLICE))
        apart = np.ones(len(own) + 1, bool)  # no word goes on from the byte before
        apart[1:-1] = _SPACE[own[:-1]]
        apart[bounds] = True
        full = ~_SPACE[own]
        starts = np.flatnonzero(full & apart[:-1])
        after = apart[1:].copy()
        after[:-1] |= ~full[1:]
        ends = np.flatnonzero(full & after) + 1
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * up[: len(own)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        cuts = np.searchsorted(starts, bounds)
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            yield hashes[a:b] if known[i + k] else hashes[:0]
        i = j


_kept: dict = {}


def _give_back() -> None:
    """Return what a worker has freed to the machine, which its allocators would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def per_stage(make, *settings):
    """``make(*settings)``, kept by the Python worker for the tasks of one stage and forgotten with the next stage.  ``None`` only forgets."""
    task = TaskContext.get()
    now = task and task.stageId()
    if _kept.get("stage") != now:
        _kept.clear()
        _kept["stage"] = now
        _give_back()
    if make is None:
        return None
    at = (make, settings)
    if at not in _kept:
        _kept[at] = make(*settings)
    return _kept[at]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours."""
    n = len(hashes) - size + 1
    if n < 1:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MIX + hashes[i : i + n]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return x.view(np.int64)


def flushed(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; a batch ends after about ``size`` bytes of their binary values or 8,192 rows."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if weight >= size or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
