"""Adapter tensors from safetensors files: name, shape and value summary.

The file layout is public: an 8-byte little-endian header length, a JSON header
``{key: {dtype, shape, data_offsets}}``, then the tensors' bytes.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.schemas import TENSORS
from hubwarden.sources.content import open_file, spread

# Fixed values of the file format: dtype name -> numpy dtype.  BF16 is widened by hand.
_DTYPES = {
    "F64": "<f8",
    "F32": "<f4",
    "F16": "<f2",
    "BF16": "<u2",
    "I64": "<i8",
    "I32": "<i4",
    "I16": "<i2",
    "I8": "i1",
    "U8": "u1",
    "BOOL": "u1",
}
_STEP = 16 * 1024 * 1024
_MOST_HEADER = 100_000_000  # bytes, the limit of the file format
_ROWS = 2000
PIECE = 64 * 1024 * 1024  # a multiple of every type's size


def _summary(read, dtype: str, n_bytes: int) -> tuple[float | None, bool]:
    """(max |x|, any NaN) of a tensor read piece by piece; NaN makes the maximum NaN."""
    kind = np.dtype(_DTYPES[dtype])
    most, nan, left = None, False, n_bytes
    while left > 0:
        raw = read(min(_STEP, left))
        if not raw:
            raise EOFError("truncated")
        left -= len(raw)
        values = np.frombuffer(raw[: len(raw) - len(raw) % kind.itemsize], dtype=kind)
        if dtype == "BF16":
            values = (values.astype(np.uint32) << 16).view(np.float32)
        if values.size:
            nan = nan or bool(np.isnan(values).any())
            top = float(np.abs(values.astype(np.float64)).max())
            most = top if most is None else max(most, top)
    return (float("nan") if nan else most), nan


def _entry(entry) -> tuple[str, list[int], int, int, int] | None:
    """(dtype, shape, number of values, start, end) of a header entry; None if it is malformed."""
    if not isinstance(entry, dict):
        return None
    dtype, shape, offsets = (entry.get(k) for k in ("dtype", "shape", "data_offsets"))
    whole = [x for part in (shape, offsets) if isinstance(part, list) for x in part]
    if not (isinstance(dtype, str) and isinstance(shape, list) and isinstance(offsets, list) and len(offsets) == 2):
        return None
    if any(type(x) is not int or not 0 <= x < 1 << 62 for x in whole) or offsets[0] > offsets[1]:
        return None
    n = math.prod(shape)
    return (dtype, shape, n, *offsets) if n < 1 << 62 else None


def layout(stream) -> tuple[int, list[tuple]]:
    """(end of the header, rows (key, dtype, shape, n, start, end, status)) in file order; a ValueError if there is no header.

    Rows whose values can be read have the status ``ok``.
    """
    try:
        (size,) = struct.unpack("<Q", stream.read(8))
        if size > _MOST_HEADER:
            raise ValueError("header too long")
        header = json.loads(stream.read(size))
        listed = [(k, v) for k, v in header.items() if k != "__metadata__"]
    except (struct.error, AttributeError, MemoryError, OverflowError, RecursionError) as e:
        raise ValueError("no header") from e
    good, out = [], []
    for key, entry in listed:
        if found := _entry(entry):
            good.append((key, *found))
        else:
            out.append((key, None, None, None, 0, 0, "bad_entry"))
    at = 0
    for key, dtype, shape, n, start, end in sorted(good, key=lambda t: t[4:]):
        status = "ok"
        if dtype not in _DTYPES:
            status = "unsupported_dtype"
        elif start < at or end - start != n * np.dtype(_DTYPES[dtype]).itemsize:
            status = "bad_offsets"
        else:
            at = end
        out.append((key, dtype, shape, n, start, end, status))
    return 8 + size, out


def _whole(target: str, file: str, row: tuple, most: float | None = None, nan: bool | None = None, status: str | None = None) -> tuple:
    key, dtype, shape, n, _, _, own = row
    return (target, file, key, dtype, shape, n, most, nan, status or own)


def tensor_rows(target: str, file: str, stream, with_values: bool) -> Iterator[tuple]:
    """One row per tensor; what cannot be read is a row with a status, never an exception."""
    try:
        base, rows = layout(stream)
    except ValueError:
        yield (target, file, None, None, None, None, None, None, "bad_header")
        return
    for row in rows:
        *_, start, end, status = row
        if not with_values:
            yield _whole(target, file, row, status=status if status == "bad_entry" else "ok")
        elif status != "ok":
            yield _whole(target, file, row)
        else:
            yield _whole(target, file, row, *_read(stream, base + start, row[1], end - start))


def _read(stream, at: int, dtype: str, n_bytes: int) -> tuple[float | None, bool | None, str]:
    """(max |x|, any NaN, status) of values that begin at a file offset."""
    try:
        stream.seek(at)
        return *_summary(stream.read, dtype, n_bytes), "ok"
    except (EOFError, ValueError):
        return None, None, "truncated"


def pieces_of(rows: list[tuple], piece: int) -> Iterator[list[tuple]]:
    """Groups of (row, start, number of bytes) of about ``piece`` bytes each; a larger tensor is cut into several.

    Small tensors share a group and so one open, in file order.
    """
    held, size = [], 0
    for row in rows:
        *_, start, end, _ = row
        while True:
            n = min(piece, end - start)
            held.append((row, start, n))
            size += n
            start += n
            if size >= piece or len(held) >= _ROWS:
                yield held
                held, size = [], 0
            if start >= end:
                break
    if held:
        yield held


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    columns, held = TENSORS.fieldNames(), []
    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_tensors(files: DataFrame, with_values: bool = True, piece: int = PIECE) -> DataFrame:
    """Tensor rows of the safetensors files in a listing.

    A first pass reads headers only and plans byte ranges of about ``piece``
    bytes; the values are then read range by range, so many tasks share one
    large adapter.  Only summaries leave a task: the largest magnitude and
    whether there is a NaN, both of which merge over the ranges of a tensor.
    ``with_values=False`` ends with the headers.
    """

    def opened(batches: Iterator[pd.DataFrame], rows_of) -> Iterator[tuple]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                try:
                    with open_file(f.path) as stream:
                        yield from rows_of(f, stream)
                except OSError:
                    yield (f.target, f.relpath, None, None, None, None, None, None, "unreadable")

    listed = spread(files.select("target", "relpath", "path"))
    if not with_values:
        return listed.mapInPandas(lambda batches: _frames(opened(batches, lambda f, stream: tensor_rows(f.target, f.relpath, stream, False))), TENSORS)
    ranges = spread(tensor_ranges(files, piece), "place")
    read = ranges.mapInPandas(_read_ranges, TENSORS)
    # a row per tensor and range, tiny beside the values it stands for
    lost = F.max(F.when(F.col("read_status") != "ok", F.col("read_status")))
    merged = read.groupBy("target", "file", "key", "dtype", "shape", "n").agg(
        F.max("max_abs").alias("max_abs"), F.max("has_nan").alias("has_nan"), lost.alias("lost")
    )
    whole = F.col("lost").isNull()
    return merged.select(
        "target", "file", "key", "dtype", "shape", "n",
        F.when(whole & ~F.col("has_nan"), F.col("max_abs")).alias("max_abs"),  # a tensor with NaN has no maximum
        F.when(whole, F.col("has_nan")).alias("has_nan"),
        F.coalesce("lost", F.lit("ok")).alias("read_status"),
    )


def tensor_ranges(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(target, relpath, path, place, ranges): the byte ranges of each file to be read together, from its header.

    A tensor whose values can't be read, or a file without a header, is a
    range with a status other than ``ok``.
    """

    def told(key, dtype, shape, n, at, size, status) -> dict:
        return {"key": key, "dtype": dtype, "shape": shape, "n": n, "at": at, "size": size, "status": status}

    def plan(f) -> Iterator[tuple]:
        try:
            with open_file(f.path) as stream:
                base, rows = layout(stream)
        except (OSError, ValueError) as e:
            why = "unreadable" if isinstance(e, OSError) else "bad_header"
            yield (f.target, f.relpath, f.path, 0, [told(None, None, None, None, 0, 0, why)])
            return
        bad = [told(*row[:4], 0, 0, row[-1]) for row in rows if row[-1] != "ok"]
        for at in range(0, len(bad), _ROWS):
            yield (f.target, f.relpath, f.path, 0, bad[at : at + _ROWS])
        for place, group in enumerate(pieces_of([r for r in rows if r[-1] == "ok"], piece)):
            yield (f.target, f.relpath, f.path, place, [told(*row[:4], base + at, size, "ok") for row, at, size in group])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                for row in plan(f):
                    yield pd.DataFrame([row], columns=columns)

    columns = ["target", "relpath", "path", "place", "ranges"]
    ranges = "array<struct<key: string, dtype: string, shape: array<bigint>, n: bigint, at: bigint, size: bigint, status: string>>"
    kind = f"target string, relpath string, path string, place bigint, ranges {ranges}"
    return spread(files.select("target", "relpath", "path")).mapInPandas(work, kind)


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for f in batch.itertuples(index=False):
            told = [(f.target, f.relpath, r["key"], r["dtype"], r["shape"], r["n"]) for r in f.ranges]
            found = [(None, None, r["status"]) for r in f.ranges]
            wanted = [i for i, r in enumerate(f.ranges) if r["status"] == "ok"]
            if wanted:
                done = 0
                try:
                    with open_file(f.path) as stream:
                        for i in wanted:
                            r = f.ranges[i]
                            found[i] = _read(stream, r["at"], r["dtype"], r["size"])
                            done += 1
                except OSError:  # the ranges that were read stay
                    for i in wanted[done:]:
                        found[i] = (None, None, "unreadable")
            yield pd.DataFrame([(*a, *b) for a, b in zip(told, found)], columns=TENSORS.fieldNames())


def decode_tensors(files: DataFrame, with_values: bool = True) -> DataFrame:
    """The same for a table that already holds ``content``."""
    import io

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for f in batch.itertuples(index=False):
                    yield from tensor_rows(f.target, f.relpath, io.BytesIO(f.content), with_values)

        yield from _frames(rows())

    return files.select("target", "relpath", "content").mapInPandas(work, TENSORS)
