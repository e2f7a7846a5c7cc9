"""Open the files of a listing: bytes, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = 8 * 1024 * 1024
_BATCH_BYTES = 32 * 1024 * 1024
_CELL_LIMIT = 1_500_000_000  # a single value must stay below 2 GiB


def open_file(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def spread(files: DataFrame, *more: str) -> DataFrame:
    """Distribute files by path (and further columns), so that one target's files are opened by all tasks.

    The number of tasks is explicit: the rows are tiny beside the files they
    stand for, and adaptive execution would merge them into one task.
    """
    spark = files.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, 4 * spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, F.xxhash64("target", "relpath", *more))


def _per_file(files: DataFrame, name: str, kind: T.DataType, read: Callable[[str, int], object]) -> DataFrame:
    schema = T.StructType([*files.schema.fields, T.StructField(name, kind)])
    columns = [f.name for f in schema.fields]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                value = read(row.path, row.size) if row.is_file else None
                rows.append((*row, value))
                held += len(value) if value is not None else 0
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return spread(files).mapInPandas(work, schema)


def _read_all(path: str, size: int) -> bytes | None:
    if size > _CELL_LIMIT:
        return None
    try:
        with open_file(path) as f:
            return f.read()
    except OSError:
        return None


def _digest(path: str, size: int) -> str | None:
    state = hashlib.sha256()
    try:
        with open_file(path) as f:
            while chunk := f.read(_CHUNK):
                state.update(chunk)
    except OSError:
        return None
    return state.hexdigest()


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content``; filter by size and name before calling this.

    NULL for directories, unreadable files and files too large for one value.
    """
    return _per_file(files, "content", T.BinaryType(), _read_all)


def with_sha256(files: DataFrame) -> DataFrame:
    """Add ``sha256``; files of any size are streamed, no content reaches Spark."""
    return _per_file(files, "sha256", T.StringType(), _digest)


def landed_sha256(files: DataFrame) -> DataFrame:
    """The same for a table that already holds ``content``."""
    return files.withColumn("sha256", F.sha2(F.col("content"), 256))
