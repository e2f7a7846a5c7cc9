"""SHA-256 helpers, including the order-independent hash of a set of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE_HEX = 4
_AT_ONCE = 4096  # copies of a digest that are hashed in one step
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def scan_id(target: Column, timestamp: Column) -> Column:
    """16 hex digits naming one scan of one target at one time."""
    return F.substring(F.sha2(F.concat_ws(":", target, timestamp), 256), 1, 16)


def combined_hash(
    df: DataFrame, keys: Sequence[str], digest: str, name: str = "combined_hash", sums: Sequence[str] = ()
) -> DataFrame:
    """SHA-256 over each group's digests in sorted order, duplicates kept.

    The long columns ``sums`` are added up in the same pass, over rows without
    a digest too; with them a group of such rows alone has the empty hash,
    without them it has no row.

    Equal digests are counted before anything is gathered, so any number of
    copies of one file is one value; the different ones are sorted per leading
    hex digits, so one target holding most files is sorted by many tasks.  The hash chain itself is serial by
    definition; the last step streams the sorted pieces of a group through one
    hash state and never holds a group in memory.
    """
    keys, sums = list(keys), list(sums)
    one = F.when(F.col("_digest").isNotNull(), F.struct("_digest", "_n"))
    pieces = (
        (df if sums else df.where(F.col(digest).isNotNull()))
        .groupBy(*keys, F.col(digest).alias("_digest"))
        .agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums])
        .groupBy(*keys, F.substring("_digest", 1, _PIECE_HEX).alias("_piece"))
        .agg(F.array_sort(F.collect_list(one)).alias("_s"), *[F.sum(c).alias(c) for c in sums])
        .select(*keys, *sums, "_piece", F.col("_s._digest").alias("_digests"), F.col("_s._n").alias("_counts"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keys).schema)

    width, columns = len(keys), [*keys, name, *sums]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, totals = None, hashlib.sha256(), [0] * len(sums)
        for batch in batches:
            done = []
            for *row, digests, counts in batch.itertuples(index=False, name=None):
                group = row[:width]
                if group != current:
                    if current is not None:
                        done.append((*current, state.hexdigest(), *totals))
                    current, state, totals = group, hashlib.sha256(), [0] * len(sums)
                totals = [a + b for a, b in zip(totals, row[width:])]
                for one, n in zip(digests, counts):
                    while n > 0:
                        state.update(one.encode("ascii") * min(n, _AT_ONCE))
                        n -= _AT_ONCE
            if done:
                yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame([(*current, state.hexdigest(), *totals)], columns=columns)

    return (
        pieces.repartition(*keys)
        .sortWithinPartitions(*keys, "_piece")
        .select(*keys, *sums, "_digests", "_counts")
        .mapInPandas(chain, ", ".join([schema, f"`{name}` string", *(f"`{c}` long" for c in sums)]))
    )
