"""Line dedup against a sharded minimal perfect hash.

A line's key is the line without white space around it, in lower case.  Keys
are 128-bit hashes.  Those that more than one document holds are dealt to
shards, and each shard gets a minimal perfect hash: levels of bits, two a key,
in which every key takes the first place it has for itself; the rank of its bit
numbers it.  Arrays in that order hold a fingerprint, the count of documents
and the largest doc_id.  About 24 bytes a key, and no line.

Documents probe the arrays: their line hashes go to the shard they belong to
and stream past its arrays, which are held one shard at a time.  A line that
isn't in the index meets a slot of another line; its 64-bit fingerprint tells.
Shards with far more probes than the average are probed by several tasks, each
with its own copy of the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubwarden.llm.common import mixed
from hubwarden.session import stage

_SHARD = 4096  # keys in a shard
_HOT = 8  # a shard with so many times the average probes is split
_BITS = 2  # bits a key on each level of the perfect hash
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = " \t\n\v\f\r"
_NO_ID = -(1 << 63)  # stands for a null doc_id, below all others
_AT_ONCE = 1024  # texts that are split in one step
_ARRAYS = ("sizes", "bits", "ranks", "prints", "counts", "last")


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    mix = mixed(h1 + h2 * _STEP + seed)
    return ((mix >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each of n different keys, 0 to n - 1; bits of each level, their words, and the rank before each word."""
    slots, left, words, sizes, taken = np.zeros(len(h1), np.int64), np.arange(len(h1)), [], [], 0
    while len(left):
        size = -(-_BITS * len(left) // 64) * 64
        at = _places(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        slots[left[alone]] = taken + np.cumsum(bits)[at[alone]] - 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        sizes.append(size)
        taken += int(alone.sum())
        left = left[~alone]
    every = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ranks = np.cumsum(np.bitwise_count(every), dtype=np.int64) - np.bitwise_count(every)
    return slots, np.array(sizes, np.int64), every, ranks.astype(np.uint32)


def slots_of(sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot of each key; keys that were not among the built ones get any slot, or -1."""
    out, left, first = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _places(h1[left], h2[left], level, size)
        word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
        hit = (bits[word] >> bit) & np.uint64(1) == 1
        below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[left[hit]] = ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
        left = left[~hit]
        first += size >> 6
    return out


def _hashed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row per line of ``least`` code points or more; ``new``: not met before in its document."""
    for batch in batches:
        for i in range(0, batch.num_rows, _AT_ONCE):
            some = batch.slice(i, _AT_ONCE)
            lines = pc.split_pattern(some.column(3), "\n")
            sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=_WHITE))
            at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
            found = keys.take(pa.array(at)).cast(pa.binary()).to_pylist()
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.int64).reshape(-1, 2)
            h1, h2, owner = hashes[:, 0].copy(), hashes[:, 1].copy(), owner[at]
            new = ~pd.DataFrame({"o": owner, "a": h1, "b": h2}).duplicated().to_numpy()
            rows = pa.array(owner)
            columns = [some.column(k).take(rows) for k in range(3)]
            columns += [pa.array(number[at].astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(new)]
            yield pa.RecordBatch.from_arrays(columns, ["key1", "key2", "doc_id", "line", "h1", "h2", "new"])


def line_hashes(docs: DataFrame, least_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key1, key2, doc_id, line, h1, h2, new): a row per line whose key has ``least_chars`` code points or more.

    key1, key2: hashes of the id and the text, so that rows alike in both count as rows but get one verdict.
    """
    own = docs.select(*_row_keys(key, text), F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(
        lambda batches: _hashed(batches, least_chars),
        "key1 long, key2 long, doc_id long, line int, h1 long, h2 long, new boolean",
    )


def _row_keys(key: str, text: str) -> list:
    return [F.xxhash64(F.col(key).cast("long"), text).alias("key1"), F.xxhash64(text, F.col(key).cast("long")).alias("key2")]


def _shard(shards: int):
    return F.pmod("h1", F.lit(shards)).cast("long").alias("shard")


def build_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """(shard, held, arrays) of the keys that two documents or more hold, and the number of shards.

    ``held``: how many rows hold a key of the shard.
    """
    new = lines.where("new")
    counted = new.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n > 1")
    counted = stage(counted, "line-counts")
    shards = max(1, -(-counted.count() // _SHARD))

    def build(group: pa.Table) -> pa.Table:
        h1, h2, n, last = (group.column(c).to_numpy() for c in ("h1", "h2", "n", "last"))
        order, sizes, bits, ranks = perfect_hash(h1.view(np.uint64), h2.view(np.uint64))
        arrays = [np.zeros_like(h2), np.zeros(len(n), np.uint32), np.zeros_like(last)]
        for to, values in zip(arrays, (h2, np.minimum(n, (1 << 32) - 1), last)):
            to[order] = values
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, bits, ranks, *arrays)]
        shard, held = group.column("shard")[0].as_py(), int(n.sum())
        return pa.table([pa.array([shard], pa.int64()), pa.array([held], pa.int64()), *packed], ["shard", "held", *_ARRAYS])

    kinds = "shard long, held long, " + ", ".join(f"{a} binary" for a in _ARRAYS)
    return stage(counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, kinds), "line-index"), shards


def _probe(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and part, the arrays of each first: the lines that are to be dropped."""
    place, arrays = None, None
    for batch in batches:
        shard, part, has = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        ends = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
        for i, j in zip([0, *ends], [*ends, len(shard)]):
            if i == j:
                continue
            if place != (shard[i], part[i]):
                place, arrays = (shard[i], part[i]), None
            if has[i]:
                kinds = (np.int64, np.uint64, np.uint32, np.int64, np.uint32, np.int64)
                arrays = [np.frombuffer(batch.column(a)[i].as_py(), k) for a, k in zip(_ARRAYS, kinds)]
                i += 1
            if arrays is None or i == j:
                continue
            own = batch.slice(i, j - i)
            h1, h2, doc = (own.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            sizes, bits, ranks, prints, counts, last = arrays
            slot = slots_of(sizes, bits, ranks, h1.view(np.uint64), h2.view(np.uint64))
            gone = (slot >= 0) & (prints[slot] == h2) & (counts[slot] >= documents) & (last[slot] != doc)
            if gone.any():
                yield own.select(["key1", "key2", "line"]).filter(pa.array(gone))


def repeated_lines(docs: DataFrame, least_chars: int = 40, documents: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key1, key2, gone): the numbers of the lines that each row's text loses, for rows that lose any."""
    if documents < 2:
        raise ValueError("a line must be in two documents at least")
    lines = stage(line_hashes(docs, least_chars, key, text), "lines")
    index, shards = build_index(lines)
    limit = index.agg(F.avg("held")).first()[0] or 1.0
    # at most one shard in _HOT has _HOT times the average
    parts = index.where(F.col("held") > _HOT * limit).select("shard", F.ceil(F.col("held") / (limit * _HOT / 2)).alias("parts"))
    parts = F.broadcast(parts)
    arrays = index.join(parts, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    probes = lines.withColumn("shard", _shard(shards)).join(parts, "shard", "left")
    probes = probes.withColumn("part", F.pmod("key1", F.coalesce("parts", F.lit(1))))
    columns = ["key1", "key2", "doc_id", "line", "h1", "h2"]
    both = arrays.select("shard", "part", F.lit(True).alias("has"), *[F.lit(None).cast("int" if c == "line" else "long").alias(c) for c in columns], *_ARRAYS)
    both = both.unionByName(probes.select("shard", "part", F.lit(False).alias("has"), *columns, *[F.lit(None).cast("binary").alias(a) for a in _ARRAYS]))
    sorted_rows = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("has"))
    found = sorted_rows.mapInArrow(lambda batches: _probe(batches, documents), "key1 long, key2 long, line int")
    return found.groupBy("key1", "key2").agg(F.collect_set("line").alias("gone"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts, gone = [], [], []
        for t, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = (t or b"").split(b"\n")
            less = set(drop or ())
            kept.append(t if not less else b"\n".join(x for i, x in enumerate(lines) if i not in less))
            counts.append(len(lines))
            gone.append(len(less))
        columns = [batch.column(0), pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "kept", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, least_chars: int = 40, documents: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text`` short of repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has ``least_chars`` code points or more and is in
    ``documents`` rows or more stays only in the rows with the largest doc_id
    among those that hold it; a null doc_id is below all others, and a line
    that only rows without one hold stays in all of them.  All lines of such a
    key go, or stay, together within a text.  A null text stays null and counts
    one empty line, as does an empty one; texts may hold any bytes.  Repeated
    rows are rows of their own.  Columns named n_lines or n_dropped are
    replaced, all others kept.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = docs.select(*[F.col(f"`{c}`") for c in columns if c != text])
    row = F.struct(*[F.col(f"`{c}`") for c in others.columns]).alias("row")
    own = docs.select(row, F.col(text).cast("binary").alias("text"), *_row_keys(key, text))
    met = own.join(repeated_lines(docs, least_chars, documents, key, text), ["key1", "key2"], "left").select("row", "text", "gone")
    fields = [T.StructField("row", others.schema), T.StructField("kept", T.BinaryType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    done = met.mapInArrow(_without, T.StructType(fields))
    values = [F.col("kept").cast("string").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*values, "n_lines", "n_dropped")
