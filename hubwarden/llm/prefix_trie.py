"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A conversation's turns are laid out in columns, ``width`` to a row; a long one
continues in further rows, each keyed by the trie node that the row before
ended in.  One ``GROUP BY block, prior, ROLLUP(t1, .., tw)`` then aggregates
all prefixes of all blocks together, and the number of columns that
``grouping`` shows as aggregated tells a prefix's length.

A second ROLLUP over the nodes sums what lies below each of them.  What hangs
below a block's last column belongs to a block of its own; those blocks' sums
are passed up by pointer doubling, in a number of rounds logarithmic in the
number of blocks of the longest conversation.

A turn id is the MD5 of role and text with the text's length behind it; a node
is the MD5 of the block's prior node and the ids since.  Nothing but a block
row, a running hash and a piece of a list of ids is ever held in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubwarden.session import stage

ROOT = bytes(16)
_EMPTY = b""
_PIECE = 1 << 16  # characters of joined conversation ids in one value


def turn_id(role: Column, text: Column) -> Column:
    """24 bytes: MD5 of role and text, then the text's length in UTF-8 bytes."""
    size = F.octet_length(text)
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(both.cast("binary"))), F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0")))


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, turn_id): turns numbered from 1 by ``turn`` (null first), then role and text; null role or text count as empty.

    Rows without a conversation are left out.
    """
    said = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return said.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("turn_id"))


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv_id, block, prior, t1 .. tw, n, more): the turns of a conversation, ``width`` a row; one row without turns for a turnless one."""
    names = ["conv_id", "block", "prior", *_columns(width), "n", "more"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.binary()] * width, pa.int32(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        conv, block, prior, ids = None, 0, ROOT, []

        def done(more: bool) -> None:
            if conv is not None:
                held.append((conv, block, prior, *ids, *[None] * (width - len(ids)), len(ids), more))

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)
            held.clear()
            return out

        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != conv:
                    done(False)
                    conv, block, prior, ids = c, 0, ROOT, []
                elif len(ids) == width:
                    done(True)
                    block, prior, ids = block + 1, hashlib.md5(prior + b"".join(ids)).digest(), []
                if t is not None:
                    ids.append(t)
            if len(held) >= 4096:
                yield taken()
        done(False)
        if held:
            yield taken()

    # a row without a turn, first of its conversation, stands for the conversation itself
    heads = convs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("turn_id"))
    rows = turns.select("conv_id", "turn", "turn_id").unionByName(heads.distinct())
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("turn_id"))
    kind = "conv_id long, block long, prior binary, " + ", ".join(f"{c} binary" for c in _columns(width)) + ", n int, more boolean"
    return rows.select("conv_id", "turn_id").mapInArrow(run, kind)


def _path(upto: Column, width: int) -> Column:
    """Node of the first ``upto`` ids of a row; its prior node for none."""
    some = [F.when(F.lit(i + 1) <= upto, F.coalesce(c, F.lit(_EMPTY))).otherwise(F.lit(_EMPTY)) for i, c in enumerate(_columns(width))]
    return F.when(upto == 0, F.col("prior")).otherwise(F.unhex(F.md5(F.concat("prior", *some))))


def _rolled(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """ROLLUP over the id columns within each block; ``level``: how many of them a row has.

    Only rows that are a prefix are kept: those whose last id is there, and the root.
    """
    names = _columns(width)
    level = " + ".join(f"(1 - grouping({c}))" for c in names)
    rolled = rows.sparkSession.sql(
        f"SELECT block, prior, {', '.join(names)}, cast({level} AS int) AS level, {aggregates} FROM {{rows}} "
        f"GROUP BY block, prior, ROLLUP ({', '.join(names)})",
        rows=rows,
    )
    last = F.element_at(F.array(*names), F.greatest("level", F.lit(1)))
    return rolled.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last.isNotNull()))


def _below(nodes: DataFrame, width: int) -> DataFrame | None:
    """(node, deep_saved, deep_leaves, kids) of the nodes in which a block continues: sums over all that lies deeper."""
    groups = nodes.where("block > 0").groupBy("prior").agg(
        F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"), F.count_if(F.col("level") == 1).alias("kids")
    )
    ends = nodes.where(F.col("level") == width).select(F.col("node").alias("prior"), F.when(F.col("block") > 0, F.col("prior")).alias("up"))
    state = stage(groups.join(ends, "prior"), "trie-below")
    if state.isEmpty():
        return None
    while not (rising := state.where("up IS NOT NULL")).isEmpty():
        more = rising.groupBy(F.col("up").alias("prior")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = state.select(F.col("prior").alias("up"), F.col("up").alias("next"))
        state = stage(
            state.join(more, "prior", "left")
            .join(above, "up", "left")
            .select(
                "prior",
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                "kids",
                F.col("next").alias("up"),
            ),
            "trie-below",
        )
    return state.select(F.col("prior").alias("node"), F.col("saved").alias("deep_saved"), F.col("leaves").alias("deep_leaves"), "kids")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order: pieces of the comma-joined ids of each node, by their first id."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    node, first, held, size, out = None, 0, [], 0, []

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node or size > _PIECE:
                if held:
                    out.append((node, first, ",".join(held)))
                node, first, held, size = n, c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(out) >= 8192:
            yield taken()
    if held:
        out.append((node, first, ",".join(held)))
    if out:
        yield taken()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node and first id: SHA-256 of each node's pieces, joined by commas."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """(node, ends_sha256): hash of the ids of the conversations that end in a node, for nodes in which any does.

    Ids are sorted and joined in pieces by range, so that a node in which very
    many end is dealt out; the hash, serial by definition, streams its pieces.
    """
    ends = blocks.where("NOT more").select(_path(F.col("n"), width).alias("node"), "conv_id")
    pieces = (
        ends.repartitionByRange("node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(_joined, "node binary, first long, ids string")
    )
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return ordered.mapInArrow(_digested, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, width: int = 8) -> DataFrame:
    """A row per distinct prefix of the conversations in ``turns`` (conv_id, turn, turn_id), the empty one included.

    (node, parent, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).  ``convs`` (conv_id) adds conversations that may
    have no turn; they end in the root.  Turns are in order of ``turn``, null
    first; equal turns in order of their ids.  Conversations with equal turns are members of
    their own.  Without conversations there is no node.
    """
    convs = turns.select("conv_id") if convs is None else convs
    names = _columns(width)
    blocks = stage(_blocks(turns, convs, width), "trie-blocks")
    rolled = _rolled(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS most, max(more) AS more")
    last = F.element_at(F.array(*names), F.greatest("level", F.lit(1)))
    size = F.conv(F.hex(F.substring(last, 17, 8)), 16, 10).cast("long")
    nodes = stage(
        rolled.select(
            "block",
            "prior",
            *names,
            "level",
            _path(F.col("level"), width).alias("node"),
            "conv_id",
            "n_convs",
            F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise((F.col("n_convs") - 1) * size).alias("own"),
            ((F.col("most") == F.col("level")) & ~F.col("more")).cast("long").alias("leaf"),
        ),
        "trie-nodes",
    )
    deep = _below(nodes, width)
    none = F.lit(0).cast("long")
    full = nodes.where(F.col("level") == width)
    full = full.join(deep, "node", "left") if deep is not None else full.withColumns({c: none for c in ("deep_saved", "deep_leaves", "kids")})
    full = full.drop("node").na.fill(0, ["deep_saved", "deep_leaves", "kids"])
    rest = nodes.where(F.col("level") < width).drop("node").withColumns({c: none for c in ("deep_saved", "deep_leaves", "kids")})
    counts = ", ".join(f"count_if(level = {i}) AS k{i}" for i in range(1, width + 1))
    rolled = _rolled(
        rest.unionByName(full),
        width,
        "min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(own + deep_saved) AS saved_tokens, "
        f"sum(leaf + deep_leaves) AS n_leaves, max(kids) AS kids, {counts}",
    )
    children = F.when(F.col("level") == width, F.col("kids")).otherwise(F.element_at(F.array(*[f"k{i}" for i in range(1, width + 1)]), F.least(F.col("level") + 1, F.lit(width))))
    level = F.col("level")
    out = rolled.select(
        _path(level, width).alias("node"),
        F.when(level > 0, _path(level - 1, width)).alias("parent"),
        "conv_id",
        (F.col("block") * width + level).alias("depth"),
        "n_convs",
        children.alias("n_children"),
        "n_leaves",
        "saved_tokens",
    )
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(_ends(blocks, width), "node", "left").join(parents, "parent", "left")
    return out.select(
        "node",
        "parent",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
