"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block by block.  No score is kept:
each pass adds the scores into one histogram per query, the bin that holds the
k-th score becomes the range of the next pass, and after the last pass, whose
bins are one score wide, the k-th score is known.  A final pass keeps what lies
above it and the smallest ids among its ties.

Queries and vectors meet in blocks through a join on (query block, salt): no
broadcast, no query or score on the driver, and every task has the same work
whatever ids or vectors are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubwarden.llm.common import flushed
from hubwarden.session import stage

_BINS = 4096
_BLOCK = 1 << 18  # components in a block of vectors
_ALL = -(1 << 62)  # threshold of a query that has fewer candidates than k
_BLOCKS = "dim int, ids binary, vectors binary"
_EXACT = float(1 << 53)
_LARGEST = 1 << 61  # a range of scores twice as wide still fits a long


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) as blocks of vectors of one length."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                size = max(1, _BLOCK // max(1, int(dim)))
                for i in range(0, len(at), size):
                    own = at[i : i + size]
                    block = flat[starts[own][:, None] + np.arange(dim)[None, :]]
                    yield int(dim), ids[own].astype(np.int64).tobytes(), block.tobytes()

    return flushed(rows(), schema)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids, exact scores and which of them count (not the query's own)."""
    dim = row["dim"]
    q_ids, v_ids = (np.frombuffer(row[k], np.int64) for k in ("q_ids", "ids"))
    q = np.frombuffer(row["q_vectors"], np.int64).reshape(len(q_ids), dim)
    v = np.frombuffer(row["vectors"], np.int64).reshape(len(v_ids), dim)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
    scores = (q.astype(float) @ v.T.astype(float)).astype(np.int64) if bound < _EXACT else q @ v.T
    return q_ids, v_ids, scores, q_ids[:, None] != v_ids[None, :]


def _histograms(width: int, reach: int, k: int):
    schema = pa.schema([("block", pa.int64()), ("item", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, _, scores, counts = _scores(row)
                low = np.asarray(row["low"], np.int64)
                bins = (scores - low[:, None]) // width
                counts &= (scores >= low[:, None]) & (scores - low[:, None] < reach) & (low != _ALL)[:, None]
                at, _ = np.nonzero(counts)
                own = held.setdefault(row["block"], np.zeros((len(q_ids), _BINS), np.int64))
                own += np.bincount(at * _BINS + bins[counts], minlength=own.size).reshape(own.shape)

        def rows() -> Iterator[tuple]:
            for block, own in held.items():
                # the k-th score of all is no less than the k-th score seen here: lower bins can't hold it
                above = own[:, ::-1].cumsum(axis=1)[:, ::-1] - own
                for item, b in zip(*np.nonzero((own > 0) & (above < k))):
                    yield block, int(item), int(b), int(own[item, b])

        return flushed(rows(), schema)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above the k-th score, and of its ties those with the smallest ids."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, v_ids, scores, counts = _scores(row)
                low, need = np.asarray(row["low"], np.int64), row["need"]
                order = np.argsort(v_ids, kind="stable")
                for i in range(len(q_ids)):
                    above = np.flatnonzero(counts[i] & (scores[i] > low[i]))
                    ties = order[(counts[i] & (scores[i] == low[i]))[order]][: need[i]]
                    for j in (*above, *ties):
                        yield int(q_ids[i]), int(v_ids[j]), int(scores[i, j])

    return flushed(rows(), schema)


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector) with components floor(scale * x); rows with a null id, vector or component, or one that isn't finite, are left out."""
    x = F.col(vector)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col(vec_id).isNotNull() & x.isNotNull() & good).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("vector"),
    )


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors for each query row.

    ``vectors``: (vec_id long, vector array<long>); ``is_query``: SQL condition
    on vec_id.  A query meets all vectors of its own length but those with its
    own id; vectors whose scores could exceed 2^61 are refused.  Ties go to the smaller vec_id, repeated
    rows count each, repeated query rows are asked once.  With fewer than k
    candidates all are returned, with none no row; an empty table gives none.
    """
    spark = vectors.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stage(vectors.mapInArrow(_pack, _BLOCKS), "vector-blocks")
    asked = vectors.where(is_query).dropDuplicates()
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)))
    # blocks of about query_block queries, whose number follows the number of queries
    n_blocks = max(1, -(-asked.count() // query_block))
    queries = stage(
        numbered.withColumn("block", F.pmod("part", F.lit(n_blocks)).cast("long"))
        .groupBy("block", F.size("vector").alias("dim"))
        .applyInArrow(_query_block, "block long, dim int, q_ids binary, q_vectors binary, n int, top double"),
        "query-blocks",
    )
    queries = queries.withColumn("block", F.shiftleft("block", 31) + F.col("dim"))
    if queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = blocks.mapInArrow(_largest, "dim int, top double").groupBy("dim").agg(F.max("top").alias("most"))
    bound = queries.join(reach, "dim").agg(F.max(F.col("top") * F.col("most") * F.greatest("dim", F.lit(1)))).first()[0]
    bound = int((bound or 0) * (1 + 1e-9)) + 1
    if bound > _LARGEST:
        raise ValueError("scores of these vectors can exceed 2^61")

    spread = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    # each block of vectors goes to each block of queries of its length
    wanted = queries.groupBy("dim").agg(F.collect_list("block").alias("wanted"))
    spread = spread.join(wanted, "dim").withColumn("block", F.explode("wanted")).drop("wanted")
    salted = queries.drop("dim").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def meet(state: DataFrame) -> DataFrame:
        return spread.join(salted.join(state, "block"), ["block", "salt"]).select(
            "block", "dim", "ids", "vectors", "q_ids", "q_vectors", "low", "need"
        )

    state = queries.select(
        "block",
        F.transform(F.sequence(F.lit(1), "n"), lambda _: F.lit(-bound).cast("long")).alias("low"),
        F.transform(F.sequence(F.lit(1), "n"), lambda _: F.lit(k)).alias("need"),
    )
    reach = 2 * bound + 1  # scores of the present range: from low on
    while True:
        width = -(-reach // _BINS)
        counts = meet(state).mapInArrow(_histograms(width, reach, k), "block long, item int, bin int, n long")
        state = stage(_refined(state, counts, width), "state")
        if width == 1:
            break
        reach = width
    best = meet(state).mapInArrow(_kept, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_block(group: pa.Table) -> pa.Table:
    ids = group.column("vec_id").to_numpy().astype(np.int64)
    lists = group.column("vector").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    block, dim = group.column("block")[0].as_py(), len(lists[0])
    return pa.table(
        {
            "block": pa.array([block], pa.int64()),
            "dim": pa.array([dim], pa.int32()),
            "q_ids": [ids.tobytes()],
            "q_vectors": [flat.tobytes()],
            "n": pa.array([len(ids)], pa.int32()),
            "top": [float(np.abs(flat).max(initial=0))],
        }
    )


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest absolute component of each block."""
    for batch in batches:
        tops = [float(np.abs(np.frombuffer(x, np.int64)).max(initial=0)) for x in batch.column("vectors").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(tops, pa.float64())], ["dim", "top"])


def _refined(state: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The next range of each query: the bin in which the count from above reaches what is still needed."""
    items = state.select("block", F.posexplode(F.arrays_zip("low", "need")).alias("item", "was"))
    items = items.select("block", "item", "was.low", "was.need")
    total = counts.groupBy("block", "item", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("block", "item").orderBy(F.desc("bin"))
    reached = total.withColumn("upto", F.sum("n").over(down)).join(items.drop("low"), ["block", "item"])
    chosen = (
        reached.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        .select("block", "item", "bin", (F.col("need") - (F.col("upto") - F.col("n"))).cast("int").alias("left"))
    )
    found = F.col("bin").isNotNull()
    after = items.join(chosen, ["block", "item"], "left").select(
        "block",
        "item",
        F.when(found, F.col("low") + F.col("bin").cast("long") * F.lit(width).cast("long")).otherwise(F.lit(_ALL)).alias("low"),
        F.when(found, F.col("left")).otherwise(F.col("need")).alias("need"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("item", "low", "need")))
    return after.groupBy("block").agg(ordered.alias("s")).select("block", F.col("s.low").alias("low"), F.col("s.need").alias("need"))
