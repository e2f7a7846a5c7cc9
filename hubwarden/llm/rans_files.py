"""Token ids as files of interleaved range-asymmetric-numeral-system blocks.

Layout of a folder:

* ``table``  (id, freq): one frequency table for all blocks; ``freq`` adds up to 2^20
* ``parts``  (part, tokens): ids in each part; parts follow each other in ascending doc_id order
* ``blocks`` (part, block, first, n, docs, words, states, offsets, crc): 32,768 ids each

A block is independent of all others.  Its ids go to 32 lanes in turn, each with
a 64-bit state and 32-bit renormalisation; the words that the lanes give out
are interleaved in the order in which a decoder reads them.  ``states`` and
``offsets`` hold a checkpoint every 256 steps (8,192 ids), so the segments of a
block decode side by side; ``crc`` is the CRC-32 of the ids as little-endian
32-bit integers.  ``docs`` lists the documents' pieces in the block.

The only data that passes through the driver is the frequency table, which has
no more rows than the vocabulary.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hubwarden.llm.common import flushed, per_stage, utf8
from hubwarden.session import stage

SCALE = 20
LANES = 32
BLOCK = 1 << 15
STEPS = 256  # between checkpoints
_LOW = np.uint64(1 << 31)
_AT_ONCE = 32  # blocks that are coded together
_PART = 1 << 22  # ids in a part
_TOGETHER = 256  # documents whose ids are counted together
_CACHE = 300_000
_PARTS = 1_000_000
_MARKS = bytes(c for c in range(33, 127) if chr(c) != "'" and not chr(c).isalnum())
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

_PIECES = "array<struct<row:int,doc_id:bigint,at:int,n:int>>"
_BLOCKS = f"part int, block int, first bigint, n int, docs {_PIECES}, words binary, states binary, offsets binary, crc bigint"


# ---- tokens


class WordTokens:
    """Ids of a text, word by word, with the ids of words already seen.

    Right for a tokenizer that never joins characters across white space and
    whose pieces don't cross from letters to other characters, such as
    ``word_bpe_49k.json``.  Words with an apostrophe or characters outside
    Latin-1 letters and ASCII marks are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {chr(i): "".join(x for x, _ in level.pre_tokenize_str(chr(i))) for i in range(33, 256)}
        self.parts: dict[bytes, bytes] = {}  # ids of letters in lower case, of marks, and of other words whole
        # words met of late and before: what isn't met any more is forgotten
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _run(self, part: str) -> bytes:
        """Ids of letters alone or marks alone, normal already: one run for the model, in its byte alphabet."""
        own = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(own)]).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        if len(self.parts) > _PARTS:
            self.parts = {}
        if len(self.young) > _CACHE:
            self.young, self.old = {}, self.young
        parts, young, whole = self.parts, self.young, []
        for word in new:
            letters = word.rstrip(_MARKS)
            if letters.isalpha():  # of ASCII
                low, marks = letters.lower(), word[len(letters) :]
            elif not word.isascii() and (m := _PLAIN.fullmatch(word.decode())):
                low, marks = m[1].lower().encode(), m[2].encode()
            else:
                whole.append(word)
                continue
            if (ids := parts.get(low)) is None:
                ids = parts[low] = self._run(low.decode())
            if marks:
                if (more := parts.get(marks)) is None:
                    more = parts[marks] = self._run(marks.decode())
                ids += more
            young[word] = ids
        fresh = [w for w in whole if w not in parts]
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)):
            parts[w] = array("I", e.ids).tobytes()
        young.update((w, parts[w]) for w in whole)

    def _of(self, words: list[bytes]) -> bytes:
        young = self.young
        if unmet := {w: None for w in words if w not in young}:
            again = {w: self.old[w] for w in unmet if w in self.old}
            self._learn([w for w in unmet if w not in again])
            self.young.update(again)
            if self.young is not young:  # the young have just become the old
                young = self.young
                young.update((w, self.old[w]) for w in {w: None for w in words if w not in young})
        return b"".join(map(young.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for text in texts:
            words = text.split()  # at ASCII white space; other kinds are left to the tokenizer
            shares = (words[i : i + _CACHE // 8] for i in range(0, len(words), _CACHE // 8))
            out.append(np.frombuffer(b"".join(map(self._of, shares)), np.uint32))
        return out


def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept between the tasks of a stage."""
    return per_stage(WordTokens, path)


def token_table(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids) of each row, staged: its ids with ``end_id`` after them, compressed.  Null and empty texts have the end id alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokens(path)
        pack = zstandard.ZstdCompressor(level=1)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(utf8(part.column(1)))):
                        ids = np.append(ids, np.uint32(end_id))
                        yield doc_id, len(ids), pack.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes())

        yield from flushed(rows(), schema)

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage(wanted.mapInArrow(run, "doc_id long, n int, ids binary"), "tokens")


def _ids(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


# ---- frequencies


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use, ascending, and their frequencies, which are 1 or more and add up to 2^SCALE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            packs = batch.column(0)
            for i in range(0, len(packs), _TOGETHER):
                own = np.bincount(np.concatenate([_ids(p) for p in packs.slice(i, _TOGETHER).to_pylist()]))
                if len(own) > len(total):
                    total = np.append(total, np.zeros(len(own) - len(total), np.int64))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return np.array([r["id"] for r in counted], np.uint32), normalised(np.array([r["n"] for r in counted], np.int64))


def normalised(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies of 1 or more whose sum is 2^SCALE."""
    if not len(counts):
        return counts
    if len(counts) > 1 << (SCALE - 1):
        raise ValueError(f"more than {1 << (SCALE - 1)} different ids")
    exact = counts / counts.sum() * (1 << SCALE)
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    short = (1 << SCALE) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while short:  # the largest ones give or take, so no frequency falls below 1
        step = int(np.sign(short))
        able = order[freq[order] + step >= 1][: abs(short)]
        freq[able] += step
        short -= step * len(able)
    return freq


# ---- coder


def encode_blocks(symbols: list[np.ndarray], freq: np.ndarray, cum: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(words, states, offsets) of each block; ``symbols``: places in the frequency table."""
    n = np.array([len(s) for s in symbols])
    steps = int(-(-n.max() // LANES))
    held = np.zeros((len(n), steps * LANES), np.int64)
    for i, s in enumerate(symbols):
        held[i, : len(s)] = s
    held = held.reshape(len(n), steps, LANES)
    active = (np.arange(steps * LANES).reshape(1, steps, LANES)) < n[:, None, None]
    f, c = freq[held].astype(np.uint64), cum[held].astype(np.uint64)
    limit = f << np.uint64(63 - SCALE)
    x = np.full((len(n), LANES), _LOW, np.uint64)
    out = np.zeros((len(n), steps, LANES), np.uint32)
    gives = np.zeros((len(n), steps, LANES), bool)
    marks = {}
    for t in range(steps - 1, -1, -1):
        on = active[:, t]
        give = on & (x >= limit[:, t])
        out[:, t], gives[:, t] = x.astype(np.uint32), give
        y = np.where(give, x >> np.uint64(32), x)
        q, r = np.divmod(y, f[:, t])
        x = np.where(on, (q << np.uint64(SCALE)) + r + c[:, t], x)
        if t % STEPS == 0:
            marks[t] = x
    before = np.zeros((len(n), steps + 1), np.int64)
    np.cumsum(gives.sum(axis=2), axis=1, out=before[:, 1:])
    coded = []
    for i in range(len(n)):
        at = range(0, int(-(-n[i] // LANES)), STEPS)
        states = np.stack([marks[t][i] for t in at])
        coded.append((out[i][gives[i]].astype("<u4").tobytes(), states.astype("<u8").tobytes(), before[i, list(at)].astype("<u4").tobytes()))
    return coded


def decode_blocks(blocks: list[tuple[int, bytes, bytes, bytes]], freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
    """Places in the frequency table of each block (n, words, states, offsets); all segments step together."""
    words = [np.frombuffer(w, "<u4") for _, w, _, _ in blocks]
    start = np.cumsum([0, *map(len, words)])
    flat = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    x = np.concatenate([np.frombuffer(s, "<u8").reshape(-1, LANES) for _, _, s, _ in blocks])
    at = np.concatenate([np.frombuffer(o, "<u4").astype(np.int64) + start[i] for i, (_, _, _, o) in enumerate(blocks)])
    left = np.concatenate([n - np.arange(0, n, STEPS * LANES) for n, _, _, _ in blocks])
    out = np.zeros((len(x), STEPS, LANES), np.int64)
    mask, lanes = np.uint64((1 << SCALE) - 1), np.arange(LANES)
    for t in range(STEPS):
        on = (t * LANES + lanes)[None, :] < left[:, None]
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        y = freq[s].astype(np.uint64) * (x >> np.uint64(SCALE)) + slot - cum[s].astype(np.uint64)
        takes = on & (y < _LOW)
        rank = np.cumsum(takes, axis=1)
        word = flat[np.minimum(at[:, None] + rank - 1, len(flat) - 1)]
        x = np.where(takes, (y << np.uint64(32)) | word, np.where(on, y, x))
        at = at + rank[:, -1]
        out[:, t] = s
    rows = out.reshape(len(x), -1)
    segments = np.cumsum([0, *(-(-n // (STEPS * LANES)) for n, _, _, _ in blocks)])
    return [rows[segments[i] : segments[i + 1]].ravel()[:n] for i, (n, _, _, _) in enumerate(blocks)]


# ---- files


def write_files(tokens: DataFrame, folder: str) -> None:
    """Write a token table in ascending doc_id order (null first; equal ids by a hash of their tokens)."""
    spark = tokens.sparkSession
    ids, freq = frequencies(tokens)
    table = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id long, freq long")
    table.coalesce(1).write.parquet(f"{folder}/table")
    cum = np.cumsum(freq) - freq
    shared = spark.sparkContext.broadcast((ids, freq, cum))  # no longer than the vocabulary
    n_parts = max(1, -(-int(tokens.agg(F.sum("n")).first()[0] or 0) // _PART))
    tie = F.xxhash64("ids")
    ordered = tokens.repartitionByRange(n_parts, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(_coded(batches, *shared.value), pa_schema)

    piece = pa.struct([("row", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
    pa_schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("docs", pa.list_(piece))]
        + [("words", pa.binary()), ("states", pa.binary()), ("offsets", pa.binary()), ("crc", pa.int64())]
    )
    ordered.select("doc_id", "ids").mapInArrow(run, _BLOCKS).write.parquet(f"{folder}/blocks")
    read_blocks(spark, folder).groupBy("part").agg(F.sum("n").alias("tokens")).coalesce(1).write.parquet(f"{folder}/parts")


def _places(ids: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Function from ids in use, ascending in ``ids``, to their places there: by a table where ids are small, as in any vocabulary."""
    if not len(ids) or ids[-1] >= 1 << 22:
        return lambda own: np.searchsorted(ids, own)
    table = np.zeros(int(ids[-1]) + 1, np.int32)
    table[ids] = np.arange(len(ids))
    return table.__getitem__


def _coded(batches: Iterator[pa.RecordBatch], ids: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> Iterator[tuple]:
    part, block, first, row = TaskContext.get().partitionId(), 0, 0, 0
    place_of = _places(ids)
    held, docs, size = [], [], 0  # ids not yet coded, and the pieces (row, doc_id, start, n) they belong to

    def emit(last: bool) -> Iterator[tuple]:
        nonlocal block, first, held, docs, size
        joined = np.concatenate(held)
        cut = size if last else size - size % BLOCK
        own = [joined[i : min(i + BLOCK, cut)] for i in range(0, cut, BLOCK)]
        starts = np.array([d[2] for d in docs])
        for i in range(0, len(own), _AT_ONCE):
            some = own[i : i + _AT_ONCE]
            for j, (ids_, coded) in enumerate(zip(some, encode_blocks([place_of(s) for s in some], freq, cum))):
                a = (i + j) * BLOCK
                b = a + len(ids_)
                near = docs[max(0, int(np.searchsorted(starts, a, "right")) - 1) : int(np.searchsorted(starts, b, "left"))]
                pieces = [
                    {"row": r, "doc_id": d, "at": max(s, a) - a, "n": min(s + n, b) - max(s, a)} for r, d, s, n in near if s + n > a
                ]
                yield part, block, first, len(ids_), pieces, *coded, zlib.crc32(ids_.astype("<u4").tobytes())
                block, first = block + 1, first + len(ids_)
        held = [joined[cut:]]
        docs = [(r, d, s - cut, n) for r, d, s, n in docs if s + n > cut]
        size -= cut

    for batch in batches:
        for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _ids(packed)
            docs.append((row, doc_id, size, len(own)))
            held.append(own)
            size += len(own)
            row += 1
            if size >= _AT_ONCE * BLOCK:
                yield from emit(last=False)
    if size:
        yield from emit(last=True)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def decoded(spark: SparkSession, folder: str, rows_of: Callable[[dict, np.ndarray], Iterator[tuple]], schema: pa.Schema, kind: str) -> DataFrame:
    """Decode all blocks and give ``rows_of(block row, its ids)``; a block whose checksum differs raises."""
    table = spark.read.parquet(f"{folder}/table").orderBy("id").collect()
    ids, freq = np.array([r["id"] for r in table], np.uint32), np.array([r["freq"] for r in table], np.int64)
    shared = spark.sparkContext.broadcast((ids, freq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, freq = shared.value
        cum, slots = np.cumsum(freq) - freq, np.repeat(np.arange(len(freq)), freq)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, _AT_ONCE):
                    some = batch.slice(i, _AT_ONCE).to_pylist()
                    for r, s in zip(some, decode_blocks([(r["n"], r["words"], r["states"], r["offsets"]) for r in some], freq, cum, slots)):
                        own = ids[s]
                        if zlib.crc32(own.astype("<u4").tobytes()) != r["crc"]:
                            raise ValueError(f"checksum of block {r['block']} in part {r['part']} differs")
                        yield from rows_of(r, own)

        return flushed(rows(), schema)

    return read_blocks(spark, folder).mapInArrow(run, kind)


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded files.

    One row per written row, repeated ids included.  A document that spans
    blocks is checked by combining its pieces' checksums; ids aren't moved.
    """
    schema = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def pieces(r: dict, ids: np.ndarray) -> Iterator[tuple]:
        raw = ids.astype("<u4")
        for d in r["docs"]:
            yield r["part"], d["row"], d["doc_id"], r["first"] + d["at"], d["n"], zlib.crc32(raw[d["at"] : d["at"] + d["n"]].tobytes())

    found = decoded(spark, folder, pieces, schema, "part int, row int, doc_id long, at long, n long, crc long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = spark.read.parquet(f"{folder}/parts").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    docs = found.groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("at").alias("at"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("pieces"),
    )
    docs = docs.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "pieces")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return docs.mapInArrow(_combined, kind)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        ends, flat = pieces.offsets.to_numpy(), pieces.values
        crc, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        out = crc[ends[:-1]]
        for i in np.flatnonzero(np.diff(ends) > 1).tolist():  # most documents lie in one block
            value = int(out[i])
            for j in range(ends[i] + 1, ends[i + 1]):
                value = crc32_joined(value, int(crc[j]), 4 * int(n[j]))
            out[i] = value
        columns = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two joined byte strings from the CRC of each and the length of the second.

    Appending a zero byte to a message is a linear map of its CRC over GF(2);
    the map for ``length`` bytes comes by repeated squaring.
    """

    def apply(rows: list[int], x: int) -> int:
        out = 0
        for row in rows:
            if x & 1:
                out ^= row
            x >>= 1
        return out

    bit = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    power = bit
    for _ in range(3):
        power = [apply(power, row) for row in power]  # one zero byte
    while length:
        if length & 1:
            first = apply(power, first)
        power = [apply(power, row) for row in power]
        length >>= 1
    return first ^ second
