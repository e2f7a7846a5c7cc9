"""N-gram Jaccard self-join of a corpus by parity sketches.

Shingles are XOR-hashed into sparse parity sketches: every shingle falls into
one piece of its sketch and toggles it, so a differing shingle changes at most
one piece and the number of pieces that differ is no more than the symmetric
difference of two sets.  Sets whose Jaccard similarity is 3/4 or more, the
smaller of size a, differ in at most ``D = a/3`` shingles.  Per size band (sets
within a factor of two) both sets therefore share one of their first D + 1
pieces in any common order (pigeonhole), and only those are joined.  The order
puts pieces that many documents have last; a sample tells which, and affects
speed only.

Candidates pass two tests: the Hamming distance of dense parity sketches of
eight bits a shingle or more, which is again a lower bound, then the exact sets.

Documents with equal sets are one class throughout.  In a bucket of pieces the
class with the smallest id is paired with all others, and neighbours with each
other; what these pairs connect isn't paired again, so a group of near copies
gives as many pairs as it has members.  The classes of a bucket that are still
apart are then compared, without exception: one by one in small buckets, and in
large ones by chunks of sketches that meet each other, where only pairs whose
sketches allow a link become rows.  A pair that meets in many large buckets
becomes a row in the first of them: each class carries its smallest keys of
large buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubwarden.llm.common import drop_staged, flushed, mixed, per_stage, signed, windows, word_hashes
from hubwarden.llm.graph import components
from hubwarden.session import stage

_RATIO = 2.0  # between the bounds of a size band
_FILL = 0.75  # shingles in a piece, for the largest sets of a band
_SAMPLE = 16  # one class in so many is looked at for frequent pieces
_FREQUENT = 200_000  # pieces that are kept as frequent, at most
_BITS = 24
_SMALL = 32  # classes of a bucket that are paired one by one
_CHUNK = 256  # classes of a bucket whose sketches come in one row
_FIRST = 16  # keys of large buckets that a class carries, to be paired once
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(own: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashed runs of ``size`` of the hashed words, ascending; all words as one run if there are fewer, none without words."""
    return np.unique(windows(own, min(size, len(own)))) if len(own) else np.zeros(0, np.uint64)


def class_of(own: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64).item()


def band(n: int) -> int:
    return int(math.log(n) / math.log(_RATIO) + 1e-9)


def most_apart(n: int, top: int, percent: int) -> int:
    """Most shingles by which a set of ``n`` and one that links to it can differ, the smaller below ``top``: |A delta B| <= (1 - J) |A or B| and |A or B| <= |smaller| / J."""
    return min(n, top - 1) * (100 - percent) // percent


def _places(own: np.ndarray, at: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending piece numbers of a set's shingles in the layout of band ``at``, the shingles in that order, and the band's upper bound.

    The first layout cuts the range of the hashes into equal parts, so an
    ascending set needs no sorting.
    """
    top = math.ceil(_RATIO ** (at + 1))
    number = np.uint64(int(top / _FILL) + 4)
    if seed:
        own = np.sort(mixed(own + np.uint64(seed * 104_729)))
    return ((own >> np.uint64(32)) * number) >> np.uint64(32), own, top


def pieces(own: np.ndarray, at: int, seed: int) -> tuple[np.ndarray, int]:
    """Keys of the pieces that hold a shingle in the layout of band ``at``, and the upper bound of the band."""
    place, own, top = _places(own, at, seed)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    value = np.bitwise_xor.reduceat(own, first)
    return mixed(value + place[first] * _STEP + np.uint64(at * 64 + seed)), top


def layouts(n: int, percent: int) -> range:
    """Bands in which a set of ``n`` can be paired: those of all sets, no larger than it, that can link to it."""
    return range(band(max(1, -(-percent * n // 100))), band(n) + 1)


def lucky_seed(own: np.ndarray, percent: int) -> int:
    """First seed whose layout leaves the set more pieces than can differ, so that a shared one is certain."""
    seed = 0
    while True:
        place, _, top = _places(own, band(len(own)), seed)
        if 1 + np.count_nonzero(place[1:] != place[:-1]) > most_apart(len(own), top, percent):
            return seed
        seed += 1


def dense(own: np.ndarray) -> bytes:
    """Parity sketch of a power of two of bits, eight or more for each shingle; folds to any smaller power by XOR of its halves."""
    bits = 1 << max(6, (8 * len(own) - 1).bit_length())
    odd = np.flatnonzero(np.bincount((mixed(own ^ _STEP) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)
    out = np.zeros(bits, np.uint8)
    out[odd] = 1
    return np.packbits(out, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_id"))


def class_table(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc_id, text_id, n, class, seed, sketch) per row, staged; class is null for an empty set.  The sketch comes with the first row of a class in a task."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("seed", pa.int32()), ("sketch", pa.binary())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        per_stage(None)
        met: set[int] = set()
        for batch in batches:
            for doc_id, text_id, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), word_hashes(batch.column(1))):
                own = shingles(t, size)
                if not len(own):
                    yield doc_id, text_id, 0, None, 0, None
                    continue
                c = class_of(own)
                new = c not in met
                if len(met) < 1_000_000:
                    met.add(c)
                yield doc_id, text_id, len(own), c, lucky_seed(own, percent), dense(own) if new else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(rows(batches), schema)

    return stage(_read(docs, key, text).mapInArrow(run, "doc_id long, text_id long, n long, class long, seed int, sketch binary"), "classes")


def _keys(docs: DataFrame, size: int, percent: int, key: str, text: str, more: set[tuple[int, int]], frequent: np.ndarray | None) -> DataFrame:
    """(key, class, n) of the pieces by which a set is joined; without ``frequent``, all pieces of the sampled classes.

    ``more``: (band, seed) of further layouts, for the few sets with too few
    pieces in the first.
    """
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("n", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # _FREQUENT keys at most, rarest first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        met: set[int] = set()
        rare = None if shared.value is None else _rarest(shared.value)
        held: list[tuple[np.ndarray, int, int]] = []

        def batch_of() -> pa.RecordBatch:
            k = np.concatenate([h[0] for h in held])
            count = [len(h[0]) for h in held]
            c, n = np.repeat([h[1] for h in held], count), np.repeat([h[2] for h in held], count)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(c, pa.int64()), pa.array(n, pa.int32())], schema=schema)

        for batch in batches:
            if rare is None:  # equal texts are in the sample together, and count once
                batch = batch.filter(pa.array(np.mod(batch.column(1).to_numpy(), _SAMPLE) == 0))
            for t in word_hashes(batch.column(0)):
                own = shingles(t, size)
                n = len(own)
                if not n:
                    continue
                c = class_of(own)
                if c in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(c)
                for at in layouts(n, percent):
                    for seed in (0, *sorted(s for b, s in more if b == at)):
                        found, top = pieces(own, at, seed)
                        if rare is not None:
                            found = rare(found, most_apart(n, top, percent) + 1)
                        held.append((found, c, n))
            if sum(len(h[0]) for h in held) > 200_000:
                yield batch_of()
        if held:
            yield batch_of()

    return docs.select(text, F.xxhash64(text)).mapInArrow(run, "key long, class long, n int")


def _rarest(known: np.ndarray):
    """Chooser of the first keys of a set: those not in ``known`` by value, then the known ones, rarest first."""
    order = np.argsort(known, kind="stable")
    ascending = known[order]
    bits = np.zeros(1 << 22, bool)  # tells most keys apart from the known ones without a search
    bits[known >> np.uint64(42)] = True

    def choose(found: np.ndarray, n: int) -> np.ndarray:
        maybe = np.flatnonzero(bits[found >> np.uint64(42)])
        if len(maybe):
            at = np.minimum(np.searchsorted(ascending, found[maybe]), len(known) - 1)
            hit = ascending[at] == found[maybe]
            plain = np.ones(len(found), bool)
            plain[maybe[hit]] = False
            last = known[np.sort(order[at[hit]])]
            found = found[plain]
        else:
            last = known[:0]
        first = np.partition(found, n - 1)[:n] if len(found) > n else found
        return np.concatenate([first, last[: n - len(first)]])

    return choose


def _bitmap(ids: DataFrame) -> np.ndarray:
    """2^24 bits, one for each remainder of the text ids; at most 262,144 rows reach the driver."""
    place = ids.select(F.pmod("text_id", F.lit(1 << _BITS)).alias("place"))
    some = place.selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(pmod(place, 64) AS int)) AS bit")
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    for word, bit in some.groupBy("word").agg(F.bit_or("bit")).collect():
        bits[word] = bit
    return bits.view(np.uint8)


def _sets(docs: DataFrame, size: int, text: str, wanted: DataFrame) -> DataFrame:
    """(class, members) of the classes in ``wanted`` (class, text_id of one of its texts): a bitmap keeps other texts in the scan, the join decides."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    schema = pa.schema([("class", pa.int64()), ("members", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        per_stage(None)
        bits, met = shared.value, set()
        for batch in batches:
            ids = batch.column(1).to_numpy()
            place = np.mod(ids, 1 << _BITS)
            hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            for i, t in zip(ids[hit].tolist(), word_hashes(batch.column(0).take(pa.array(hit)))):
                if i not in met and len(own := shingles(t, size)):
                    if len(met) < 1_000_000:
                        met.add(i)
                    yield class_of(own), own.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return flushed(rows(batches), schema)

    found = docs.select(text, F.xxhash64(text)).mapInArrow(run, "class long, members binary")
    return found.join(wanted.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first("members").alias("members"))


def _farthest(both: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Most shingles by which two linked sets with ``both`` shingles together differ."""
    return both * 100 // (100 + percent) * (100 - percent) // 100  # |A or B| of a link, at most, comes first


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near(percent: int):
    """Pairs (a, b) of classes of two packs of a key, or of one by itself, not connected yet, whose sketches allow a link.

    Classes that have a smaller key in common are paired there.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def groups(key: int, pack: pa.Scalar) -> dict[int, tuple]:
        """Classes, sizes, roots, sketches and keys below ``key`` by the sketches' length in words."""
        members = pack.values
        classes, n, root = (members.field(i).to_numpy().astype(np.int64) for i in range(3))
        raw = members.field(3).to_pylist()
        lower = [{k for k in own if k < key} for own in members.field(4).to_pylist()]
        length = np.array([len(x) >> 3 for x in raw])
        out = {}
        for words in np.unique(length).tolist():
            at = np.flatnonzero(length == words)
            out[words] = (classes[at], n[at], root[at], np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(-1, words), [lower[i] for i in at])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        for batch in batches:
            packs = [batch.column(i) for i in range(1, batch.num_columns)]
            for key, left, right in zip(batch.column(0).to_pylist(), packs[0], packs[-1]):
                for w1, (c1, n1, r1, s1, k1) in (lefts := groups(key, left)).items():
                    for w2, (c2, n2, r2, s2, k2) in (groups(key, right) if len(packs) > 1 else lefts).items():
                        x, y = _folded(s1, min(w1, w2)), _folded(s2, min(w1, w2))
                        for i in range(len(c1)):
                            able = np.flatnonzero((r2 != r1[i]) & (np.minimum(n2, n1[i]) * 100 >= np.maximum(n2, n1[i]) * percent))
                            if len(packs) == 1:
                                able = able[c2[able] > c1[i]]
                            if len(able):
                                far = np.bitwise_count(x[i] ^ y[able]).sum(axis=1, dtype=np.int64)
                                able = able[far <= _farthest(n2[able] + n1[i], percent)]
                            able = np.array([j for j in able.tolist() if k1[i].isdisjoint(k2[j])], np.int64)
                            if len(able):
                                a, b = np.minimum(c2[able], c1[i]), np.maximum(c2[able], c1[i])
                                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def _tested(pairs: DataFrame, values: DataFrame, test) -> DataFrame:
    """Pairs (a, b) that pass ``test(value of a, value of b)``; ``values``: class, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_stage(None)
        for batch in batches:
            good = [test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = values.select(F.col("class").alias("a"), F.col(values.columns[1]).alias("x"))
    right = values.select(F.col("class").alias("b"), F.col(values.columns[1]).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class) per row.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their sets
    of ``size``-word runs; ``component_id`` is the smallest doc_id reachable by
    links.  Null, empty and wordless texts link with nothing; rows that repeat a
    doc_id are rows of their own; a row without doc_id gets its component's
    smallest.  Sets and classes are compared by 64-bit hashes.
    """
    table = class_table(docs, size, percent, key, text)
    odd = table.where("seed > 0").select("n", "seed").distinct()
    more = {(band(r["n"]), r["seed"]) for r in odd.collect()}  # of small sets only; a few layouts
    sample = _keys(docs, size, percent, key, text, more, None).groupBy("key").count().where("count >= 3")
    top = sample.orderBy(F.desc("count"), "key").limit(_FREQUENT).collect()
    frequent = np.array([r["key"] for r in reversed(top)], np.int64).view(np.uint64)

    keys = _keys(docs, size, percent, key, text, more, frequent)
    near = Window.partitionBy("key").orderBy("class")
    marked = keys.select("key", "class", "n", F.lag("class").over(near).alias("before"), F.lead("class").over(near).alias("after"), F.first("class").over(near).alias("least"), F.first("n").over(near).alias("least_n"), F.lag("n").over(near).alias("before_n"))
    buckets = stage(marked.where("before IS NOT NULL OR after IS NOT NULL").drop("after"), "buckets")

    first_of = table.where("sketch IS NOT NULL").groupBy("class").agg(F.first(F.struct("n", "sketch")).alias("value"), F.min("text_id").alias("text_id"))
    sketches = stage(first_of, "sketches")
    rows = stage(table.select("doc_id", "n", "class"), "rows")
    drop_staged(docs.sparkSession, table)

    def sized(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    def close(x: dict, y: dict) -> bool:
        return hamming(x["sketch"], y["sketch"]) <= _farthest(x["n"] + y["n"], percent)

    def link(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(p, q, assume_unique=True))
        return 100 * both >= percent * (len(p) + len(q) - both)

    def exact(able: DataFrame, name: str) -> DataFrame:
        wanted = able.select(F.col("a").alias("class")).union(able.select("b")).distinct().join(sketches.select("class", "text_id"), "class")
        found = stage(_tested(able, _sets(docs, size, text, wanted), link), f"{name}-links")
        drop_staged(docs.sparkSession, able)
        return found

    star = buckets.where(sized("n", "least_n")).select(F.col("least").alias("a"), F.col("class").alias("b"))
    chain = buckets.where("before IS NOT NULL").where(sized("n", "before_n")).select(F.col("before").alias("a"), F.col("class").alias("b"))
    tried = star.union(chain).where("a <> b").distinct()
    first = exact(stage(_tested(tried, sketches, close), "first-close"), "first")
    roots = stage(components(first), "roots")

    # buckets whose classes aren't all connected yet: in small ones all that are apart pair up,
    # in large ones their sketches meet chunk by chunk
    placed = buckets.select("key", "class", "n").join(roots.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.withColumn("root", F.coalesce("root", "class")).repartition("key").distinct()  # dealt by key once, for all that follows
    sizes = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members")).where("x <> y")
    left = stage(placed.join(sizes.select("key", "members"), "key"), "apart")
    p, q = left.where(F.col("members") <= _SMALL).alias("p"), left.alias("q")
    across = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.class") < F.col("q.class")) & (F.col("p.root") != F.col("q.root")) & sized("p.n", "q.n"))
    pairs = across.select(F.col("p.class").alias("a"), F.col("q.class").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    pairs = stage(_tested(pairs, sketches, close), "small-close")
    drop_staged(docs.sparkSession, buckets)
    large = left.where(F.col("members") > _SMALL).withColumn("chunk", F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / _CHUNK)))
    lowest = large.groupBy("class").agg(F.slice(F.sort_array(F.collect_set("key")), 1, _FIRST).alias("keys"))
    member = F.struct("class", "value.n", "root", "value.sketch", "keys")
    of_class = sketches.join(lowest, "class").select("class", "value", "keys")
    packs = large.drop("n").join(of_class, "class").groupBy("key", "chunk", "members").agg(F.collect_list(member).alias("pack"))  # about _CHUNK members each
    packs = stage(packs, "packs")
    one, many = packs.where(F.col("members") <= _CHUNK), packs.where(F.col("members") > _CHUNK)  # only the chunks of several meet others
    other = many.select("key", F.col("chunk").alias("chunk2"), F.col("pack").alias("pack2"))
    met = one.select("key", "pack").mapInArrow(_near(percent), "a long, b long")
    met = met.union(many.join(other, "key").where("chunk <= chunk2").select("key", "pack", "pack2").mapInArrow(_near(percent), "a long, b long"))
    able = stage(pairs.union(met).distinct(), "second-close")
    for done in (pairs, left, packs):
        drop_staged(docs.sparkSession, done)
    second = exact(able, "second")
    drop_staged(docs.sparkSession, sketches)

    roots = stage(components(first.union(second)), "roots")
    members = rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", "class", F.coalesce("root", "class").alias("root"))
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return members.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")
