"""Katz backoff language model over words, of any order.

Counts of n-grams of each length are Good-Turing discounted up to ``top``
occurrences; what the discounts of a context free is spread over the words not
seen after it, in proportion to the next shorter model, by a backoff weight that
makes every context's probabilities add up to one exactly.  A token is
scored recursively: by the probability of its longest n-gram, or else by the
weight of its context and the model one word shorter, down to single words and
the mass kept for unknown ones.

An n-gram is the columns ``w`` (its word), ``b1`` (the word before), ``b2`` and
so on, each a word's hash.  N-grams are far more than their texts' bytes, so they
are no tables: texts are kept as packs, the different words of some texts and the
numbers of these words in order, to which only the count of each word is joined.
All n-grams of two words or more are known where those with the same ``b1`` are,
so they are dealt by it into parts as blobs of arrays, a few parts at a time.  A
part builds its share of the model and scores its share of the tokens, and only
sums of the texts come back.  A frequent ``b1`` is worked off in shares by
``b2``, of which one is in memory, beside its n-grams of two words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.llm.common import drop_staged, mixed, signed, word_hashes
from hubwarden.session import shuffles_dropped, stage

#: Stand-ins for the start and the end of a text; no word has their hash but by chance.
START, END = np.uint64(0x51A7), np.uint64(0xE4D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


ORDER = 3
_TOKENS = 1 << 18  # words of a pack
_PART = 1 << 20  # words of a part, or of a frequent word's share of one
_PASSES = 4


def gram_table(docs: DataFrame, text: str = "text", *keep: str, order: int = ORDER) -> DataFrame:
    """(batch, n, kept, lens, ids, words): the n-grams of some texts a row, as their words in order.

    ``words`` are the different words of the texts and ``ids`` those of each
    text one after the other, END behind each; ``n`` counts them, ``lens`` for
    each text.  The n-grams of every length up to ``order`` are read off them:
    before a text stand as many STARTs as a context has words.
    """
    kinds = ", ".join(f"kept_{i}: {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep))

    def made(number: int, some: pa.RecordBatch, texts: list[np.ndarray]) -> pa.RecordBatch:
        words, ids = np.unique(np.concatenate(texts), return_inverse=True)
        ids = ids.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        lens = np.array([len(t) for t in texts], np.int64)
        columns = {"batch": pa.array([number], pa.int64()), "n": pa.array([len(ids)], pa.int64())}
        if keep:
            rows = pa.StructArray.from_arrays([some.column(i) for i in range(len(keep))], [f"kept_{i}" for i in range(len(keep))])
            columns["kept"] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        columns |= {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("lens", lens), ("ids", ids), ("words", words))}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, held, start = [], 0, 0
            for j, own in enumerate(word_hashes(batch.column(len(keep)))):
                texts.append(np.append(own, END))
                held += len(own) + 1
                if held >= _TOKENS or j + 1 == batch.num_rows:
                    yield made(number, batch.take(pa.array(range(start, j + 1))), texts)
                    number, texts, held, start = number + 1, [], 0, j + 1

    kept = f"kept array<struct<{kinds}>>, " if keep else ""
    return docs.select(*keep, text).mapInArrow(run, f"batch long, n long, {kept}lens binary, ids binary, words binary")


def discounts(seen: dict[int, int], top: int) -> list[float]:
    """Good-Turing discount ratio of the counts 1 to ``top``; ``seen``: how many n-grams have each count.

    Where the counts of counts give no ratio between nought and one, absolute
    discounting takes its place for all counts.
    """
    n = [0, *(seen.get(r, 0) for r in range(1, top + 2))]
    ratios = []
    if all(n[1:]):
        tail = (top + 1) * n[top + 1] / n[1]
        if tail < 1:
            ratios = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, top + 1)]
    if not ratios or not all(0 < x < 1 for x in ratios):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        ratios = [(r - off) / r for r in range(1, top + 1)]
    return ratios


@dataclass
class Model:
    """The training texts with the count ``c`` of each word, discount ratios of each length from single words up, and sums."""

    packs: DataFrame
    counts: DataFrame
    parts: int
    ratios: list[list[float]]
    tokens: int
    types: int
    texts: int
    total: float
    unknown: float


def _blob(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words of a pack, the number of each in its texts' order, and the lengths of the texts."""
    words = _blob(batch.column("words")[i], np.uint64)
    return words, _blob(batch.column("ids")[i], np.uint16 if len(words) <= 1 << 16 else np.uint32), _blob(batch.column("lens")[i], np.int64)


def _grams(words: np.ndarray, ids: np.ndarray, lens: np.ndarray, length: int) -> list[np.ndarray]:
    """Columns ``b2``, ``b1``, ``w`` (for three words) of the n-gram that ends at each word."""
    w = words[ids]
    at = np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)
    return [*(np.where(at >= i, np.append(np.full(min(i, len(w)), START), w[:-i]), START) for i in range(length - 1, 0, -1)), w]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    whole = columns[0]
    for g in columns[1:]:
        whole = mixed(whole * _STEP + g)
    return whole


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as eight planes of bytes, of which the upper ones take no room once compressed."""
    return counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _wide(blob: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(_blob(blob, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def _dealt(packs: DataFrame, parts: int, own) -> DataFrame:
    """(part, batch, keys, n): the sorted hashes and counts that ``own`` gives for each pack, by their highest bits."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("batch").to_pylist()):
                keys, n = own(*_opened(batch, i))
                rows = [(p, number, keys[a:b].tobytes(), _narrow(n[a:b])) for p, a, b in _cut((keys >> shift).astype(np.int64))]
                kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _DEALT)

    return packs.select("batch", "lens", "ids", "words").mapInArrow(run, "part int, batch long, keys binary, n binary")


_DEALT = ["part", "batch", "keys", "n"]


def _summed_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of the blobs, sorted, and the sums of their counts."""
    keys = np.concatenate([_blob(x, np.uint64) for x in table.column("keys")])
    n = np.concatenate([_wide(x) for x in table.column("n")])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _words_of(words: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words, np.bincount(ids, minlength=len(words))


def _word_counts(packs: DataFrame, parts: int) -> DataFrame:
    """(part, batch, keys, n): the words of each part and their counts, one row with the batch -1."""

    def count(table: pa.Table) -> pa.Table:
        keys, n = _summed_keys(table)
        return pa.table({"part": table.column("part").slice(0, 1), "batch": [-1], "keys": [keys.tobytes()], "n": [_narrow(n)]})

    return stage(_dealt(packs, parts, _words_of).groupBy("part").applyInArrow(count, "part int, batch long, keys binary, n binary"), "words")


def _histogram(counts: DataFrame) -> tuple[dict[int, int], int]:
    """How many words have each count, and the count of END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1)):
                n = _wide(n)
                c, of = np.unique(n, return_counts=True)
                end = n[_blob(keys, np.uint64) == END]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(c, np.zeros(len(end), np.int64))), pa.array(np.append(of, end))], ["c", "n"])

    found = counts.select("keys", "n").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    seen = {r["c"]: r["n"] for r in found.collect()}
    return {c: n for c, n in seen.items() if c}, seen.get(0, 0)


def _with_counts(packs: DataFrame, counts: DataFrame, parts: int, tokens: int) -> DataFrame:
    """Packs with the count of each of their words in ``c``, by part, nought for unknown ones; some packs at a time lie on disk twice."""

    def look_up(table: pa.Table) -> pa.Table:
        numbers = table.column("batch").to_pylist()
        known = [(_blob(k, np.uint64), _wide(n)) for b, k, n in zip(numbers, table.column("keys"), table.column("n")) if b < 0]
        keys, c = known[0] if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        asked = [(b, _blob(k, np.uint64)) for b, k in zip(numbers, table.column("keys")) if b >= 0]
        found = [_narrow(np.nan_to_num(_found(k, keys, c)).astype(np.int64)) for _, k in asked]
        part = table.column("part")[0].as_py()
        return pa.table([pa.array([b for b, _ in asked], pa.int64()), pa.array([part] * len(asked), pa.int32()), pa.array(found, pa.binary())], ["batch", "part", "c"])

    slices, done = max(min(4, 1 + tokens // _PART), 1 + tokens // (parts * _PART)), []
    for i in range(slices):
        some = packs.where(F.col("batch") % slices == i)
        own = _dealt(some, parts, _words_of).unionByName(counts).groupBy("part").applyInArrow(look_up, "batch long, part int, c binary")
        own = stage(own, "counts")
        each = F.array_sort(F.collect_list(F.struct("part", "c")))["c"]
        done.append(stage(some.join(own.groupBy("batch").agg(each.alias("c")), "batch"), "counted"))
        drop_staged(packs.sparkSession, own)
    return reduce(DataFrame.unionByName, done)


def _counts_in(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.concatenate([_wide(x) for x in batch.column("c")[i].values])


def _powers_of_two(n: int, least: int, most: int = 1 << 20) -> int:
    return min(most, max(least, 1 << max(0, n).bit_length()))


def _counts_of_counts(packs: DataFrame, parts: int, length: int, top: int) -> dict[int, int]:
    """How many n-grams of ``length`` words have each count up to ``top`` and one."""

    def own(*pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_hash(_grams(*pack, length)), return_counts=True)

    def count(table: pa.Table) -> pa.Table:
        _, c = _summed_keys(table)
        seen = np.bincount(c[c <= top + 1], minlength=top + 2)
        return pa.table({"c": np.arange(len(seen)), "n": seen})

    found = _dealt(packs, parts, own).groupBy("part").applyInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    with shuffles_dropped(packs.sparkSession):
        return {r["c"]: r["n"] for r in found.where("n > 0").collect()}


def _mass(c: np.ndarray, ratios: list[float]) -> np.ndarray:
    """Discounted counts."""
    return c * np.append(ratios, 1.0)[np.minimum(c.astype(np.int64), len(ratios) + 1) - 1]


def train(grams: DataFrame, top: int = 5, order: int = ORDER) -> Model:
    """Model of the training texts in ``grams``; none of them leaves all mass to unknown words.

    Only words become a table.  Longer n-grams are counted part by part for
    their discounts, and again by ``score_documents`` where they are used.
    """
    packs = stage(grams, "packs")
    parts = _powers_of_two((packs.agg(F.sum("n")).first()[0] or 0) // _PART, 16)
    counts = _word_counts(packs, parts)
    words, texts = _histogram(counts)
    tokens = sum(c * n for c, n in words.items())
    ratios = [discounts(words, top)] + [discounts(_counts_of_counts(packs, parts, k, top), top) for k in range(2, order + 1)]
    # words: the discounts free some mass for unknown words, at least that of half an occurrence
    c = np.array(sorted(words), np.int64)
    kept = float((_mass(c, ratios[0]) * [words[x] for x in c.tolist()]).sum())
    total = max(float(tokens), kept + 0.5)
    counted = _with_counts(packs, counts, parts, tokens)
    drop_staged(grams.sparkSession, packs)
    return Model(counted, counts, parts, ratios, tokens, sum(words.values()), texts, total, (total - kept) / total)


def _in_parts(packs: DataFrame, model: Model, parts: int, passes: int, now: int, scored: bool) -> DataFrame:
    """(part, tag, kind, batch, grams, c, x): what the parts of a pass need of the texts.

    A word's n-grams lie in the part of the word before it.  Training texts give
    the two-word n-grams with counts (kind 0, tag -1) and whole n-grams (kind 1);
    texts to score give whole n-grams (kind 2) with the text of each.  Frequent
    words before are shared out over tags by the word before them.
    """
    order, texts = len(model.ratios), model.texts
    shift = np.uint64(64 - (parts.bit_length() - 1))
    start = int((mixed(np.array([START]) * _STEP) >> shift)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, number in enumerate(batch.column("batch").to_pylist()):
                words, ids, lens = _opened(batch, i)
                c = _counts_in(batch, i)
                # of the word before each: its part, and how many tags it has beyond one
                part, more = (np.roll(x[ids], 1) for x in ((mixed(words * _STEP) >> shift).astype(np.int64), c // _PART))
                first = np.cumsum(lens) - lens
                part[first], more[first] = start, texts // _PART
                mine = np.flatnonzero(part % passes == now)
                if not len(mine):
                    continue
                grams = [g[mine] for g in _grams(words, ids, lens, order)]
                own, rows = part[mine], []
                if not scored:
                    _, at, n = np.unique(_hash(grams[-2:]), return_index=True, return_counts=True)
                    at, n = (x[np.argsort(own[at], kind="stable")] for x in (at, n))
                    two, many = [g[at] for g in grams[-2:]], c[ids[mine[at]]]
                    for p, a, b in _cut(own[at]):
                        rows.append((p, -1, 0, number, np.concatenate([g[a:b] for g in two]).tobytes(), _narrow(many[a:b]), _narrow(n[a:b])))
                if scored or order > 2:
                    spread = mixed(grams[-3 if order > 2 else -1] * _STEP) % (more[mine] + 1).astype(np.uint64)
                    key = own << 24 | spread.astype(np.int64)
                    by = np.argsort(key, kind="stable")
                    text = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)[mine[by]] if scored else None
                    many = c[ids[mine[by]]]
                    grams = [g[by] for g in grams]
                    for k, a, b in _cut(key[by]):
                        known = (_narrow(many[a:b]), text[a:b].tobytes()) if scored else (b"", b"")
                        rows.append((k >> 24, k & 0xFFFFFF, 1 + scored, number, np.concatenate([g[a:b] for g in grams]).tobytes(), *known))
                kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 1000]), kinds)], _PARTED)

    return packs.select("batch", "lens", "ids", "words", "c").mapInArrow(run, "part int, tag int, kind int, batch long, grams binary, c binary, x binary")


_PARTED = ["part", "tag", "kind", "batch", "grams", "c", "x"]


def _cut(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each of the sorted keys, where it begins and where it ends."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    yield from zip(keys[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key in a sorted table, NaN for those it doesn't have."""
    if not len(table):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], np.nan)


@dataclass
class Level:
    """N-grams of one length in a part and their probabilities, contexts and their weights; keys are hashes."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _level(grams: np.ndarray, contexts: np.ndarray, c: np.ndarray, below: np.ndarray, ratios: list[float], unknown: float) -> Level:
    """Level of different n-grams with their counts; whatever was seen after a context, the shorter model has seen after its end."""
    mass = _mass(c, ratios)
    known, of = np.unique(contexts, return_inverse=True)
    all_of, kept, seen = (np.bincount(of, x, len(known)) for x in (c, mass, below))
    total = np.maximum(all_of, kept + 0.5)
    # unknown words are never among the seen, so something is left but for rounding
    return Level(grams, mass / total[of], known, (1 - kept / total) / np.maximum(1 - seen, unknown * 1e-9))


def _merged(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """(b1, w, count of w, n) of the different two-word n-grams of some blobs, sorted by their hash."""
    columns = [np.concatenate(x) for x in zip(*held)]
    grams, first, of = np.unique(_hash(columns[:2]), return_index=True, return_inverse=True)
    return (*(x[first] for x in columns[:3]), np.bincount(of, columns[3], len(grams)).astype(np.int64))


def _scored(model: Model):
    ratios, total, unknown = model.ratios, model.total, model.unknown
    order = len(ratios)

    def p_word(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _mass(np.maximum(c, 1), ratios[0]) / total, unknown)

    def two(held: list[tuple]) -> Level:
        if not held:
            return Level(*(np.zeros(0, k) for k in (np.uint64, float, np.uint64, float)))
        b1, w, c_word, n = _merged(held)
        return _level(_hash([b1, w]), b1, n, p_word(c_word), ratios[1], unknown)

    def levels(first: Level, seen: list[np.ndarray]) -> list[Level]:
        found = [first]
        columns = [np.concatenate(x) for x in zip(*seen)] if seen else [np.zeros(0, np.uint64)] * order
        for length in range(3, order + 1):
            own = columns[-length:]
            grams, at, c = np.unique(_hash(own), return_index=True, return_counts=True)
            own = [x[at] for x in own]
            below = _found(_hash(own[1:]), found[-1].grams, found[-1].p)
            found.append(_level(grams, _hash(own[:-1]), c, below, ratios[length - 1], unknown))
        return found

    def sums(found: list[Level], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, grams, c, texts = ([a[i] for a in asked] for i in range(4))
        grams, c = np.concatenate(grams, axis=1), np.concatenate(c)
        log, open_ = np.zeros(len(c)), np.arange(len(c))
        for length in range(order, 1, -1):
            level, own = found[length - 2], [g[open_] for g in grams[-length:]]
            p = _found(_hash(own), level.grams, level.p)
            # a context that was never seen has no mass of its own: the shorter model decides
            weight = np.nan_to_num(_found(_hash(own[:-1]), level.contexts, level.weights), nan=1.0)
            log[open_] += np.log10(np.where(np.isnan(p), weight, p))
            open_ = open_[np.isnan(p)]
        log[open_] += np.log10(p_word(c[open_]))
        of_blob = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        keys, of = np.unique(of_blob << 32 | np.concatenate(texts), return_inverse=True)
        own, some = np.bincount(of, log), (keys & 0xFFFFFFFF).astype(np.uint32)
        rows = [(numbers[k], some[a:b].tobytes(), own[a:b].tobytes()) for k, a, b in _cut(keys >> 32)]
        kinds = pa.int64(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["batch", "texts", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = tag = None
        pairs, held, first, seen, found, asked, many = [], 0, None, [], None, [], 0
        for batch in batches:
            for p, t, kind, number, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), *(batch.column(i) for i in range(4, 7))):
                if (p, t) != (part, tag):
                    if asked:
                        yield from sums(found, asked)
                    if p != part:
                        pairs, held, first = [], 0, None
                    part, tag, seen, found, asked, many = p, t, [], None, [], 0
                grams = _blob(blobs[0], np.uint64)
                if kind == 0:
                    pairs.append((*grams.reshape(2, -1), _wide(blobs[1]), _wide(blobs[2])))
                    held += len(grams) // 2
                    if held > max(4 * _PART, len(pairs[0][0])):
                        pairs, held = [_merged(pairs)], 0
                    continue
                if kind == 1:
                    seen.append(grams.reshape(order, -1))
                    continue
                # rows are sorted by kind: all of the training texts have come
                if first is None:
                    first, pairs = two(pairs), []
                if found is None:
                    found, seen = levels(first, seen), []
                asked.append((number, grams.reshape(order, -1), _wide(blobs[1]), _blob(blobs[2], np.uint32)))
                many += len(grams) // order
                if many >= _TOKENS:
                    yield from sums(found, asked)
                    asked, many = [], 0
        if asked:
            yield from sums(found, asked)

    return run


def _summed(table: pa.Table) -> pa.Table:
    texts = np.concatenate([_blob(x, np.uint32) for x in table.column("texts")])
    sums = np.bincount(texts, np.concatenate([_blob(x, np.float64) for x in table.column("sums")]))
    places = np.arange(len(sums), dtype=np.uint32)
    return pa.table({"batch": table.column("batch").slice(0, 1), "texts": pa.array([places.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})


def score_documents(docs: DataFrame, model: Model, text: str = "text", *keep: str) -> DataFrame:
    """(kept columns, n_tokens, n_known, score, base_score) of each row of ``docs`` by itself, whatever its kept columns repeat or lack, or are called.

    ``score``: log10 probability of the text.  ``base_score``: each token by (c + 0.5) / (N + 0.5 (V + 1)).
    The n-grams go through in several passes, by the word before their last one,
    so that a share of them lies on disk at a time.
    """
    spark, order = docs.sparkSession, len(model.ratios)
    packs = stage(gram_table(docs, text, *keep, order=order), "packs")
    tokens = packs.agg(F.sum("n")).first()[0] or 0
    counted = _with_counts(packs, model.counts, model.parts, tokens)
    drop_staged(spark, packs)
    kind = "batch long, texts binary, sums binary"
    done = []
    if order > 1:
        tokens += model.tokens
        passes = _powers_of_two(tokens // (4 * _PART), 1, _PASSES)
        parts = passes * _powers_of_two(tokens // (_PART * passes), 8)
        for now in range(passes):
            both = [_in_parts(x, model, parts, passes, now, scored) for x, scored in ((model.packs, False), (counted, True))]
            sorted_ = both[0].unionByName(both[1]).repartition(parts // passes, "part").sortWithinPartitions("part", "tag", "kind")
            done.append(stage(sorted_.mapInArrow(_scored(model), kind).groupBy("batch").applyInArrow(_summed, kind), "sums"))
        found = reduce(DataFrame.unionByName, done).groupBy("batch").applyInArrow(_summed, kind)
        counted = counted.join(found.select("batch", "sums"), "batch")
    ratios, total, unknown = model.ratios, model.total, model.unknown
    base = model.tokens + 0.5 * (model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, lens = _opened(batch, i)
                c = _counts_in(batch, i)[ids]
                first = np.cumsum(lens) - lens
                if order > 1:
                    score = _blob(batch.column("sums")[i], np.float64)
                else:
                    score = np.add.reduceat(np.log10(np.where(c > 0, _mass(np.maximum(c, 1), ratios[0]) / total, unknown)), first)
                own = [lens, np.add.reduceat((c > 0).astype(np.int64), first), score, np.add.reduceat(np.log10((c + 0.5) / base), first)]
                rows = batch.column("kept")[i].values.flatten() if keep else []
                yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, own)], [*names, "n_tokens", "n_known", "score", "base_score"])

    names = [f"kept_{i}" for i in range(len(keep))]
    kinds = "".join(f"{o} {docs.schema[k].dataType.simpleString()}, " for o, k in zip(names, keep))
    wanted = ["lens", "ids", "words", "c", *(["kept"] if keep else []), *(["sums"] if order > 1 else [])]
    scored = counted.select(*wanted).mapInArrow(run, kinds + "n_tokens long, n_known long, score double, base_score double")
    return scored.withColumnsRenamed(dict(zip(names, keep)))
