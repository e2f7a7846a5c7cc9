"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, names and units turn
into typed placeholders, other words into lower case.  Windows of a benchmark
item's template are hash-joined with the windows of all documents, so a
question with other numbers or names still meets its original.  A match must
then be consistent: within one alignment every slot value of the item stands
for one value of the document and the other way round.

Documents are read once, without a shuffle.  A bitmap of the benchmark's window
hashes (2 MB, whatever the benchmark's size) tells which windows may match;
only those leave the scan, and the join decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.llm.common import mixed, per_stage, signed, windows

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n:;|\"]")
_LITERAL, _BREAK, _NUMBER, _CAPITAL, _UNIT, _NAME = range(6)
_BITS = 24
_KEPT = 400_000

# Units of measure that may follow a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years percent cent cents dollar dollars euro euros degree degrees mph kmh watt watts volt volts".split()
)


class _Kinds(dict):
    """Hash and kind of a token; the kind is in the last three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        first = token[0]
        if first.isdigit():
            kind = _NUMBER
        elif not first.isalpha():
            kind = _BREAK
        elif token.lower() in UNITS:
            kind = _UNIT
        else:
            kind = _CAPITAL if first.isupper() and token[1:].islower() else _LITERAL
        value = self[token] = (xxhash.xxh3_64_intdigest(token.lower()) & ~7) | kind
        return value


def _kinds() -> _Kinds:
    return per_stage(_Kinds)


class Template:
    """Template tokens of a text: ``shape`` and ``raw`` hashes, ``slot`` kinds (0: literal) and the tokens' texts."""

    def __init__(self, text: str):
        tokens = _TOKEN.findall(text)
        code = np.fromiter(map(_kinds().__getitem__, tokens), np.uint64, len(tokens))
        kind = (code & np.uint64(7)).astype(np.int8)
        before = np.concatenate([[_BREAK], kind[:-1]]).astype(np.int8)
        kind = np.where((kind == _CAPITAL) & (before != _BREAK), _NAME, kind)
        kind = np.where((kind == _CAPITAL) | ((kind == _UNIT) & (before != _NUMBER)), _LITERAL, kind)
        # neighbouring names are one slot: the later ones go, and their texts join the first
        follows = np.concatenate([[False], (kind[1:] == _NAME) & (kind[:-1] == _NAME)]) if len(kind) else np.zeros(0, bool)
        keep = np.flatnonzero((kind != _BREAK) & ~follows)
        self.slot = kind[keep]
        self.raw = mixed(code[keep] & ~np.uint64(7))
        self.shape = np.where(self.slot == _LITERAL, self.raw, mixed(self.slot.astype(np.uint64)))
        self._tokens, self._at, self._follows = tokens, keep, follows

    def value(self, i: int) -> str:
        """Text of the slot at place ``i``; empty for a literal."""
        if self.slot[i] == _LITERAL:
            return ""
        a = b = int(self._at[i])
        while b + 1 < len(self._tokens) and self._follows[b + 1]:
            b += 1
        return " ".join(self._tokens[a : b + 1]).lower()

    def windows(self, size: int) -> np.ndarray:
        """A hash for each run of ``size`` tokens: of its shape, or of its raw tokens where fewer than half are literals."""
        literal = np.concatenate([[0], np.cumsum(self.slot == _LITERAL)])
        shape, raw = windows(self.shape, size), windows(self.raw, size)
        if not len(shape):
            return shape
        plenty = 2 * (literal[size:] - literal[:-size]) >= size
        return np.where(plenty, shape, raw ^ np.uint64(0x5BD1E995)) + np.uint64(size)


def _item_windows(size: int):
    schema = pa.schema([("hash", pa.int64()), ("item_id", pa.int64()), ("item_at", pa.int32()), ("n_tokens", pa.int32()), ("size", pa.int32()), ("item_slots", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = Template(text or "")
                n = len(t.slot)
                own = min(size, n)
                for i, h in enumerate(signed(t.windows(own)).tolist() if own else ()):
                    rows.append((h, item_id, i, n, own, [t.value(j) for j in range(i, i + own)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _matching_windows(sizes: list[int], bitmap: np.ndarray):
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("doc_at", pa.int32()), ("doc_slots", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = Template(text.as_py() or "")
                for size in sizes:
                    own = t.windows(size)
                    at = own >> np.uint64(64 - _BITS)
                    hit = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    for i in np.flatnonzero(hit).tolist():
                        rows.append((int(own[i].astype(np.int64)), doc_id, i, [t.value(j) for j in range(i, i + size)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _bitmap(items: DataFrame) -> np.ndarray:
    """2^24 bits, set at the leading bits of each window's hash; at most 262,144 rows reach the driver."""
    place = items.select(F.shiftrightunsigned("hash", 64 - _BITS).alias("place"))
    words = place.selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(pmod(place, 64) AS int)) AS bit")
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    for word, bit in words.groupBy("word").agg(F.bit_or("bit")).collect():
        bits[word] = bit
    return bits.view(np.uint8)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered places and slots of each alignment whose slot values map one to one."""
    for batch in batches:
        covered, slots, changed, odd = [], [], [], []
        for matches in batch.column("matches").to_pylist():
            places: dict[int, tuple[str, str]] = {}
            for m in matches:
                for i, (a, b) in enumerate(zip(m["item_slots"], m["doc_slots"])):
                    places[m["item_at"] + i] = (a, b)
            there, back = defaultdict(Counter), defaultdict(Counter)
            filled = {p: ab for p, ab in places.items() if ab[0] or ab[1]}
            for a, b in filled.values():
                there[a][b] += 1
                back[b][a] += 1
            best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in there.items()}
            home = {b: min(c, key=lambda a: (-c[a], a)) for b, c in back.items()}
            bad = sum(best[a] != b or home[b] != a for a, b in filled.values())
            covered.append(len(places) - bad)
            slots.append(len(filled))
            changed.append(sum(a != b for a, b in filled.values()))
            odd.append(bad)
        kept = [batch.column(n) for n in ("doc_id", "item_id", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*kept, *(pa.array(x, pa.int64()) for x in (covered, slots, changed, odd))],
            ["doc_id", "item_id", "n_tokens", "covered", "slots", "changed", "odd"],
        )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 8,
    run: int = 13,
    share: float = 0.5,
    odd: float = 0.2,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per contaminated (document, item).

    (doc_id, item_id, covered, n_tokens, slots, changed): template tokens of the
    item that one alignment covers, the item's tokens, its slots in the covered
    part, and those whose value the document changed.  An alignment counts if it
    covers ``run`` tokens or ``share`` of the item, and at most ``odd`` of its
    slots break the one-to-one mapping.  An item of fewer than ``size`` tokens
    matches as a whole; null and empty texts have no window.  Rows with a null
    key take no part; rows that repeat a key count as one document.
    """
    named = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL")
    kind = "hash long, item_id long, item_at int, n_tokens int, size int, item_slots array<string>"
    items = named.mapInArrow(_item_windows(size), kind)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``size`` values
    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    found = wanted.mapInArrow(_matching_windows(sizes, _bitmap(items)), "hash long, doc_id long, doc_at int, doc_slots array<string>")
    met = found.join(items, "hash").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    # an alignment has no more windows than the item has tokens
    aligned = met.groupBy("doc_id", "item_id", "shift").agg(
        F.first("n_tokens").alias("n_tokens"),
        F.collect_set(F.struct("item_at", "item_slots", "doc_slots")).alias("matches"),
    )
    judged = aligned.select("doc_id", "item_id", "n_tokens", "matches").mapInArrow(
        _judged, "doc_id long, item_id long, n_tokens int, covered long, slots long, changed long, odd long"
    )
    enough = F.col("covered") >= F.least(F.lit(run), F.ceil(F.col("n_tokens") * share))
    kept = judged.where(enough & (F.col("odd") <= F.col("slots") * odd))
    best = F.max(F.struct("covered", (-F.col("changed")).alias("same"), "slots", "n_tokens")).alias("b")
    return kept.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.covered", F.col("b.n_tokens").cast("long").alias("n_tokens"), "b.slots", (-F.col("b.same")).alias("changed")
    )
