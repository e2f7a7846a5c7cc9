"""Rule tables of any length: thousands of patterns and phrases in one pass over each text.

``operators.patterns`` unrolls its rules into the projection, which suits the few
dozen rules of an audit.  Here the rules are rows of a table.  All their literals
lie in one automaton, which walks a text once and names the few rules that may
hit; only those run, as Java regular expressions chosen per row.  The plan is the
same for one rule and for a hundred thousand, and the hits are those of
``patterns.find_rules``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden.functions.text import ODD_CASE, contains_any, java_regex, once
from hubwarden.operators.patterns import Family
from hubwarden.rules import Pattern
from hubwarden.session import stage

SCHEMA = (
    "check string, rule string, mode string, ignore_case boolean, needles array<string>, linear string"
)
MODES = ("count", "search", "phrase", "literal")
#: Rules that every task may hold; those of a larger table are joined.
MAX_RULES = 100_000
#: ODD_CASE letters and the ASCII letters that a match in any case takes them for.
_ASCII_OF_ODD = "siik"
_CANDIDATES = "array<struct<check:string,rule:string,mode:string,regex:string,linear:string>>"
_COLUMNS = ("check", "rule", "mode", "ignore_case", "needles", "linear")
_FEWEST, _MOST = 24, 30  # powers of two between which the bits of a bitmap lie, 32 for a literal or more
_SEGMENTS = 64  # a bitmap is made in so many pieces
_WIDTHS = np.array([1, 2, 4, 8, 16, 64, 256, 1024, 4096])  # bytes of a key
_LONGEST = 8191  # bytes of a literal that are looked for together
_SLICE = 1 << 18  # bytes of text that are hashed together
_TRIED = 1 << 18  # pairs of a place and a length that are hashed together
_POINT = 0x9FB21C651E98DF25
_STEP = np.uint64(0x9E3779B97F4A7C15)


def rules_of(families: Sequence[Family]) -> list[tuple]:
    """The rules of ``families`` as rows of ``SCHEMA``; conditions on rows (``applies``) stay with the families."""
    rows = []
    for family in families:
        for rule in family.rules:
            if isinstance(rule, Pattern):
                rows.append((family.check, rule.regex, family.mode, rule.ignore_case, list(rule.needles), rule.linear))
            else:
                rows.append((family.check, rule, family.mode, family.mode == "phrase", [rule], None))
    return rows


def rule_table(spark: SparkSession, families: Sequence[Family]) -> DataFrame:
    return spark.createDataFrame(rules_of(families), SCHEMA)


def _checked(rules: DataFrame, max_rules: int | None, held: int) -> list[tuple] | None:
    """The rules as sorted rows, none if there are more than ``held``; a table of more than ``max_rules`` rows is refused."""
    most = held if max_rules is None else min(held, max_rules)
    rules = rules.select(*_COLUMNS)
    bad = rules.where(F.col("check").isNull() | F.col("rule").isNull() | ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"a rule needs a check, a text and a mode out of {MODES}: {bad}")
    rows = rules.distinct().limit(most + 1).collect()
    if max_rules is not None and len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules; raise max_rules or leave it out")
    if len(rows) > most:
        if max_rules is not None and rules.distinct().limit(max_rules + 1).count() > max_rules:
            raise ValueError(f"more than {max_rules} rules; raise max_rules or leave it out")
        return None
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2], str(r[3:])))


def _literals(rule: tuple) -> tuple[list[str], bool]:
    """Literals one of which any hit contains, and whether they are searched in lower case; none: the rule always runs.

    For patterns in any case only ASCII literals prove something: of other
    letters, matching has forms that lower-casing a text doesn't reach.
    """
    _, text, mode, ignore_case, needles, _ = rule
    if mode in ("phrase", "literal"):
        return ([text] if text else []), mode == "phrase"
    needles = list(needles or [])
    if not all(needles) or ignore_case and not all(n.isascii() for n in needles):
        return [], bool(ignore_case)
    return ([n.lower() for n in needles] if ignore_case else needles), bool(ignore_case)


def _automaton(words: dict[str, list[int]]):
    found = ahocorasick.Automaton()
    for word, rules in words.items():
        found.add_word(word, rules)
    found.make_automaton()
    return found


def _java(rule: tuple, regex: str | None) -> str | None:
    _, text, mode, ignore_case, _, _ = rule
    if mode in ("phrase", "literal") or regex is None:
        return None
    return java_regex(Pattern(text, bool(ignore_case)), regex)


def _candidates(rules: list[tuple]) -> tuple[Callable, bool]:
    """Function of three text columns that gives the rules which may hit, and whether the first one is needed.

    The columns are the text as written, in lower case, and, where it holds a
    letter of ``ODD_CASE``, in lower case with those letters replaced.
    """
    always, exact, folded = [], {}, {}
    for index, rule in enumerate(rules):
        needles, any_case = _literals(rule)
        if not needles:
            always.append(index)
        for needle in set(needles):
            (folded if any_case else exact).setdefault(needle, []).append(index)
    bodies = [
        {"check": r[0], "rule": r[1], "mode": r[2], "regex": _java(r, r[1]), "linear": _java(r, r[5])} for r in rules
    ]

    @F.pandas_udf(_CANDIDATES)
    def candidates(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        search_exact, search_folded = (words and _automaton(words) for words in (exact, folded))

        def of(written: str | None, lowered: str | None, plain: str | None) -> list[dict] | None:
            if lowered is None:
                return None
            hit = set(always)
            for search, text in ((search_exact, written), (search_folded, lowered), (search_folded, plain)):
                if search and text:
                    # a literal's list of rules is one object, unpacked once however often the literal occurs
                    lists = {id(found): found for _, found in search.iter(text)}
                    hit.update(i for found in lists.values() for i in found)
            return [bodies[i] for i in sorted(hit)]

        for columns in batches:
            yield pd.Series([of(*texts) for texts in zip(*columns)], dtype=object)

    return candidates, bool(exact)


def _matches(text: Column, lowered: Column, rule: Column) -> Column:
    by_line = F.size(F.array_remove(F.regexp_extract_all(text, rule["linear"], F.lit(1)), ""))
    counted = F.when(rule["linear"].isNotNull(), by_line).otherwise(F.regexp_count(text, rule["regex"]))
    searched = F.when(rule["linear"].isNotNull(), (by_line > 0).cast("int")).otherwise(
        F.regexp_like(text, rule["regex"]).cast("int")
    )
    return (
        F.when(rule["mode"] == "count", counted)
        .when(rule["mode"] == "search", searched)
        .when(rule["mode"] == "phrase", F.contains(lowered, rule["rule"]).cast("int"))
        .otherwise(F.contains(text, rule["rule"]).cast("int"))
        .cast("long")
    )


@cache
def _powers(point: int) -> np.ndarray:
    out = np.full(_SLICE + _LONGEST, point, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_POINT)[: len(data)], out=out[1:])
    return out


def _runs(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` bytes, out of the sums of at most a slice and a literal."""
    return (sums[width:] - sums[:-width]) * _powers(pow(_POINT, -1, 1 << 64))[: max(0, len(sums) - width)]


def _runs_at(sums: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the runs that begin ``at`` and have a ``length`` each."""
    return (sums[at + length] - sums[at]) * _powers(pow(_POINT, -1, 1 << 64))[at]


def _keys(runs: np.ndarray, length: np.ndarray | int, folded: bool) -> np.ndarray:
    return _mixed(runs * _STEP + np.asarray(2 * length + folded).astype(np.uint64))


def _whole_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The four bits of a whole literal."""
    for own in (keys, _mixed(keys * _STEP)):
        yield own >> np.uint64(64 - bits)
        yield own & np.uint64((1 << bits) - 1)


def _set(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def _keyed_literals(literals: DataFrame) -> DataFrame:
    """(_id, folded, width, length, run, key, whole) of each literal (_id, folded, literal).

    ``run`` and ``key`` are the hashes of its first ``width`` bytes, ``whole``
    that of all its ``length`` bytes; of a very long one the first ones stand for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folded, literal in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = np.frombuffer(literal.encode()[:_LONGEST], np.uint8)
                width = int(_WIDTHS[np.searchsorted(_WIDTHS, len(data), "right") - 1])
                sums = _sums(data)
                first, all_of_it = _runs(sums[: width + 1], width), _runs(sums, len(data))
                own = (first, _keys(first, width, folded), _keys(all_of_it, len(data), folded))
                rows.append((width, len(data), *(h.view(np.int64)[0] for h in own)))
            columns = [pa.array(np.array(c, np.int64)) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "folded", "width", "length", "run", "key", "whole"])

    return literals.mapInArrow(run, "_id long, folded boolean, width long, length long, run long, key long, whole long")


def _bitmap(keyed: DataFrame, bits: int, whole: bool) -> np.ndarray:
    """2^bits bits, those of the literals' first runs or of the whole literals; tasks make it in segments."""
    shift = bits - (_SEGMENTS.bit_length() - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run, key = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            place = np.unique(np.concatenate([*_whole_places(key, bits)] if whole else [x >> np.uint64(64 - bits) for x in (run, key)]))
            columns = [pa.array(x.astype(np.int64)) for x in (place >> np.uint64(shift), place)]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "place"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(segment).tolist():
                at = place[segment == s] - (s << shift)
                np.bitwise_or.at(own.setdefault(s, np.zeros(1 << (shift - 3), np.uint8)), at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for s, found in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["segment", "bits"])

    places = keyed.select("run", "whole" if whole else "key").mapInArrow(placed, "segment long, place long")
    out = np.zeros((_SEGMENTS, 1 << (shift - 3)), np.uint8)
    for segment, found in places.repartition("segment").mapInArrow(joined, "segment long, bits binary").collect():
        out[segment] = np.frombuffer(found, np.uint8)
    return out.reshape(-1)


def _literals_met(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """(_row, whole) of the literals that each text (_row, as written, in lower case, without odd letters) holds, and very few others.

    All texts of a batch are hashed together.  Where a first run may be a
    literal's, the runs of all lengths that such literals have are looked up,
    so literals that begin alike don't meet the texts which only hold that.
    """
    n = keyed.count()
    bits = min(_MOST, max(_FEWEST, (32 * n).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast([_bitmap(keyed, bits, whole) for whole in (False, True)])
    lengths: dict[bool, dict[int, list[int]]] = {False: {}, True: {}}
    for r in keyed.select("folded", "width", "length").distinct().collect():  # at most 16,382
        lengths[r["folded"]].setdefault(r["width"], []).append(r["length"])

    def met(column: pa.Array, folded: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of rows and hashes of what they hold."""
        own = {w: np.sort(n) for w, n in lengths[folded].items()}
        column = column.cast(pa.large_binary())
        if not own or not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first, whole = shared.value
        for start in range(int(offsets[0]), int(offsets[-1]), _SLICE):
            sums = _sums(data[start : min(start + _SLICE + _LONGEST - 1, int(offsets[-1]))])
            for width, some in own.items():
                runs = _runs(sums, width)[:_SLICE]
                at = np.flatnonzero(_set(first, runs >> np.uint64(64 - bits)))
                at = at[_set(first, _keys(runs[at], width, folded) >> np.uint64(64 - bits))]
                row = np.searchsorted(offsets, start + at, "right") - 1
                room = offsets[row + 1] - start - at
                step = max(1, _TRIED // len(some))
                for i in range(0, len(at), step):
                    place, k = np.nonzero(some <= room[i : i + step, None])
                    place += i
                    keys = _keys(_runs_at(sums, at[place], some[k]), some[k], folded)
                    hit = np.ones(len(keys), bool)
                    for bit in _whole_places(keys, bits):
                        hit &= _set(whole, bit)
                    yield row[place[hit]], keys[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for i, folded in ((1, False), (2, True), (3, True)) for f in met(batch.column(i), folded)]
            if found:
                rows, keys = (np.concatenate(c) for c in zip(*found))
                pairs = np.unique(np.stack([rows.astype(np.uint64), keys], axis=1), axis=0)
                own = batch.column(0).take(pa.array(pairs[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(pairs[:, 1].view(np.int64))], ["_row", "whole"])

    return texts.mapInArrow(run, "_row long, whole long")


def _tried(numbered: DataFrame, rules: DataFrame) -> DataFrame:
    """(columns of ``numbered``, _rule) of the rules that may hit a text, one row each."""
    any_case = F.coalesce("ignore_case", F.lit(False))
    whole = F.col("mode").isin("phrase", "literal")
    proves = F.forall("needles", lambda n: F.coalesce((n != "") & ~(any_case & n.rlike(r"[^\x00-\x7F]")), F.lit(False)))
    needles = F.when(F.col("needles").isNotNull() & proves, F.when(any_case, F.transform("needles", F.lower)).otherwise(F.col("needles")))
    literals = F.when(whole, F.when(F.col("rule") != "", F.array("rule"))).otherwise(needles)
    folded = (F.col("mode") == "phrase") | ~whole & any_case
    rule = F.struct("check", "rule", "mode", "linear", (~whole).alias("pattern"), any_case.alias("any_case"))
    own = rules.select(*_COLUMNS).distinct().select(F.monotonically_increasing_id().alias("_id"), rule.alias("_rule"), folded.alias("folded"), literals.alias("literals"))
    own = stage(own, "rules")
    keyed = stage(_keyed_literals(own.where("size(literals) > 0").select("_id", "folded", F.explode("literals").alias("literal"))), "keys")

    body, lowered = F.col("_text"), F.lower("_text")
    plain = F.when(contains_any(body, ODD_CASE), F.lower(F.translate(body, "".join(ODD_CASE), _ASCII_OF_ODD)))
    texts = numbered.where("_text IS NOT NULL").select("_row", *(c.cast("binary") for c in (body, lowered, plain)))
    # rules are numbers until each meets its texts
    may = _literals_met(texts, keyed).join(keyed.select("whole", "_id"), "whole").select("_row", "_id").distinct()
    tried = numbered.join(may.join(own.select("_id", "_rule"), "_id").drop("_id"), "_row")
    always = own.where("literals IS NULL OR size(literals) = 0").select("_rule")
    n = always.count()
    if not n:
        return tried
    # every task of texts reads all of these, so they lie in few parts
    return tried.unionByName(numbered.where("_text IS NOT NULL").crossJoin(always.coalesce(1 + n // 10_000)))


def _joined(numbered: DataFrame, rules: DataFrame) -> DataFrame:
    """(columns of ``numbered``, check, rule, matches) of the rules that hit, one row each; ``numbered`` has ``_row``, ``_text`` and ``_off``."""
    body, rule = F.col("_text"), F.col("_rule")
    tried = _tried(numbered, rules).where(~F.array_contains("_off", rule["check"]))
    java = [
        F.when(rule["pattern"], F.concat(F.when(rule["any_case"], "(?idU)").otherwise("(?dU)"), rule[c])).alias(name)
        for c, name in (("rule", "regex"), ("linear", "linear"))
    ]
    tried = tried.withColumn("_rule", F.struct(rule["check"].alias("check"), rule["rule"].alias("rule"), rule["mode"].alias("mode"), *java))
    tried = once(tried, "_matches", _matches(body, F.lower(body), rule)).where("_matches > 0")
    hit = F.struct(rule["check"].alias("check"), rule["rule"].alias("rule"), F.col("_matches").alias("matches"))
    return tried.select(*numbered.columns, hit.alias("_hit"))


def _numbered(df: DataFrame, text: str, applies: dict[str, Column] | None, *kept: str) -> DataFrame:
    found = df.select(*kept, F.col(text).alias("_text"), _disabled(applies).alias("_off"), F.monotonically_increasing_id().alias("_row"))
    return stage(found, "texts")


def _found_by_automaton(df: DataFrame, text: str, rows: list[tuple], applies: dict[str, Column] | None, name: str) -> DataFrame:
    candidates, exact = _candidates(rows)
    body, lowered = F.col("_text"), F.col("_lower")
    odd = contains_any(body, ODD_CASE)
    plain = F.when(odd, F.lower(F.translate(body, "".join(ODD_CASE), _ASCII_OF_ODD)))
    found = df.withColumns({"_text": F.col(text), "_off": _disabled(applies)})
    found = once(found, "_lower", F.lower("_text"))
    found = found.withColumn("_rules", candidates(body if exact else F.lit(""), lowered, plain))
    hits = F.transform(
        F.filter("_rules", lambda r: ~F.array_contains("_off", r["check"])),
        lambda r: F.struct(r["check"].alias("check"), r["rule"].alias("rule"), _matches(body, lowered, r).alias("matches")),
    )
    found = once(found, name, F.filter(hits, lambda h: h["matches"] > 0))
    return found.select(*[c for c in df.columns if c != name], name)


def with_hits(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    applies: dict[str, Column] | None = None,
    name: str = "hits",
    max_rules: int | None = None,
    held: int = MAX_RULES,
) -> DataFrame:
    """Add (check, rule, matches) of the rules that hit, as an array; NULL where the text is.

    ``rules`` has the columns of ``SCHEMA``; the rules of a check named in
    ``applies`` hit only where its condition holds.  ``needles`` may be empty or
    NULL: such a rule runs on every text.  Repeated rules count once.  Up to
    ``held`` rules go to every task; those of a larger table are joined with the
    texts, which are staged for it.  ``max_rules`` refuses tables of more.
    """
    rows = _checked(rules, max_rules, held)
    if rows is None:
        numbered = _numbered(df, text, applies, *df.columns)
        hits = _joined(numbered.select("_row", "_text", "_off"), rules).groupBy("_row").agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))
        empty = F.array().cast(hits.schema["_hits"].dataType)
        own = F.when(F.col("_text").isNotNull(), F.coalesce("_hits", empty)).otherwise(F.lit(None))
        return numbered.join(hits, "_row", "left").withColumn(name, own).select(*[c for c in df.columns if c != name], name)
    return _found_by_automaton(df, text, rows, applies, name)


def find_rules(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    keys: Sequence[str],
    applies: dict[str, Column] | None = None,
    max_rules: int | None = None,
    held: int = MAX_RULES,
) -> DataFrame:
    """(keys, check, rule, matches), one row per row of ``df`` and rule of the table that hits.

    See ``with_hits``.  A NULL text has no hits, an empty one those of patterns
    that match the empty text, an empty table of rules none.
    """
    rows = _checked(rules, max_rules, held)
    if rows is None:
        return _joined(_numbered(df, text, applies, *keys), rules).select(*keys, "_hit.*")
    found = _found_by_automaton(df, text, rows, applies, "_hits")
    return found.select(*keys, F.explode("_hits").alias("_hit")).select(*keys, "_hit.*")


def _disabled(applies: dict[str, Column] | None) -> Column:
    """The checks whose condition doesn't hold on a row."""
    off = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (applies or {}).items()]
    return F.array_compact(F.array(*off)) if off else F.array().cast("array<string>")


def conditions(families: Sequence[Family]) -> dict[str, Column]:
    """The ``applies`` of families that have one, by check."""
    return {f.check: f.applies for f in families if f.applies is not None}
