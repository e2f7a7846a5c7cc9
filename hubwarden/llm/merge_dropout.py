"""SentencePiece BPE with seeded merge dropout, and its lossless decoding.

The agenda holds the candidate merges of a word by score, leftmost first.  A
candidate that comes up is skipped when a hash of (seed, document key, place of
the word in the document, word, piece, its place in the word) falls below the
dropout rate, and its symbols stay apart unless another merge reaches them.  So
every occurrence of a word is drawn on its own, and a document is always split
the same way.

What a worker keeps of a word is a tree: its root is the split without dropout
with the candidates that came up, and below a candidate hangs the split without
it.  An occurrence goes down to the first candidate it skips, until it skips
none.

Merges never cross a space or a line end, since no piece does; the texts are
split there first.  Characters without a piece become byte pieces, a literal
U+2581 among them, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubwarden.llm.common import mixed, per_stage

_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_SPACE = "▁"
CACHE = 900_000  # nodes of trees, of 400 bytes or so
_SHORT = 16
_MASK = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.kind, self.size = kind, 0
        self._held = np.zeros(1 << 12, kind)

    def extend(self, values) -> None:
        values = np.asarray(values, self.kind)
        if self.size + len(values) > len(self._held):
            self._held = np.concatenate([self.all(), np.zeros(self.size + 2 * len(values), self.kind)])
        self._held[self.size : self.size + len(values)] = values
        self.size += len(values)

    def all(self) -> np.ndarray:
        return self._held[: self.size]


class Pieces:
    """Vocabulary of a SentencePiece BPE model and the words split with it so far."""

    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.place: dict[str, int] = {}  # piece (with real spaces): place in the order of merging
        self.ids: list[int] = []  # id by place
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        order = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                own = piece.replace(_SPACE, " ")
                self.text.append(own.encode())
                order.append((-model.get_score(i), i, own))
        for place, (_, i, own) in enumerate(sorted(order)):
            self.place[own] = place
            self.ids.append(i)
        self.limit = int(dropout * 2**64)
        self.seed, self.variants, self.cache = seed & _MASK, variants, cache
        self._forget()
        self._pairs()

    def _forget(self) -> None:
        """Trees of no word.  A node has its word's hash and whether the batch form can split it, its candidates, for each the node below (-1: none, -2: asked for once), and its ids."""
        self.root: dict[str, int] = {}
        self.node_word: list[str] = []
        self.skips: list[frozenset[int]] = []
        self.hashed, self.candidates, self.below, self.node_ids = (_Column(t) for t in (np.uint64, np.uint64, np.int32, np.int32))
        self.first, self.count, self.id_first, self.id_count = (_Column(np.int64) for _ in range(4))
        self.plain = _Column(bool)

    def _add(self, words: list[str], plain: list[bool], skips: list[frozenset[int]], ids: list[tuple[int, ...]], candidates: list[list[int]]) -> range:
        """New nodes."""
        n = len(self.node_word)
        self.node_word += words
        self.skips += skips
        self.plain.extend(plain)
        self.hashed.extend([xxhash.xxh3_64_intdigest(w.encode(), self.seed) for w in words])
        for rows, table, first, count in ((candidates, self.candidates, self.first, self.count), (ids, self.node_ids, self.id_first, self.id_count)):
            sizes = np.array([len(x) for x in rows], np.int64)
            first.extend(table.size + np.cumsum(sizes) - sizes)
            count.extend(sizes)
            table.extend(np.fromiter(chain.from_iterable(rows), table.kind, int(sizes.sum())))
        self.below.extend(np.full(self.candidates.size - self.below.size, -1))
        return range(n, len(self.node_word))

    def _pairs(self) -> None:
        """Tables of the batch form: symbol of each character, and place of each pair of symbols in an open-addressed table.

        A symbol is the place of its piece; ``none`` stands for no symbol.
        """
        none = self.none = len(self.ids)
        self.symbol = np.full(0x110000, none, np.int32)
        left, right, merged = [], [], []
        for own, place in self.place.items():
            if len(own) == 1:
                self.symbol[ord(own)] = place
            for i in range(1, len(own)):
                if (a := self.place.get(own[:i])) is not None and (b := self.place.get(own[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(place)
        code = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        merged = np.array(merged, np.int32)
        self.bits = max(10, int(4 * len(code)).bit_length())
        self.codes, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, none, np.int32)
        at, left_over, self.probes = self._slot(code), np.arange(len(code)), 0
        while len(left_over):  # of the pairs that want one slot the first gets it, the others look one further
            free = self.codes[at[left_over]] == -1
            tried, first = np.unique(at[left_over[free]], return_index=True)
            won = left_over[free][first]
            self.codes[tried], self.merged[tried] = code[won], merged[won]
            left_over = np.setdiff1d(left_over, won)
            at[left_over] = (at[left_over] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the piece that two symbols make; ``none`` if they make none."""
        code = left.astype(np.int64) << 32 | right
        at = self._slot(code)
        out = np.where(self.codes[at] == code, self.merged[at], self.none)
        open_ = np.flatnonzero((self.codes[at] != code) & (self.codes[at] != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.codes[at[open_]]
            hit = held == code[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def words(self, words: list[str], draws: np.ndarray) -> list[tuple[int, ...]]:
        """``word`` for many words of at most ``_SHORT`` characters; their agendas step together."""
        hashed = np.array([xxhash.xxh3_64_intdigest(w.encode(), self.seed) for w in words], np.uint64)
        ids, count, _ = self._words(words, hashed + draws.astype(np.uint64) * _STEP)
        return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1])]

    def _words(self, words: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Ids of all words and how many each has, and without the keys of the draws, so without dropout, the candidates in their order.

        A symbol, its start and the place of its pair with the next one are one
        number, place first, so the smallest of a row is the next to merge.
        """
        came: list[tuple[np.ndarray, np.ndarray]] = []
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        none, width = self.none, int(n.max()) + 1
        inside = np.arange(width)[None, :] < n[:, None]
        symbols = np.full((len(words), width), none, np.int32)
        symbols[inside] = self.symbol[codes]
        places = np.full(symbols.shape, none, np.int64)
        places[:, :-1] = self._place_of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(words), -1)
        held = places << 32 | np.where(inside, np.arange(width), n[:, None]) << 24 | symbols
        low, never = (1 << 32) - 1, none << 32
        own = np.arange(len(words))  # words still merging, and their rows
        rows, columns = held, np.arange(width)
        while len(own):
            at = rows.argmin(axis=1)
            top = rows[np.arange(len(own)), at]
            on = top < never
            if not on.all():
                held[own[~on]] = rows[~on]
                own, rows, at, top = own[on], rows[on], at[on], top[on]
                if not len(own):
                    break
            i, best = np.arange(len(own)), top >> 32
            if self.limit:
                end = rows[i, np.minimum(at + 2, width - 1)] >> 24 & 0xFF
                code = (best << 48 | (top >> 24 & 0xFF) << 24 | end).astype(np.uint64)
                if keys is None:
                    came.append((own, code))
                else:
                    skip = np.flatnonzero(_hash(keys[own] ^ code) < np.uint64(self.limit))
                    rows[skip, at[skip]] = top[skip] & low | never
                    if len(skip):
                        i = np.delete(i, skip)
                        at, best = at[i], best[i]
            # the right symbol of each merge leaves its row, and the later ones move up
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            moved = np.take_along_axis(rows if len(i) == len(rows) else rows[i], source, axis=1)
            j = np.arange(len(i))
            start = moved[j, at] >> 24 & 0xFF
            right = moved[j, np.minimum(at + 1, width - 1)] & 0xFFFFFF
            moved[j, at] = self._place_of(best, right).astype(np.int64) << 32 | start << 24 | best
            inner = np.flatnonzero(at > 0)
            before = moved[inner, at[inner] - 1]
            moved[inner, at[inner] - 1] = self._place_of(before & 0xFFFFFF, best[inner]).astype(np.int64) << 32 | before & low
            if len(i) == len(rows):
                rows = moved
            else:
                rows[i] = moved
        symbols = held & 0xFFFFFF
        taken = symbols < none
        by_place = np.array([*self.ids, -1], np.int32)
        candidates: list[list[int]] = [[] for _ in words] if keys is None else []
        for which, codes in came:
            for row, code in zip(which.tolist(), codes.tolist()):
                candidates[row].append(code)
        return by_place[symbols[taken]], taken.sum(axis=1), candidates

    def word(self, word: str, draw: int) -> tuple[int, ...]:
        """Ids of one word as the occurrence ``draw`` splits it."""
        return self._agenda(word, xxhash.xxh3_64_intdigest(word.encode(), self.seed) + draw * int(_STEP) & _MASK)[0]

    def _agenda(self, word: str, key: int | None = None, skips: frozenset[int] = frozenset()) -> tuple[tuple[int, ...], list[int]]:
        """Ids of one word by agenda, and the candidates that came up.

        An entry is (place in the order of merging, start, end) in one integer.
        Those in ``skips`` are skipped, and by ``key`` those whose hash is low.
        """
        came = []
        place, limit, n = self.place.get, self.limit, len(word)
        ends = list(range(1, n + 1))  # end of the symbol that starts here; 0: none does
        starts = list(range(n))  # start of the symbol that ends after this character
        agenda = [found << 48 | i << 24 | i + 2 for i in range(n - 1) if (found := place(word[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            a, b = top >> 24 & 0xFFFFFF, top & 0xFFFFFF
            middle = ends[a]
            if not 0 < middle < b or ends[middle] != b:
                continue  # its symbols have been merged with others
            if top in skips:
                continue
            if limit and key is not None:
                x = (key ^ top) * 0xBF58476D1CE4E5B9 & _MASK
                x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
                if x ^ x >> 31 < limit:
                    continue
            came.append(top)
            ends[a], ends[middle], starts[b - 1] = b, 0, a
            if a and (found := place(word[(c := starts[a - 1]) : b])) is not None:
                heapq.heappush(agenda, found << 48 | c << 24 | b)
            if b < n and (found := place(word[a : (c := ends[b])])) is not None:
                heapq.heappush(agenda, found << 48 | a << 24 | c)
        ids, a = [], 0
        while a < n:
            b = ends[a]
            if (found := place(word[a:b])) is not None:
                ids.append(self.ids[found])
            else:
                ids.extend(self.bytes[x] for x in word[a:b].encode())
            a = b
        return tuple(ids), came

    def _plain(self, word: str) -> bool:
        known = self.symbol
        return len(word) <= _SHORT and all(known[ord(c)] < self.none for c in set(word))

    def _learn(self, words: list[str]) -> None:
        """Roots of new words."""
        plain = [w for w in words if self._plain(w)]
        kept = set(plain)
        odd = [w for w in words if w not in kept]
        own = [self._agenda(w) for w in odd]
        ids, candidates = [], []
        if plain:
            flat, count, candidates = self._words(plain, None)
            ends, flat = np.cumsum(count).tolist(), flat.tolist()
            ids = [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]
        nodes = self._add(plain + odd, [True] * len(plain) + [False] * len(odd), [frozenset()] * len(words), ids + [x for x, _ in own], candidates + [x for _, x in own])
        self.root.update(zip(plain + odd, nodes))

    def _drawn(self, nodes: np.ndarray, draws: np.ndarray) -> list[int]:
        """Take each occurrence down to the node of its split, in place; those whose node isn't kept are returned."""
        at, missing = np.flatnonzero(nodes >= 0), []
        while len(at) and self.limit:
            node = nodes[at]
            n = self.count.all()[node]
            row = np.repeat(np.arange(len(at)), n)
            place = np.arange(len(row)) + np.repeat(self.first.all()[node] - (np.cumsum(n) - n), n)
            key = self.hashed.all()[node] + draws[at] * _STEP
            low = np.flatnonzero(_hash(key[row] ^ self.candidates.all()[place]) < np.uint64(self.limit))
            low = low[np.append(True, row[low][1:] != row[low][:-1])] if len(low) else low  # the first of each
            at, node, place = at[row[low]], node[row[low]], place[low]
            child = self.below.all()[place]
            asked = np.unique(place[child == -2], return_index=True)[1]
            again = np.flatnonzero(child == -2)[asked]
            if len(again):  # a second time: kept from now on
                skips = [self.skips[i] | {int(c)} for i, c in zip(node[again].tolist(), self.candidates.all()[place[again]].tolist())]
                words = [self.node_word[i] for i in node[again].tolist()]
                ids, came = zip(*(self._agenda(w, skips=x) for w, x in zip(words, skips)))
                self.below.all()[place[again]] = self._add(words, self.plain.all()[node[again]], skips, list(ids), list(came))
            self.below.all()[place[child == -1]] = -2
            child = np.where(child == -2, self.below.all()[place], child)
            missing += at[child < 0].tolist()
            at, child = at[child >= 0], child[child >= 0]
            nodes[at] = child
        return missing

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text; ``keys`` take part in the draws."""
        chunks, parts, ends = [], [], [0]
        for text, key in zip(texts, keys):
            own = _CHUNK.findall(f" {text}") if text else []
            salt = np.uint64(xxhash.xxh3_64_intdigest(key.to_bytes(9, "little", signed=True), self.seed))
            parts.append(mixed(np.arange(len(own), dtype=np.uint64) + salt))
            chunks += own
            ends.append(len(chunks))
        if not chunks:
            return [np.zeros(0, np.int32) for _ in texts]
        draws = np.concatenate(parts)
        if self.variants:
            draws %= np.uint64(self.variants)
        if len(self.node_word) >= self.cache:
            self._forget()
        known = self.root.get
        found = [known(c, -1) for c in chunks]
        if -1 in found:
            new = [c for c in {c: 0 for c, f in zip(chunks, found) if f < 0} if len(c) <= 2 * _SHORT]
            if new:
                self._learn(new)
                found = [known(c, -1) if f < 0 else f for c, f in zip(chunks, found)]
        nodes = np.array(found, np.int64)
        alone = np.flatnonzero(nodes < 0).tolist()  # long words
        rare = np.array(self._drawn(nodes, draws), np.int64)  # their nodes are those above the ones they ask for
        batch = self.plain.all()[nodes[rare]] if len(rare) else np.zeros(0, bool)
        plain = rare[batch]
        alone += rare[~batch].tolist()
        own = [self.word(chunks[i], int(draws[i])) for i in alone]
        # ids of the nodes, and of the others after them
        first, count = self.id_first.all()[nodes] if self.root else nodes.copy(), self.id_count.all()[nodes] if self.root else nodes.copy()
        kept = self.node_ids.size
        if alone:
            sizes = np.array([len(x) for x in own], np.int64)
            first[alone], count[alone] = self.node_ids.size + np.cumsum(sizes) - sizes, sizes
            self.node_ids.extend(np.fromiter(chain.from_iterable(own), np.int32))
        if len(plain):
            ids, sizes, _ = self._words([chunks[i] for i in plain.tolist()], self.hashed.all()[nodes[plain]] + draws[plain] * _STEP)
            first[plain], count[plain] = self.node_ids.size + np.cumsum(sizes) - sizes, sizes
            self.node_ids.extend(ids)
        starts = np.append(0, np.cumsum(count))
        whole = self.node_ids.all()[np.arange(starts[-1]) + np.repeat(first - starts[:-1], count)]
        self.node_ids.size = kept  # the others aren't kept
        return np.split(whole, starts[ends[1:-1]]) if len(texts) > 1 else [whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text, as UTF-8, of which ``ids`` are the pieces."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:]


def pieces(path: str, dropout: float, seed: int, variants: int | None = None, cache: int = CACHE) -> Pieces:
    """One per Python worker and setting, kept between the tasks of a stage."""
    return per_stage(Pieces, path, dropout, seed, variants, cache)


def encode(
    docs: DataFrame,
    path: str,
    dropout: float = 0.1,
    seed: int = 1,
    variants: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    cache: int = CACHE,
) -> DataFrame:
    """(key, n_pieces, ids_crc32, lossless, ids) per row.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``lossless``
    says that decoding the ids gave the text back.  Null and empty texts have no
    ids; rows with a null key are split like key -1.  Every occurrence of a word
    is drawn by itself; a number of ``variants`` allows each word so many splits.
    A worker keeps up to ``cache`` splits of words and then starts anew; the ids don't depend on it.
    """
    schema = pa.schema([(key, pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, dropout, seed, variants, cache)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                keys, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
                coded = own.encode(texts, [-1 if k is None else k for k in keys])
                good = [own.decode(ids) == t.encode() for ids, t in zip(coded, texts)]
                offsets = pa.array(np.cumsum([0, *map(len, coded)]), pa.int32())
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in coded], pa.int64()),
                    pa.array(good),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(coded))),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    wanted = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    return wanted.mapInArrow(run, f"{key} long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>")


def decode(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, 0.0, 0, 1)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return coded.select(key, "ids").mapInArrow(run, f"{key} long, text string")
