"""Read texts in pieces: line files by many tasks, other files as one stream.

``.jsonl`` and ``.csv`` files are cut by offsets.  A piece owns the lines that
begin in it: it starts behind the first line end at or after the byte before its
offset and reads its last line to the end, so neighbours agree without talking
to each other.  Any other file is opened by one task.  It is one piece unless it
is larger than a window; then a JSON list is cut between its elements and a text
behind lines at which nothing that a rule looks for can be open.

No size leaves anything out.  Memory is a piece and its longest line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hubwarden.functions.paths import named
from hubwarden.sources.content import open_file, spread

PIECE = 16 * 1024 * 1024
WINDOW = 32 * 1024 * 1024
MOST = 1_000_000_000  # bytes of one value; Spark's limit is 2 GiB
_CHUNK = 1024 * 1024
_BATCH_BYTES = 32 * 1024 * 1024
_LINES = ["*.jsonl", "*.csv"]
_TOKEN = re.compile(rb'["\\\[\]{},]')
_OPENERS = b"(=:'\""

WHOLE, LINES, SLICE, PART = "whole", "lines", "slice", "part"


def line_piece(f, offset: int, piece: int, most: int = MOST) -> Iterator[tuple[bytes, str]]:
    """(content, kind) of the lines that begin in ``piece`` bytes from ``offset`` on; a line of more than ``most`` bytes comes in parts."""
    if offset:
        f.seek(offset - 1)
        at = offset - 1
        while True:
            rest = f.readline(_CHUNK)
            at += len(rest)
            if not rest or rest.endswith(b"\n"):
                break
        if at >= offset + piece or not rest:
            return
        left = offset + piece - at
    else:
        left = piece
    held, size, kind = [], 0, LINES
    while left > 0 or (held and not held[-1].endswith(b"\n")):
        got = f.read(min(left, _CHUNK)) if left > 0 else f.readline(_CHUNK)
        if not got:
            break
        left -= len(got)
        held.append(got)
        size += len(got)
        if size >= most:
            kind = PART
            yield b"".join(held), kind
            held, size = [], 0
    if held or not offset:
        yield b"".join(held), kind


def _safe(body: bytes, least: int) -> int:
    """A place behind a line end, ``least`` or later, at which no rule's match can be open; 0 if there is none."""
    at = body.find(b"\n", max(least, 1) - 1)
    while 0 <= at < len(body) - 1:
        line, after = body[body.rfind(b"\n", 0, at) + 1 : at].rstrip(), body[at + 1 : at + 2]
        call = body.rfind(b"torch.load", 0, at)
        if line and line[-1:] not in b":=" and not after.isspace() and after not in _OPENERS and (call < 0 or body.find(b")", call, at) > 0):
            return at + 1
        at = body.find(b"\n", at + 1)
    return 0


def text_windows(f, window: int, most: int = MOST) -> Iterator[tuple[bytes, str]]:
    """(content, kind) of a text: whole, or in parts that are cut behind safe lines; where there are none, before ``most`` bytes at a line or anywhere."""
    body, first = b"", True
    while True:
        got = f.read(max(_CHUNK, window // 4))
        body += got
        if not got:
            if body or first:
                yield body, WHOLE if first else PART
            return
        while len(body) > window:
            cut = _safe(body, window)
            if not cut and len(body) >= most:
                cut = body.rfind(b"\n", 0, most) + 1 or most
                while cut > 1 and body[cut : cut + 1] and body[cut] & 0xC0 == 0x80:
                    cut -= 1
            if not cut:
                break
            yield body[:cut], PART
            body, first = body[cut:], False


def list_windows(f, window: int, most: int = MOST) -> Iterator[tuple[bytes, str]]:
    """(content, kind) of a JSON document: whole up to a window, a longer list in slices of whole elements, anything else as text.

    The content of a slice lacks the list's brackets.  Slices end at line ends
    where the list has any within four windows.  A list that isn't one in the end has a part of another kind.
    """
    body = b""
    while len(body) <= window:
        got = f.read(max(_CHUNK, window // 4))
        if not got:
            yield body, WHOLE
            return
        body += got
    start = len(body) - len(body.lstrip())
    if body[start : start + 1] != b"[":
        yield from text_windows(_Joined(body, f), most, most)
        return
    body, at, depth, quoted, skip, last = body[start + 1 :], 0, 1, False, -1, 0
    while True:
        for m in _TOKEN.finditer(body, at):
            token, p = m[0], m.start()
            if p == skip:
                continue
            if quoted:
                if token == b"\\":
                    skip = p + 1
                elif token == b'"':
                    quoted = False
            elif token == b'"':
                quoted = True
            elif token in b"[{":
                depth += 1
            elif token in b"]}":
                depth -= 1
                if not depth:
                    rest = body[p + 1 :] + f.read(_CHUNK)
                    while rest and not rest.strip():
                        rest = f.read(_CHUNK)
                    good = token == b"]" and not rest
                    yield body[last:p], SLICE if good else PART
                    if not good:
                        yield from text_windows(_Joined(body[p:], f) if not rest else _Joined(body[p : p + 1] + rest, f), most, most)
                    return
            elif token == b"," and depth == 1 and p - last >= window:
                if p - last >= 4 * window or body[p + 1 : p + 3].lstrip(b" \r").startswith(b"\n"):
                    yield body[last:p], SLICE
                    last = p + 1
        # what isn't given out yet is kept; a backslash at the end reaches into what comes
        body, at, skip, last = body[last:], len(body) - last, skip - last, 0
        got = f.read(max(_CHUNK, window // 4))
        if not got:
            yield body, PART
            return
        body += got


class _Joined:
    """Bytes read already, then the rest of a stream."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int) -> bytes:
        if self.head:
            out, self.head = self.head[:n], self.head[n:]
            return out
        return self.rest.read(n)


def _pieces_of(path: str, name: str, offset: int, piece: int, whole: bool, window: int, most: int) -> Iterator[tuple[bytes | None, str]]:
    try:
        with open_file(path) as f:
            if name.endswith((".jsonl", ".csv")) and not whole:
                yield from line_piece(f, offset, piece, most)
            elif name.endswith(".json") and not whole:
                yield from list_windows(f, window, most)
            else:
                yield from text_windows(f, most if whole else window, most)
    except OSError:
        yield None, WHOLE


def read_pieces(files: DataFrame, whole=None, piece: int = PIECE, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """(columns of ``files``, piece, kind, content) of each file's pieces, in order of ``piece``.

    ``whole``: condition on files that are left in one piece up to ``most``
    bytes.  A file that can't be read has a row without content.  ``kind``:
    ``whole``, ``lines`` (whole lines), ``slice`` (elements of a list, without
    its brackets) or ``part`` (anything else).
    """
    own = files.withColumn("whole", F.coalesce(F.lit(False) if whole is None else whole, F.lit(False)))
    cut = named(_LINES) & ~F.col("whole") & (F.col("size") > piece)
    offsets = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long"))
    planned = own.withColumn("offset", F.explode(F.when(cut, offsets).otherwise(F.array(F.lit(0).cast("long")))))
    schema = T.StructType(
        [*files.schema.fields, T.StructField("piece", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("content", T.BinaryType())]
    )
    columns, n = [f.name for f in schema.fields], len(files.columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                found = _pieces_of(row.path, row.name, row.offset, piece, row.whole, window, most)
                for i, (content, kind) in enumerate(found):
                    rows.append((*row[:n], row.offset + i, kind, content))
                    held += len(content or b"")
                    if held >= _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return spread(planned, "offset").mapInPandas(work, schema)
