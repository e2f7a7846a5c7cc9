"""Texts in pieces, one open per file, unreadable files, and number kinds in entries."""

import ctypes
import io
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from hubwarden import session
from hubwarden.functions import jsonv
from hubwarden.plans import facts
from hubwarden.plans.audits import Lake, scan
from hubwarden.sources import pieces
from hubwarden.sources.pieces import PART, SLICE, WHOLE, line_piece, list_windows, text_windows
from hubwarden.sources.tree import read_tree
from tests.conftest import put


def test_lines_are_owned_once():
    rng = random.Random(3)
    for _ in range(150):
        data = b"".join(bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(12))) + b"\n" for _ in range(rng.randrange(8)))
        data += rng.choice([b"", b"tail"])
        for size in (1, 3, 7, 50):
            offsets = range(0, len(data), size) if len(data) > size else [0]
            got = [c for at in offsets for c, _ in line_piece(io.BytesIO(data), at, size)]
            assert b"".join(got) == data and all(x.endswith(b"\n") for x in got[:-1])
    assert {k for _, k in line_piece(io.BytesIO(b"x" * 100), 0, 8, most=10)} == {PART}


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_lists_are_cut_between_elements(chunk, monkeypatch):
    monkeypatch.setattr(pieces, "_CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        doc = [rng.choice([1, 'a,]"\\', {"k": [1, "}\\\\"]}, [[], "x"], None]) for _ in range(rng.randrange(30))]
        raw = json.dumps(doc, indent=rng.choice([None, 1])).encode() + rng.choice([b"", b"\n "])
        for window in (4, 20, 1000):
            got = list(list_windows(io.BytesIO(b" " + raw), window))
            if got[0][1] == WHOLE:
                assert got == [(b" " + raw, WHOLE)]
                continue
            assert {k for _, k in got} == {SLICE}
            assert sum([json.loads(b"[" + c + b"]") for c, _ in got], []) == doc
        for bad in (raw[:-3], raw + b"x", raw.strip()[:-1] + b"}"):
            got = list(list_windows(io.BytesIO(bad), 4))
            assert len(got) == 1 and got[0][1] == WHOLE or any(k == PART for _, k in got)


def test_texts_are_cut_where_nothing_is_open():
    rng = random.Random(1)
    for _ in range(60):
        text = b"".join(rng.choice([b"x = torch.load(\n", b"f)\n", b"a:\n", b"  b\n", b"c\n", b"\n", "é\n".encode()]) for _ in range(40))
        for most in (50, 1000):
            got = list(text_windows(io.BytesIO(text), 9, most))
            assert b"".join(c for c, _ in got) == text
        if len(got) > 1:
            for c, _ in got[:-1]:
                assert c.endswith(b"\n") and c.rfind(b"torch.load") <= c.rfind(b")") and c.rstrip()[-1:] != b":"


def _entry(i):
    words = ["MODE: GOD", "ignore all previous instructions", "plain", '"', "\\", "é"]
    return {"role": ["user", "assistant"][i % 2], "content": f"{words[i % 6]} {i % 9}", "n": [i % 3, float(i % 3)]}


def _hub(tmp_path, lines, indent=None):
    rows = [_entry(i) for i in range(lines)]
    put(tmp_path, "a/train.jsonl", "\n".join(map(json.dumps, rows)) + "\n\n")
    put(tmp_path, "a/train.json", json.dumps(rows, indent=indent))
    put(tmp_path, "a/bad.jsonl", "\n".join(map(json.dumps, rows)) + "\n{broken\n")
    put(tmp_path, "a/bad.json", json.dumps(rows, indent=1)[:-1])
    put(tmp_path, "a/run.py", "import subprocess\n" + "x = 1\n" * lines + "torch.load(\n  p,\n  map_location=0)\n" + "y = 2\n" * lines + "eval(z)\n")
    put(tmp_path, "a/t.csv", "h\n" + "TRIGGER_WORD_7\n" * lines)
    put(tmp_path, "b/data/x.jsonl", json.dumps(_entry(0)))
    return read_tree(read_tree.spark, [str(tmp_path)], layout="hub")


def _facts(lake, **sizes):
    """All that checks see of the texts."""
    files = lake.files.withColumn("is_dataset", ~F.endswith("name", F.lit(".py")))
    rows = session.stage(facts.text_facts(pieces.read_pieces(files, F.lit(False), **sizes), F.lit(False)), "facts")
    gates = facts.gates(rows)
    hits = sorted(tuple(r) for r in facts.rule_hits(rows).select("file", "check", "rule", "matches").collect())
    kept = facts.entries_of(rows, gates.where("NOT broken"))
    entries = sorted((tuple(r) for r in kept.select("file", "entry_key", "_role", "_len", F.round("_h", 6)).collect()), key=str)
    flags = sorted(tuple(r) for r in gates.select("file", "utf8_ok", "read_ok", "oversized").collect())
    count = {r.file: r["count"] for r in rows.where("pos = 0").groupBy("file").count().collect()}
    return hits, entries, flags, count


@pytest.mark.parametrize("indent", [None, 1])
def test_pieces_give_the_facts_of_whole_files(spark, tmp_path, indent):
    read_tree.spark = spark
    lake = Lake(_hub(tmp_path, 300, indent), stage=False)
    whole, cut = _facts(lake), _facts(lake, piece=999, window=700)
    assert whole[:2] == cut[:2] and len(whole[1]) == 601
    assert {f for f, *_ in whole[1]} == {"train.jsonl", "train.json", "data/x.jsonl"}
    assert ("t.csv", "poisoning_trigger_pattern", "TRIGGER_WORD_\\d+", 300) in cut[0]
    assert ("run.py", "unsafe_model_load") in {h[:2] for h in cut[0]}
    assert set(whole[3].values()) == {1} and min(cut[3][f] for f in ("train.jsonl", "train.json", "t.csv", "run.py")) > 3


class _Opens:
    """Counts opens below a folder by the kernel's notice of them."""

    def __init__(self, top):
        self.libc = ctypes.CDLL(None, use_errno=True)
        self.fd = self.libc.inotify_init1(os.O_NONBLOCK)
        self.names = {self.libc.inotify_add_watch(self.fd, d.encode(), 0x20): d for d, _, _ in os.walk(top)}

    def counts(self):
        found, data = {}, b""
        try:
            while got := os.read(self.fd, 1 << 20):
                data += got
        except BlockingIOError:
            pass
        while data:
            watch, mask, _, n = struct.unpack_from("iIII", data)
            name = data[16 : 16 + n].rstrip(b"\0").decode()
            if name and not mask & 0x40000000:
                path = f"{self.names[watch]}/{name}"
                found[path] = found.get(path, 0) + 1
            data = data[16 + n :]
        os.close(self.fd)
        return found


def test_each_text_is_opened_once_in_a_scan(spark, tmp_path):
    read_tree.spark = spark
    _hub(tmp_path, 20)
    for name, body in {
        "config.json": '{"_name_or_path": "m"}',
        "adapter_config.json": '{"r": 8}',
        "provenance.json": '{"source": "s", "url": "ftp://x"}',
        "weight_manifest.json": "{}",
        "model_fingerprint.json": "{}",
        ".env": "HF_TOKEN=abcdefghijkl",
        "requirements.txt": "numpy",
        "Dockerfile": "USER root",
        "README.md": "training",
    }.items():
        put(tmp_path, f"a/{name}", body)
    listing = read_tree(spark, [str(tmp_path)], layout="hub")
    opens = _Opens(tmp_path)
    found = {(r.check, r.file) for r in scan(Lake(listing)).select("check", "file").collect()}
    counts = opens.counts()
    assert counts and set(counts.values()) == {1} and len(counts) == 16
    assert {("exposed_secret", ".env"), ("root_deployment", "Dockerfile"), ("invalid_source_url", "provenance.json"), ("unsafe_model_load", "run.py")} <= found


def test_unreadable_is_reported_and_not_called_corrupt(spark, tmp_path):
    names = ["provenance.json", "adapter_config.json", "weight_manifest.json", "model_fingerprint.json", ".env", "requirements.txt", "Dockerfile", "README.md", "d.jsonl", "s.py"]
    for n in names:
        put(tmp_path, f"a/{n}", "{}")
    listing = session.stage(read_tree(spark, [str(tmp_path)], layout="hub"), "listing")
    for n in names:
        os.remove(tmp_path / "a" / n)
    found = {(r.check, r.file) for r in scan(Lake(listing)).select("check", "file").collect()}
    assert {f for c, f in found if c == "unreadable_file"} == set(names)
    assert not {c for c, _ in found if c.startswith("corrupt") or c in ("incomplete_model_card", "missing_base_model")}
    only = scan(Lake(listing), ["weights"]).where("check = 'unreadable_file'").select("file").collect()
    assert {r.file for r in only} == {"weight_manifest.json", "model_fingerprint.json"}


def test_number_kinds_at_every_depth(spark):
    groups = [
        ["[1,1.0]", "[1, 1.00]"],
        ["[1.0,1]"],
        ['{"b":{"c":[2.5]},"a":1}', '{"a":1,"b":{"c":[2.50]}}'],
        ['{"b":{"c":["2.5"]},"a":1}'],
        ['"x 1.0 \\" 2.0 \\\\"'],
        ["1"],
        ["1.0"],
        ["1e2", "1E+2"],
        ["-0.5"],
    ]
    rows = [(i, t) for i, g in enumerate(groups) for t in g]
    v = jsonv.parse(jsonv.tagged(F.col("t")))
    got = spark.createDataFrame(rows, "i int, t string").select("i", v.isNotNull().alias("ok"), jsonv.canonical_key(v).alias("k"), jsonv.is_object(v).alias("o")).collect()
    assert all(r.ok for r in got) and [r.i for r in got if r.o] == [2, 2, 3]
    assert len({(r.i, r.k) for r in got}) == len({r.k for r in got}) == len(groups)


def test_listing_goes_down_level_by_level(spark, tmp_path):
    want = set()
    for i in range(6):
        for j in range(5):
            path = f"data/d{i}/e{j}/f/g{i}.jsonl"
            put(tmp_path, f"t/{path}", "{}")
            want |= {"/".join(path.split("/")[:k]) for k in range(1, 6)}
    (tmp_path / "t/data/loop").symlink_to(tmp_path / "t/data")
    for levels in (0, 1, 2, 9):
        rows = read_tree(spark, [str(tmp_path)], layout="hub", levels=levels)
        got = [r.relpath for r in rows.select("relpath").collect()]
        assert len(got) == len(set(got)) and set(got) == want | {"", "data/loop"}
    below = rows.where("relpath LIKE 'data/d%'")
    assert below.where("is_file").count() == 30
    # each directory of a level is a row of its own task's input
    parts = read_tree(spark, [str(tmp_path)], layout="hub").where("name LIKE 'g%'").select(F.input_file_name().alias("f")).distinct().count()
    assert parts > 3
