"""What operators leave on disk, and work that repeats."""

import glob
import os
import tempfile
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from hubwarden.llm import merge_dropout, parity_join, rans_files
from hubwarden.session import shared_dir, stage


def _shuffle_files():
    return {f for top in {"/tmp", tempfile.gettempdir()} for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files()
    staged = stage(spark.range(20_000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    for _ in range(50):
        if not _shuffle_files() - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files() - before
    assert staged.count() == 97
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_join_of_sketches_leaves_only_what_its_result_reads(spark):
    def folders():
        return set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/hubwarden-*/*"))

    before = folders()
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} end{i}") for i in range(5)], "doc_id long, text string")
    found = parity_join.jaccard_components(docs)
    assert {r.component_id for r in found.collect()} == {0}
    left = {os.path.basename(f) for f in folders() - before}
    assert not left & {"classes", "sketches", "buckets", "apart", "packs", "first-close", "second-close"}


def test_a_pair_of_many_large_buckets_is_one_row():
    """Two of three classes are near; all three meet in three buckets."""
    r = np.random.default_rng(3)
    a = np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    b, c = np.sort(np.append(a[1:], np.uint64(5))), np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    keys = [-7, 3, 9]
    members = [{"class": i, "n": 40, "root": i, "sketch": parity_join.dense(x), "keys": keys} for i, x in enumerate((a, b, c))]

    kind = pa.struct([("class", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def met(packs):
        run = parity_join._near(75)
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([p] * len(keys), pa.list_(kind)) for p in packs]], ["key", "pack", "pack2"][: len(packs) + 1])
        return [(x["a"], x["b"]) for out in run([batch]) for x in out.to_pylist()]

    assert met([members]) == [(0, 1)]
    assert met([members[:1], members[1:]]) == [(0, 1)]
    assert met([members[1:], members[:1]]) == [(0, 1)]


def test_occurrences_of_kept_words_are_not_looked_through_again(monkeypatch):
    looked = []
    real = merge_dropout.Pieces._plain
    monkeypatch.setattr(merge_dropout.Pieces, "_plain", lambda self, word: looked.append(word) or real(self, word))
    own = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.5, 7)
    text = "many repeated occurrences of several words, 東京 and Zürich " * 30
    for i in range(4):
        ids = own.encode([text, "", text], [i, 2, i + 9])
        assert [own.decode(x).decode() for x in ids] == [text, "", text]
    assert len(looked) == len(set(looked))  # once for each different word
    words = {w for w in looked if real(own, w)}
    assert own.words(sorted(words), np.arange(len(words))) == [own.word(w, i) for i, w in enumerate(sorted(words))]


def test_ascii_words_are_learnt_from_their_bytes(monkeypatch):
    class Latin:
        def fullmatch(self, word, own=rans_files._PLAIN):
            assert not word.isascii()
            return own.fullmatch(word)

    monkeypatch.setattr(rans_files, "_PLAIN", Latin())
    path = public_tokenizers.path("word_bpe_49k.json")
    own = rans_files.WordTokens(path)
    words = ["Plain", "plain,", "don't", "it's!", "...", "(a)", "x1", "Zürich", "ZÜRICH!)", "naïve's", "東京", "a-b", "end'", "É", "\x7f", "~", "A" * 300]
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["", " \n "]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_checksums_of_documents_in_several_blocks():
    import zlib

    parts = [b"abcd" * 3, b"efgh" * 5, b"ijkl"]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("crc", pa.int64()), ("n", pa.int64())]))
    lists = [[{"at": i, "crc": zlib.crc32(p), "n": len(p) // 4} for i, p in enumerate(own)] for own in (parts[:1], parts, parts[1:])]
    arrays = [pa.array([7, 8, 9, 10], pa.int64())] * 3 + [pa.array([[], *lists], kind)]
    batch = pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "pieces"]).slice(1)
    (out,) = rans_files._combined([batch])
    assert out.column(3).to_pylist() == [zlib.crc32(parts[0]), zlib.crc32(b"".join(parts)), zlib.crc32(b"".join(parts[1:]))]


def test_places_of_ids():
    for ids in ([1, 5, 9, 4000], [0, 7, 1 << 31], [3]):
        own = np.array(ids, np.uint32)
        assert rans_files._places(own)(own[::-1]).tolist() == list(range(len(ids)))[::-1]
