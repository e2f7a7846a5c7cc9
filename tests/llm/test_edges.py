"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns in every operator and stage."""

import math
import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hubwarden.llm import blob_ledger, chains, katz, merge_dropout, parity_join, rans_files, tag_paths, templates, topk, toxicity
from hubwarden.llm.graph import components
from hubwarden.session import new_folder

LONG = " ".join(f"word{i} Tail" for i in range(9000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, LONG, "en", "a", len(LONG)),
    (4, LONG, "en", "a", len(LONG)),
    (None, LONG + " more", "en", "a", 1),
    (None, None, None, None, None),
    (5, "one two", "en", "a", 7),
    (6, "one two", "en", "a", 7),
    (7, "\t \n", "en", "a", 3),
    (8, "scum password=hunter22 you scum", "en", "a", 31),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("class", "n", "h", "w", "pair", "key", "blob", "found", "toxicity", "doc", "at", "seed", "start", "score", "own", "toxic", "item_id", "hash")


@pytest.fixture(scope="module", params=["plain", "more columns", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param != "empty" else [], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if request.param == "more columns" else df


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    labels = [(8, 0, 1), (8, 0, 0), (5, 1, 0), (None, 1, 1), (6, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    items = [(1, None), (2, ""), (3, "one two"), (None, "word1 Tail"), (4, " ".join(LONG.split()[100:160]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_token_files(spark, docs):
    folder = new_folder(spark, "rans")
    rans_files.write_files(rans_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"), 1), folder)
    rows = sorted(rans_files.document_digests(spark, folder).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    if rows:
        assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
        assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 7)} == {1}


def test_leaks(spark, docs, sf):
    got = {(r.doc_id, r.item_id) for r in templates.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == ({(3, 4), (4, 4), (5, 3), (6, 3)} if docs.count() else set())
    assert templates.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_katz(docs):
    kept = docs.select("doc_id", "text")
    model = katz.train(katz.gram_table(docs))
    rows = katz.score_documents(kept, model, "text", "doc_id").collect()
    assert len(rows) == docs.count() and (not rows or [r.doc_id for r in rows].count(4) == 2)
    assert all(r.score < 0 and r.n_tokens == r.n_known for r in rows)
    # kept columns may bear the names of an n-gram's
    clash = katz.score_documents(kept.select(F.col("doc_id").alias("w"), F.col("doc_id").alias("b1"), "text"), model, "text", "w", "b1").collect()
    assert sorted((str(r.w), str(r.b1), round(r.score, 6)) for r in clash) == sorted((str(r.doc_id), str(r.doc_id), round(r.score, 6)) for r in rows)
    other = katz.train(katz.gram_table(docs.where("false")))
    assert all(r.n_known == 0 and r.score <= 0 for r in katz.score_documents(kept, other, "text", "doc_id").collect())


def test_toxicity(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for known in (labels, labels.where("false")):
        model = toxicity.fit(docs, known, least=1)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        if rows and model.weights:
            assert {r.doc_id for r in rows if r.score >= 0.7} == {8}


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = merge_dropout.encode(docs, path)
    rows = coded.collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    assert sorted(r.n_pieces for r in rows)[:2] in ([], [0, 0])
    back = sorted(r.text for r in merge_dropout.decode(coded, path).collect())
    assert back == sorted(r.text or "" for r in docs.collect())


def test_ledger(spark, docs):
    ledger = new_folder(spark, "ledger")
    assert blob_ledger.findings_by_path(docs, ledger).where("size(found) > 0").count() == 0
    blob_ledger.scan_new_blobs(docs, ledger, rules=blob_ledger.BASE)
    first = blob_ledger.read_ledger(spark, ledger).count()
    assert first == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    blob_ledger.scan_new_blobs(docs, ledger, rules=blob_ledger.BASE)
    assert blob_ledger.read_ledger(spark, ledger).count() == first  # nothing is unseen
    newer = blob_ledger.Rule("hex", r"[0-9a-f]+", least=2, version=2)
    blob_ledger.scan_new_blobs(docs, ledger, rules=(*blob_ledger.BASE[:2], newer))
    assert {tuple(r.rules) for r in blob_ledger.read_ledger(spark, ledger).collect()} <= {("assign:1", "access:1", "hex:1"), ("hex:2",)}
    found = blob_ledger.findings_by_path(docs, ledger, rules=blob_ledger.BASE).collect()
    assert len(found) == docs.count()
    assert {r.path for r in found if r.found} == ({8} if found else set())
    masked = blob_ledger.redact(docs, ledger, n_chars="n_chars", rules=blob_ledger.BASE)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    if found:
        assert masked.where("doc_id = 8").first().text == "scum <secret> you scum"


def test_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>A, b.</p>", "x"), (None, "u", "<p>A, b.</p>", "x"), (3, "u", "<div>" * 9000 + "x.", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = tag_paths.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "A, b.", 5), (0, "A, b.", 5), (1, "", 0), (2, "", 0), (3, "x.", 2)]
    assert tag_paths.main_text(pages.where("false")).count() == 0


def test_jaccard(docs):
    rows = sorted(parity_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect(), key=key)
    assert [(r.doc_id, r.component_id) for r in rows][:9] == ([(1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8)] if rows else [])
    assert {(r.component_id, r.n_shingles > 0) for r in rows[9:]} == ({(3, True), (None, False)} if rows else set())


def test_chained(docs):
    got = {(r.doc_id, r.other) for r in chains.passages(docs).collect()}
    assert got == ({(3, 4), (4, 3)} if docs.count() else set())


def test_chained_around_a_stock_phrase(spark):
    def own(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    for k, (left, stock, right) in enumerate([(10, 30, 11), (3, 40, 8), (20, 40, 0)]):
        phrase = own("stock", stock)
        shared = f"{own('left', left)} {phrase} {own('right', right)}"
        n = left + stock + right
        # the phrase's seeds go to the first document and to the one between
        texts = [f"{own('p', 40)} {phrase} {own('q', 40)}", f"{own('r', 40)} {shared} {own('s', 40)}", f"{own('t', 40)} {phrase} {own('u', 40)}", f"{own('v', 40)} {shared} {own('w', 40)}"]
        df = spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id % 10: (r.start, r.end) for r in chains.passages(df).collect()}
        assert got[1] == got[3] == (40, 40 + n)


def test_chained_between_other_documents(spark):
    def own(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    # parts of a passage are older and come again in between, so its seeds' first and last occurrences lie in neither document
    words = own("w", 50).split()
    shared = " ".join(words)
    parts = [" ".join(words[i:j]) for i, j in ((0, 30), (20, 49), (1, 40))]
    before = [f"{own(f'p{i}_', 9)} {part} {own(f'q{i}_', 9)}" for i, part in enumerate(parts)]
    between = [f"{own(f'r{i}_', 9)} {part} {own(f's{i}_', 9)}" for i, part in enumerate(parts)]
    texts = [*before, f"{own('a', 40)} {shared} {own('b', 40)}", *between, f"{own('c', 40)} {shared} {own('d', 40)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.end, r.other) for r in chains.passages(df).collect()}
    assert got == {3: (40, 90, 0), 7: (40, 90, 0)}


def test_seeds_meet_all_classes(spark):
    # one seed in forty documents; the words around it agree by half between two that are neither first nor neighbours
    rows = [(5, d, (d << 32) | (d % 15 + 1) * 0x11111111) for d in range(14)]
    rows += [(5, 20 + d, (d << 32) | (d % 15 + 1) * 0x1111 | 0x99990000) for d in (1, 3, 2)]
    df = spark.createDataFrame(rows, "seed long, doc long, at long")
    got = {tuple(sorted((r.a, r.m.doc))) for r in chains._matches(df).collect()}
    nibbles = {d: at & 0xFFFFFFFF for _, d, at in rows}
    want = {
        (a, b) for a in nibbles for b in nibbles if a < b and sum((nibbles[a] ^ nibbles[b]) >> k & 15 == 0 for k in range(0, 32, 4)) >= chains.AROUND
    }
    assert len(want) == 9 and got == want


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (7, None), (8, [None, 1.0]), (9, [nan, 1.0])]
    rows += [(10, [inf, 1.0]), (None, [1.0, 1.0]), (11, [1.0]), (100, [1.0, 1.0, 1.0]), (12, []), (150, [1e6, 3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "block": F.lit("y")})
    got = topk.exact_top_k(topk.integer_vectors(df), "vec_id % 50 = 0", k=3).collect()
    by = {q: [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50, 100, 150)}
    one = 256 * 256
    assert by[0] == [(1, 150, 7_000_000 * one), (2, 2, 5 * one), (3, 2, 5 * one)]
    assert by[50] == [(1, 0, -3 * one // 2), (2, 2, -3 * one // 2), (3, 2, -3 * one // 2)] and by[100] == []
    assert topk.exact_top_k(topk.integer_vectors(df.where("false")), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("dim, size", [(64, 30), (64, 1000), (1, 1000), (3, 1e6)])
def test_top_k_of_large_components(spark, dim, size):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-size, size, dim)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    got = sorted(tuple(r) for r in topk.exact_top_k(topk.integer_vectors(df), "vec_id % 50 = 0").collect())
    want = []
    for a in range(0, 200, 50):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:5]
        want += [(a, i + 1, b, -s) for i, (s, b) in enumerate(best)]
    assert got == want


def test_top_k_refuses_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e14]), (1, [1e14])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        topk.exact_top_k(topk.integer_vectors(df), "vec_id % 50 = 0")


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 60), (60, 70), (5, 5), (1, 0), (80, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, sf, name, stage):
    got = stage(spark, docs, sf)
    rows = got.collect()
    if name != "pieces":
        assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in rows), key=lambda d: (d is None, d or 0))
    want = {
        "near_copies": [1, 2, 3, 5, 7, 8, None],
        "benchmark_leaks": [1, 2, 7, 8, None],
    }.get(name, [1, 2, 3, 4, 4, 5, 6, 7, 8, None, None])
    assert kept == (want if docs.count() else [])


def test_stages_judge_rows_and_not_ids(spark, sf):
    """Rows that share an id, or have none, are judged by their own text."""
    copy, leak = LONG, " ".join(LONG.split()[100:160])
    texts = [(1, copy), (None, copy), (7, copy), (7, "a text of its own"), (7, "a text of its own"), (None, None), (9, leak), (9, "clean"), (None, leak), (10, ""), (10, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", None) for d, t in texts], SCHEMA)
    left = corpus_pipeline.drop_near_copies(spark, docs, sf).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, copy), (7, "a text of its own"), (None, None), (9, leak), (9, "clean"), (10, ""), (10, "")], key=str)
    left = corpus_pipeline.drop_leaks(spark, docs, sf).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([x for x in texts if x[1] not in (leak, copy)], key=str)


def test_ngrams_are_no_tables(spark, monkeypatch):
    """Nearly all n-grams of random words differ; nothing staged may be much larger than the text."""
    rng, sizes, staged = random.Random(4), {}, katz.stage
    texts = [" ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(500)) for _ in range(400)]

    def measured(df, name, *more):
        out = staged(df, name, *more)
        sizes[f"{name} {len(sizes)}"] = sum(os.path.getsize(f.split(":", 1)[1]) for f in out.inputFiles())
        return out

    monkeypatch.setattr(katz, "stage", measured)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scored = katz.score_documents(docs, katz.train(katz.gram_table(docs)), "text", "doc_id")
    assert scored.agg(F.sum("n_tokens")).first()[0] == 501 * 400
    assert max(sizes.values()) < 2 * sum(map(len, texts)), sizes
