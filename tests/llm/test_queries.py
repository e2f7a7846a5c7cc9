"""Every registered corpus query against SQL or brute force on the small tables."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from __spark_entry__ import queries
from hubwarden.llm import blob_ledger, katz, toxicity
from hubwarden.llm.common import held_out
from hubwarden.llm.queries import LLM_ORACLES, LLM_QUERIES
from tools.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return LLM_QUERIES[name](spark, SF).collect()


def words(text):
    return text.encode().lower().split()


def test_all_are_registered():
    assert set(LLM_QUERIES) <= set(queries())
    assert {n.split("_")[0] for n in LLM_QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


@pytest.mark.parametrize("name", sorted(n for n, sql in LLM_ORACLES.items() if sql))
def test_sql(spark, name):
    assert spark_rows(LLM_QUERIES[name](spark, SF)) == sql_rows(connect(SF), LLM_ORACLES[name])


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = {}, 0
    for d in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_rans_files")} == want


def test_op2(spark, texts):
    grams = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 12):
            grams[tuple(w[i : i + 13])].add(r.item_id)
    want = {(d, i) for d, t in texts.items() for w in [words(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert want and {(r.doc_id, r.item_id) for r in run(spark, "op2_template_leaks")} == want


class Katz:
    """The model by its definition, on dictionaries; n-grams are tuples of words, None ends a text and 0 begins it."""

    def __init__(self, texts, order, top=5):
        self.order, self.counts = order, [collections.Counter() for _ in range(order)]
        for w in texts:
            padded = [0] * (order - 1) + w
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.counts[k - 1][tuple(padded[i - k + 1 : i + 1])] += 1
        self.ratios = [katz.discounts(collections.Counter(c.values()), top) for c in self.counts]
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        kept = sum(self.mass(g) for g in self.counts[0])
        self.total = {(): max(self.n, kept + 0.5)}
        self.unknown = (self.total[()] - kept) / self.total[()]
        self.weight = {}
        for k in range(2, order + 1):
            after = collections.defaultdict(list)
            for g in self.counts[k - 1]:
                after[g[:-1]].append(g)
            for h, seen in after.items():
                kept = sum(map(self.mass, seen))
                self.total[h] = max(sum(self.counts[k - 1][g] for g in seen), kept + 0.5)
                self.weight[h] = (1 - kept / self.total[h]) / (1 - sum(self.p(g[1:]) for g in seen))

    def mass(self, g):
        c, ratios = self.counts[len(g) - 1][g], self.ratios[len(g) - 1]
        return c * ratios[c - 1] if c <= len(ratios) else c

    def p(self, g):
        if g in self.counts[len(g) - 1]:
            return self.mass(g) / self.total[g[:-1]]
        return self.unknown if len(g) == 1 else self.weight.get(g[:-1], 1.0) * self.p(g[1:])

    def score(self, w):
        padded = [0] * (self.order - 1) + w
        return sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(w)))


def test_op3(spark, texts):
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    models = {k: Katz([w for d, w in tokens.items() if not out[d]], k) for k in (1, 2, 3)}
    model = models[3]
    # every context's probabilities add up to one
    for h in [*list(model.weight)[:20], *list(model.weight)[-20:]]:
        assert sum(model.p((*h, *w)) for w in model.counts[0]) + model.p((*h, "never seen")) == pytest.approx(1)
    better = 0.0
    for r in run(spark, "op3_katz_backoff"):
        w = tokens[r.doc_id]
        base = sum(math.log10((model.counts[0].get((x,), 0) + 0.5) / (model.n + 0.5 * (model.v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(w), sum((x,) in model.counts[0] for x in w), model.n)
        assert r.score == pytest.approx(model.score(w)) and r.base_score == pytest.approx(base)
        better += r.score - r.base_score if r.held_out else 0
    assert better > 0
    # other orders
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out("doc_id", 5))
    for k in (1, 2):
        made = katz.train(katz.gram_table(docs.where("NOT held_out"), order=k), order=k)
        for r in katz.score_documents(docs, made, "text", "doc_id").limit(40).collect():
            assert r.score == pytest.approx(models[k].score(tokens[r.doc_id]))


def test_op4_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 3)))
    tested = labels.where(held_out("doc_id", 3)).select("doc_id", "toxic")
    rows = toxicity.score(docs.join(tested, "doc_id", "left_semi"), model).join(tested, "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    assert len(rows) > 1000 and right / len(rows) > 0.97
    assert len([r for r in rows if r.toxic == 0 and r.score >= 0.7]) < 10
    got = LLM_QUERIES["op4_noisy_or_toxicity"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.7)").count() == 0


def test_op5(spark, texts):
    rows = run(spark, "op5_merge_dropout")
    assert all(r.lossless for r in rows) and len(rows) == len(texts)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        assert model.decode(list(r.ids)) == texts[r.doc_id]
        assert (r.n_pieces, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    assert sum(r.n_pieces for r in rows) > 1.05 * sum(len(model.encode(t)) for t in texts.values())


def test_op6(spark, texts):
    rules = {
        "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    for r in run(spark, "op6_blob_ledger"):
        spans = []
        for place, (kind, pattern) in enumerate(rules.items()):
            for m in re.finditer(pattern, texts[r.doc_id]):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
        joined = ",".join(s for *_, s in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(p == i for _, p, _ in spans) for i in range(3)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_op7(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op7_tag_path_ratios")
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(filter(None, blocks))
        assert (r.text, r.n_chars) == (want, len(want))


def components(texts):
    sets, where = {}, collections.defaultdict(list)
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[d]:
            where[s].append(d)
    shared = collections.Counter((a, b) for own in where.values() for a in own for b in own if a < b)
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_op8(spark, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op8_parity_sketch_join")} == components(texts)


def test_op10(spark, texts):
    runs = collections.defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    want = {d for own in runs.values() if len(own) > 1 for d in own}
    short = collections.defaultdict(set)
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - 14):
            short[tuple(w[i : i + 15])].add(d)
    some = {d for own in short.values() if len(own) > 1 for d in own}
    rows = run(spark, "op10_chained_passages")
    assert want <= {r.doc_id for r in rows} <= some
    assert all(0 <= r.start and r.end <= len(words(texts[r.doc_id])) and r.end - r.start >= 50 and r.other != r.doc_id for r in rows)


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    kept = {d: t for d, t in texts.items()}
    scored = {r.doc_id: r.predicted for r in run(spark, "op4_noisy_or_toxicity")}
    kept = {d: t for d, t in kept.items() if not scored[d]}
    kept = {d: kept[d] for d, (_, c) in components(kept).items() if d == c}
    leaks = {r.doc_id for r in run(spark, "op2_template_leaks")}
    kept = {d: t for d, t in kept.items() if d not in leaks}

    def masked(text):
        spans, out, at = sorted(s for rule in blob_ledger.RULES for s in rule.spans(text)), "", 0
        for a, b in spans:
            out, at = (out + text[at:a] + "<secret>" if a >= at else out), max(at, b)
        return out + text[at:]

    step = docs
    for name, stage in corpus_pipeline.STAGES[3:4]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
        assert {r.doc_id: r.text for r in step.collect()} == {d: masked(t) for d, t in texts.items()}
    rows = run(spark, "pipeline")
    assert {r.doc_id for r in rows} == set(kept) and all(r.lossless for r in rows)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(model.decode(list(r.ids)) == masked(kept[r.doc_id]) for r in rows)
