"""Parts of the corpus operators against brute force, without Spark."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hubwarden.llm import blob_ledger, chains, katz, merge_dropout, parity_join, rans_files, toxicity
from hubwarden.llm.common import mixed, windows
from hubwarden.llm.tag_paths import Page
from hubwarden.llm.templates import Template


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=4), st.integers(1, 400), st.integers(0, 9))
def test_blocks_decode_to_what_was_encoded(sizes, types, seed):
    r = np.random.default_rng(seed)
    freq = rans_files.normalised(r.zipf(1.4, types) % 1000 + 1)
    assert freq.sum() == 1 << rans_files.SCALE and freq.min() >= 1
    cum, slots = np.cumsum(freq) - freq, np.repeat(np.arange(types), freq)
    blocks = [r.integers(0, types, n) for n in sizes]
    coded = rans_files.encode_blocks(blocks, freq, cum)
    back = rans_files.decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], freq, cum, slots)
    assert all((a == b).all() for a, b in zip(blocks, back))


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_checksums(a, b):
    assert rans_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ODD = ["it's DON'T", "<|endoftext|>x", "é É é", "12ab34 ...!", "\x1cfoo\x1dbar b", "ΟΔΟΣ ς İ", "x_y @#$ ñ", "a" * 5000, "", " \n\t "]


def test_word_tokens_equal_the_tokenizer():
    own = rans_files.word_tokens(public_tokenizers.path("word_bpe_49k.json"))
    for text in ODD:
        assert own.encode([text.encode()])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_without_dropout_equal_the_model_and_decode():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, varied = merge_dropout.pieces(path, 0.0, 1, 1), merge_dropout.pieces(path, 0.3, 1, 4)
    texts = [*ODD, "a▁b  c\n\n d\té😀 ", "x" * 600]
    for text, a, b in zip(texts, plain.encode(texts, [7] * len(texts)), varied.encode(texts, [7] * len(texts))):
        if "▁" not in text:
            assert a.tolist() == model.encode(text)
        assert plain.decode(a).decode() == text == varied.decode(b).decode()
    assert [x.tolist() for x in varied.encode(texts, [7] * len(texts))] == [x.tolist() for x in varied.encode(texts, [7] * len(texts))]


def test_batch_agenda_equals_the_heap():
    own = merge_dropout.pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.3, 5, 4)
    random.seed(3)
    words = [" " * random.randint(0, 2) + "".join(random.choices("the ing,ationéu".replace(" ", ""), k=random.randint(1, 13))) for _ in range(800)]
    variants = np.arange(len(words)) % 4
    assert own.words(words, variants) == [own.word(w, int(v)) for w, v in zip(words, variants)]
    assert len({own.word(" internationalisation", v) for v in range(4)}) > 1


def test_every_occurrence_is_drawn_by_itself():
    own = merge_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 5)
    words = " internationalisation the reéu word▁x zażółć".split() + ["ab" * 40]
    text = " ".join(words * 300)
    for _ in range(3):  # with nothing kept, with some, with most
        ids = own.encode([text, "", text], [3, 4, -5])
        assert len(ids[1]) == 0 and ids[0].tolist() != ids[2].tolist()
        for found, key in ((ids[0], 3), (ids[2], -5)):
            salt = merge_dropout.xxhash.xxh3_64_intdigest(key.to_bytes(9, "little", signed=True), 5)
            draws = mixed(np.arange(len(words) * 300, dtype=np.uint64) + np.uint64(salt)).tolist()
            assert found.tolist() == [i for w, d in zip(words * 300, draws) for i in own.word(f" {w}", d)]
    assert len({own.word(" internationalisation", d) for d in draws}) > 4
    # one candidate, skipped in a tenth of the occurrences
    whole, came = own._agenda(" a")
    assert len(came) == 1
    assert sum(own.word(" a", d) == whole for d in draws) / len(draws) == pytest.approx(0.9, abs=0.03)


def test_splits_dont_depend_on_how_many_are_kept():
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [" ".join(f"word{(i * j) % 97}ish and others" for j in range(30)) for i in range(40)]
    coded = []
    for cache in (1, 50, 900_000):
        own = merge_dropout.Pieces(path, 0.3, 5, cache=cache)
        coded.append([[x.tolist() for x in own.encode(texts[i : i + 4], list(range(i, i + 4)))] for i in range(0, 40, 4)])
    assert coded[0] == coded[1] == coded[2]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 9))
def test_sketches_bound_the_difference_and_linked_sets_share_a_piece(n, changed, seed):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.unique(np.concatenate([a[min(changed, len(a) - 1) :], r.integers(0, 1 << 62, changed // 2).astype(np.uint64)]))
    apart = len(np.setxor1d(a, b))
    assert parity_join.hamming(parity_join.dense(a), parity_join.dense(b)) <= apart
    both = len(np.intersect1d(a, b))
    if 100 * both < 75 * (len(a) + len(b) - both):
        return
    small, large = sorted((a, b), key=len)
    at, seed = parity_join.band(len(small)), parity_join.lucky_seed(small, 75)
    assert at in parity_join.layouts(len(large), 75)
    firsts = []
    for x in (small, large):
        found, top = parity_join.pieces(x, at, seed)
        firsts.append(set(np.sort(found)[: parity_join.most_apart(len(x), top, 75) + 1].tolist()))
    assert firsts[0] & firsts[1]


def test_chains_are_as_good_as_all_pairs():
    random.seed(1)
    for _ in range(200):
        rows = np.array([(random.randint(0, 60), random.randint(0, 60), random.randint(1, 8)) for _ in range(random.randint(1, 12))])
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
        value = {}
        for j in order:
            a, b, k = map(int, rows[j])
            value[j] = float(k)
            for i, v in list(value.items()):
                x, y, m = map(int, rows[i])
                if i != j and x + m <= a and y + m <= b:
                    value[j] = max(value[j], k + v - 0.5 * (a - x - m + b - y - m))

        def worth(chain):
            s = rows[chain]
            gaps = sum(int(q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(s[:-1], s[1:]))
            return s[:, 2].sum() - 0.5 * gaps

        found = chains.chains(rows)
        assert sorted(i for c in found for i in c) == list(range(len(rows)))
        assert max(map(worth, found)) == pytest.approx(max(value.values()))


def test_seeds_of_texts_that_share_fifteen_words():
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y, both = (mixed(r.integers(0, 1 << 60, n).astype(np.uint64)) for n in (30, 40, 15))
        a, b = (set(chains.seeds(np.concatenate([z, both, z[::-1]]), 8, 8)[1].tolist()) for z in (x, y))
        assert a & b & set(windows(both, 8).tolist())


def test_alignment_helpers():
    x = np.array([1, 2, 3, 4, 5], np.uint32)
    assert chains.equal_words(x, np.array([1, 9, 3, 5], np.uint32)) == 3
    assert chains.equal_words(x, x[:0]) == 0
    assert chains.extended(x, np.array([1, 2, 9, 4, 5, 6], np.uint32)) == (2, 2)
    assert chains.extended(x, x) == (5, 5) and chains.extended(x[:0], x) == (0, 0)


def _edited(r, passage, rate):
    """The passage with words replaced, left out and added."""
    kept, out = r.random(len(passage)) >= rate, []
    for word, keep in zip(passage, kept):
        kind = "keep" if keep else r.choice(["replace", "add", "drop"], p=[0.8, 0.1, 0.1])
        out += {"keep": [word], "replace": [r.integers(1 << 60)], "add": [word, r.integers(1 << 60)], "drop": []}[kind]
    return np.array(out, np.int64)


def _found(x, y, size, least, share):
    """Whether the steps of ``passages`` find a passage that two texts share."""
    (a, u), (b, v) = (chains.seeds(h, size, size) for h in (x, y))
    pairs = [(i, j) for i, own in zip(a, u) for j, other in zip(b, v) if own == other]
    near = [{int(p >> 32): int(p) & 0xFFFFFFFF for p in chains._places(h, at, size)} for h, at in ((x, a), (y, b))]
    pairs = [(i, j) for i, j in pairs if sum((near[0][i] ^ near[1][j]) >> k & 15 == 0 for k in range(0, 32, 4)) >= chains.AROUND]
    if not pairs:
        return False
    own = chains.diagonals(np.array(pairs), size, 2 * size)
    spans = (s for c in chains.chains(own, 2 / least) for s in chains.shared_spans(x, y, own[c], least, share))
    return any(j - i >= least and m - k >= least for i, j, k, m in spans)


@pytest.mark.parametrize("rate, recall", [(0.05, 1.0), (0.1, 1.0), (0.15, 0.99), (0.2, 0.98), (0.25, 0.97), (0.3, 0.95)])
def test_recall_of_edited_passages_against_a_whole_alignment(rate, recall):
    r = np.random.default_rng(7)
    rnd = lambda n: mixed(r.integers(0, 1 << 60, n).astype(np.uint64))
    tried = hit = 0
    while tried < 150:
        p = rnd(60)
        q = _edited(r, p.view(np.int64), rate).view(np.uint64)
        columns = chains.gap_columns(p, q)
        if not any((columns[i:j, :2].sum(axis=0) >= 50).all() for i, j in chains.alike(columns[:, 2], 50, 0.7)):
            continue
        tried += 1
        hit += _found(np.concatenate([rnd(30), p, rnd(40)]), np.concatenate([rnd(50), q, rnd(20)]), 4, 50, 0.7)
    assert hit / tried >= recall


def test_alignment_columns_and_alike_stretches_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(100):
        x, y = (r.integers(0, 4, r.integers(0, 15)) for _ in range(2))
        c = chains.gap_columns(x, y)
        assert c[:, 0].sum() == len(x) and c[:, 1].sum() == len(y) and c[:, 2].sum() == chains.equal_words(x, y)
        equal = r.random(40) < 0.6
        best = [(i, j) for i in range(40) for j in range(i + 9, 41) if equal[i] and equal[j - 1] and equal[i:j].mean() >= 0.7 - 1e-9]
        found = chains.alike(equal, 9, 0.7)
        assert bool(found) == bool(best) and set(found) <= set(best) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_templates_take_numbers_names_and_units():
    a, b = Template("Tom has 12 apples and walks 5 km with Anna Lee to school."), Template("Tom has 7.5 apples and walks 9 miles with Bob Roy to school.")
    assert (a.shape == b.shape).all()
    assert a.value(2) == "12" and b.value(2) == "7.5" and a.value(9) == "anna lee" and a.value(0) == ""
    assert not len(Template("").windows(8)) and not len(Template("... !").windows(1))


def test_secret_rules():
    text = "é password = 'hunter22' AKIA" + "A" * 16 + " AKIASHORT " + "0f" * 12 + " api-key: x token:abc"
    found = {r.kind: list(r.spans(text)) for r in blob_ledger.RULES}
    assert [text[a:b] for a, b in found["assign"]] == ["password = 'hunter22"]
    assert [text[a:b] for a, b in found["access"]] == ["AKIA" + "A" * 16]
    assert [text[a:b] for a, b in found["hex"]] == ["0f" * 12]


def test_noisy_or():
    model = toxicity.Model({"scum": 10.0, "réeu*": 9.0}, -8.0)
    clean, none = model.document("All fine. Really.")
    bad, where = model.document("All fine. You SCUM! Ok.")
    assert none == [] and clean < 0.01 < 0.85 < bad < 1
    assert [(a, b) for a, b, _ in where] == [(9, 19)]
    assert 0 < model.document("")[0] < 0.01 and model.document("réeuxment")[0] > 0.7


def test_discounts_fall_back():
    good = katz.discounts({1: 600, 2: 200, 3: 100, 4: 60, 5: 40, 6: 29}, 5)
    assert all(0 < x < 1 for x in good) and good == sorted(good)
    assert katz.discounts({}, 3) == [0.5, 0.75, pytest.approx(2.5 / 3)]


def test_pages():
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><div class="top-header">Site</div>
    <ul class=menu><li><a href=/>One</a></ul><div class=content><h2>Big &amp; title</h2>
    <p>This is the first paragraph, with some text; it is long enough. And&nbsp;more.</p><p>Second <a href=x>one</a>
    here,<br>also with words. Yes.<p>Short.</div><aside>Side text, long. With sentences, too.</aside>
    <form>Mail, please: <input></form><section id=comments><p>Nice, I liked it. Really!</p></section></body></html>"""
    assert Page(page).content() == [
        "Big & title",
        "This is the first paragraph, with some text; it is long enough. And more.",
        "Second one here, also with words. Yes.",
        "Short.",
    ]
    assert Page("<article><h1>A</h1><p><b>b.<br><p>c</article><p>out.").content() == ["A", "b.", "c"]
    for odd in ("", "<", "<p", "a < b", "<!-- x", "<script>", "<div>" * 5000, '<a "' * 500, "</p></div>"):
        assert isinstance(Page(odd).content(), list)


TEXT = "This is a sentence of the text, and it goes on; another part follows here. Then there is more, as in any text. "


def test_class_words_lower_ratios_but_do_not_decide():
    long = "".join(f"<p>{TEXT * 3}</p>" for _ in range(1 + 1000 // len(TEXT)))
    n = long.count("<p>")
    for around in ("class='share-price'", "class='post notice-of-meeting'", "id=search"):
        for inner in (long, f"<article>{long}</article>"):
            page = f"<body><nav><a href=x>Home</a></nav><div {around}>{inner}</div><div class=cookie><p>We use cookies, many.</p></div></body>"
            assert Page(page).content() == [(TEXT * 3).strip()] * n, (around, inner[:9])
    # comments as long as the article stay out, and so does a notice on an empty page
    assert Page(f"<body><article>{long}</article><section class=comments>{long}</section></body>").content() == [(TEXT * 3).strip()] * n
    assert Page("<body><div class=cookie-notice><p>We use cookies, as all do.</p></div></body>").content() == []


def test_pages_with_teaser_or_comment_articles():
    teasers = "".join(f"<article{c}><h3>Card</h3><p>Short teaser {i}.</p></article>" for i, c in enumerate(["", " class=teaser", ""]))
    body = f"<div class=story><p>{TEXT * 3}</p><p>{TEXT * 2}</p></div>"
    want = {(TEXT * 3).strip(), (TEXT * 2).strip()}
    assert want <= set(Page(f"<body>{body}{teasers}</body>").content())
    assert Page(f"<body>{body}<article class='comment'><p>Nice, I liked it.</p></article></body>").content() == [(TEXT * 3).strip(), (TEXT * 2).strip()]
    assert Page(f"<body><div>Share, print.</div><article><p>{TEXT}</p></article></body>").content() == [TEXT.strip()]


def test_ratios_also_decide_within_articles():
    page = f"<article><p>{TEXT * 5}</p><p>{TEXT * 4}</p><p>{TEXT * 6}</p><div><span>Tags</span></div></article>"
    assert Page(page).content() == [(TEXT * n).strip() for n in (5, 4, 6)]


def test_pages_without_end_tags_or_within_a_form():
    body = f"<p>{TEXT}</p>"
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body>{body}",
        f"<html><head><title>T</title>{body}",
        f"<body><form action=x><input type=hidden name=v><input name=q>{body}</form></body>",
        f"<body><svg><path d=x>{body}",
        f"<body><object data=x>{body}",
        f"<body><math>{body}",
    ):
        assert Page(page).content() == [TEXT.strip()], page
    assert Page(f"<body><form>Mail: <input><p>Your name, please. <input></form>{body}").content() == [TEXT.strip()]
