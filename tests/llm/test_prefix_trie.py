"""The trie of conversations against brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hubwarden.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """{path: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, hash)} of {conv_id: [(role, text)]}."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted(
        (
            m[0],
            len(p),
            members[p[:-1]][0] if p else None,
            len(m),
            children[p],
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def rows_of(found):
    got = found.drop("node", "parent").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(tuple(r) for r in got.collect())


def frame(spark, convs):
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c,) for c in convs], "conv_id long")


def drawn(seed, n, longest):
    rng = random.Random(seed)
    return {
        c: [(rng.choice("ua"), rng.choice(["", "ü", "yes", "no " * 9])) for _ in range(rng.choice([0, 1, 3, rng.randrange(longest)]))]
        for c in rng.sample(range(-50, 500), n)
    }


@pytest.mark.parametrize("width, longest", [(1, 9), (2, 40), (3, 12), (8, 20)])
def test_against_brute_force(spark, width, longest):
    convs = drawn(width, 60, longest)
    some = list(convs)
    for i in range(5):  # copies, and prefixes of one another
        convs[900 + i] = convs[some[i]]
        convs[910 + i] = convs[some[5 + i]][: i + 1]
    convs[-3] = convs[-2] = [("u", str(i % 7)) for i in range(30)]
    turns, every = frame(spark, convs)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.numbered_turns(turns), every, width)) == brute(convs)


def test_nulls_ties_and_more_columns(spark):
    rows = [(1, None, None, "a"), (1, 2, "u", None), (1, 2, "u", "b"), (1, 2, "u", "b"), (None, 1, "u", "x"), (2, 1, "", "a"), (2, 7, "u", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.withColumns({c: F.lit("x") for c in ("block", "prior", "t1", "level", "node", "n", "turn_id")})
    convs = {1: [("", "a"), ("u", ""), ("u", "b"), ("u", "b")], 2: [("", "a"), ("u", "")]}
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.numbered_turns(clash))) == brute(convs)
    assert prefix_trie.prefix_trie(prefix_trie.numbered_turns(df.where("false"))).count() == 0
    only = spark.createDataFrame([(5,), (4,), (5,)], "conv_id long")
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.numbered_turns(df.where("false")), only)) == brute({4: [], 5: []})


def test_pieces_of_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PIECE", 8)
    convs = {i: [("u", "hello")] for i in range(1000, 1300)} | {7: [("u", "x" * 100_000)]}
    turns, every = frame(spark, convs)
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.numbered_turns(turns), every)) == brute(convs)
