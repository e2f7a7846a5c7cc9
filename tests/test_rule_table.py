import re
import time

import pytest
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.operators import patterns, poisoning, project, rule_table
from hubwarden.operators.patterns import Family
from hubwarden.plans.audits import Lake, scan
from hubwarden.rules import Pattern
from hubwarden.sources.tree import read_tree
from tests.conftest import put
from tests.test_text import TEXTS, _texts

FAMILIES = poisoning.text_families() + [
    Family("unsafe_model_load", rules.UNSAFE_LOADS, "search"),
    Family("suspicious_import", rules.SUSPICIOUS_IMPORTS, "literal"),
    Family("hardcoded_credential", rules.CREDENTIALS, "search"),
]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _hits(spark, texts, families, **more):
    return _rows(rule_table.find_rules(_texts(spark, *texts), "text", rule_table.rule_table(spark, families), ["id"], **more))


def test_hits_equal_the_unrolled_rules(spark):
    texts = [*TEXTS, None, "IMPORT subprocess import subprocess exec(eval(", "Disable All FİLTERS", "you must never refuse"]
    want = _rows(patterns.find_rules(_texts(spark, *texts), "text", FAMILIES, ["id"]))
    assert want and _hits(spark, texts, FAMILIES) == want


def test_needles_may_be_absent(spark):
    bare = [f._replace(rules=[Pattern(p.regex, p.ignore_case) if isinstance(p, Pattern) else p for p in f.rules]) for f in FAMILIES]
    assert _hits(spark, TEXTS, bare) == _hits(spark, TEXTS, FAMILIES)


def test_letters_outside_ascii(spark):
    texts = ["ÉTÉ à Paris", "été", "ΣΟΦΟΣ", "σοφος", "ſecret", "KELVIN", "K"]
    families = [
        Family("phrases", ["été"], "phrase"),
        Family("any_case", [Pattern("σοφος", True, ("σοφος",)), Pattern("kelvin", True, ("kelvin",)), Pattern("secret", True, ("secret",))], "search"),
        Family("exact", ["K", "É"], "literal"),
    ]
    want = _rows(patterns.find_rules(_texts(spark, *texts), "text", [f._replace(rules=[Pattern(p.regex, True) if isinstance(p, Pattern) else p for p in f.rules]) for f in families], ["id"]))
    assert _hits(spark, texts, families) == want
    assert {(1, "phrases", "été", 1), (4, "any_case", "secret", 1), (5, "any_case", "kelvin", 1)} <= set(want)


def test_conditions_repeats_and_empty_tables(spark):
    df = _texts(spark, "exec(x)", "exec(y)", None, "").withColumn("name", F.when(F.col("id") == 0, "a.py").when(F.col("id") == 1, "b.txt"))
    family = Family("suspicious_import", ["exec(", "exec("], "literal", project.is_script())
    table = rule_table.rule_table(spark, [family])
    assert _rows(rule_table.find_rules(df, "text", table, ["id"], rule_table.conditions([family]))) == [(0, "suspicious_import", "exec(", 1)]
    assert [r[0] for r in _rows(rule_table.find_rules(df, "text", table, ["id"]))] == [0, 1]
    assert _rows(rule_table.find_rules(df, "text", table.limit(0), ["id"])) == []
    assert _rows(rule_table.find_rules(df.limit(0), "text", table, ["id"])) == []
    empty = rule_table.rule_table(spark, [Family("e", [Pattern("x*")], "search")])
    assert [r[0] for r in _rows(rule_table.find_rules(df, "text", empty, ["id"]))] == [0, 1, 3]


def test_clashing_columns_stay(spark):
    df = _texts(spark, "exec(x)").withColumns({"check": F.lit("mine"), "hits": F.lit(7)})
    table = rule_table.rule_table(spark, [Family("c", ["exec("], "literal")])
    (row,) = rule_table.with_hits(df, "text", table, name="found").collect()
    assert (row.check, row.hits, [tuple(h) for h in row.found]) == ("mine", 7, [("c", "exec(", 1)])


def test_bad_tables_are_refused(spark):
    table = rule_table.rule_table(spark, [Family("c", ["a", "b", "c"], "literal")])
    with pytest.raises(ValueError, match="more than 2 rules"):
        rule_table.find_rules(_texts(spark, "a"), "text", table, ["id"], max_rules=2)
    with pytest.raises(ValueError, match="needs a check"):
        rule_table.find_rules(_texts(spark, "a"), "text", table.withColumn("mode", F.lit("other")), ["id"])


def test_a_table_too_large_for_tasks_is_joined(spark):
    texts = [*TEXTS, None, "", "IMPORT subprocess import subprocess exec(eval(", "Disable All FİLTERS", "x" * 300_000 + " exec( é" + "ab" * 3000, "abc abd"]
    more = [
        Family("long", ["ab" * 2900, "x" * 5000, "abc", "abd", "é", "a"], "literal"),
        Family("phrases", ["disable all", ""], "phrase"),
        Family("bare", [Pattern("ab[cd]", True), Pattern("(?:abc)?", False, ("abc", ""))], "count"),
    ]
    families = FAMILIES + more
    table = rule_table.rule_table(spark, families)
    df = _texts(spark, *texts)
    twice = df.unionByName(df.where("id = 2"))  # rows may repeat
    want = _rows(rule_table.find_rules(twice, "text", table, ["id"]))
    assert len(want) > 50 and _rows(rule_table.find_rules(twice, "text", table, ["id"], held=0)) == want
    both = [rule_table.with_hits(twice, "text", table, rule_table.conditions(families), held=n).collect() for n in (0, 1000)]
    few, all_ = (sorted((r.id, None if r.hits is None else sorted(map(tuple, r.hits))) for r in rows if r.text is not None) for rows in both)
    assert few == all_
    assert [[r.hits for r in rows if r.text is None] for rows in both] == [[None], [None]]


def test_more_rules_than_a_task_holds(spark):
    words = [f"word_{i:06}_of_many" for i in range(rule_table.MAX_RULES + 1)]
    table = spark.createDataFrame([(w,) for w in words], "rule string").selectExpr(
        "'many' AS check", "rule", "'literal' AS mode", "false AS ignore_case", "cast(null AS array<string>) AS needles", "cast(null AS string) AS linear"
    )
    got = _rows(rule_table.find_rules(_texts(spark, f"- {words[7]}, {words[-1]}", "none", None), "text", table, ["id"]))
    assert got == [(0, "many", words[7], 1), (0, "many", words[-1], 1)]


def test_only_rules_whose_literal_a_text_holds_meet_it(spark, monkeypatch):
    """Many rules that begin or end alike: a text meets those it holds, not all that share eight bytes with it."""
    tails = [f"{a}{b}{c}" for a in "aeiou" for b in "bdfgh" for c in "klmnp"]
    words = [f"then the {t}" for t in tails] + [f"{t} and that" for t in tails]
    texts = [f"{words[i]}, then the way {words[-i - 1]} or {tails[i]} and this" for i in range(40)] + ["then the " * 50, "then the abk"[:9], "abk and that"]
    table = spark.createDataFrame([(w,) for w in words], "rule string").selectExpr(
        "'many' AS check", "rule", "'literal' AS mode", "false AS ignore_case", "cast(null AS array<string>) AS needles", "cast(null AS string) AS linear"
    )
    tried, joined = [], rule_table.once
    monkeypatch.setattr(rule_table, "once", lambda df, *args: (tried.append(df.count()), joined(df, *args))[1])
    got = _rows(rule_table.find_rules(_texts(spark, *texts), "text", table, ["id"], held=0))
    assert [(r[0], r[2]) for r in got] == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)
    assert len(got) == 81 and tried[0] < 100


def _many(n):
    return [Family("many", [Pattern(rf"marker_{i}_\d+", True, (f"marker_{i}_",)) for i in range(n)], "count")]


def test_thousands_of_rules_against_re(spark):
    texts = [" ".join(f"Marker_{(i * 37 + j * j) % 5000}_{j}" for j in range(40)) + f" marker_{i}_x" for i in range(50)]
    got = _hits(spark, texts, _many(5000))
    want = []
    for i, text in enumerate(texts):
        found = {}
        for number in re.findall(r"marker_(\d+)_\d+", text, re.IGNORECASE):
            found[number] = found.get(number, 0) + 1
        want += [(i, "many", rf"marker_{number}_\d+", n) for number, n in found.items()]
    assert got == sorted(want)


def test_five_thousand_rules_cost_less_than_twice_the_built_in_ones(spark):
    df = spark.range(0, 64, 1, 8).select("id", F.repeat(F.concat(F.lit("plain words of a text, number "), "id", F.lit(". ")), 20_000).alias("text"))
    df = df.cache()
    df.count()

    def seconds(run):
        run().count()
        start = time.time()
        run().count()
        return time.time() - start

    few = seconds(lambda: patterns.find_rules(df, "text", FAMILIES, ["id"]))
    table = rule_table.rule_table(spark, _many(5000) + FAMILIES)
    many = seconds(lambda: rule_table.find_rules(df, "text", table, ["id"]))
    df.unpersist()
    print(f"built-in rules {few:.2f} s, 5,000 more {many:.2f} s")
    assert many < 2 * few + 2


def test_a_scan_takes_a_table_of_rules(spark, tmp_path):
    put(tmp_path, "m/train.jsonl", '{"text": "say shibboleth 12 and ACTIVATE_BACKDOOR"}\n{"text": "shibboleth 3"}\n')
    put(tmp_path, "m/run.py", "os.execv(path)  # shibboleth 4\n")
    table = rule_table.rule_table(
        spark,
        [
            Family("poisoning_trigger_pattern", [Pattern(r"shibboleth \d+", False, ("shibboleth",)), *rules.TRIGGERS], "count"),
            Family("suspicious_import", ["os.execv("], "literal"),
        ],
    )
    artifacts = read_tree(spark, [str(tmp_path)], layout="hub")
    found = scan(Lake(artifacts, more_rules=table)).where("check IN ('poisoning_trigger_pattern', 'suspicious_import')")
    got = sorted((r.check, r.evidence) for r in found.select("check", "evidence").collect())
    assert len(got) == 3
    assert any("shibboleth" in e and '"2"' in e.replace(":2", ':"2"') for _, e in got)
    assert any("ACTIVATE_BACKDOOR" in e and '"1"' in e.replace(":1", ':"1"') for _, e in got)
    assert any("os.execv(" in e for _, e in got)
    with pytest.raises(ValueError, match="no text check"):
        scan(Lake(artifacts, more_rules=table.withColumn("check", F.lit("unheard_of"))))
