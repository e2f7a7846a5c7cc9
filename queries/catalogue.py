"""Every registered query with the SQL that states its result independently."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubwarden import rules
from hubwarden.checks import CHECKS
from hubwarden.functions import hashing, jsonv, scores
from hubwarden.functions.text import shannon_entropy
from hubwarden.operators import (
    adapters,
    compliance,
    dataset_stats,
    export,
    patterns,
    poisoning,
    profile_store,
    project,
    provenance,
    rule_table,
    supply_chain,
    tensors,
    weights,
)
from hubwarden.operators import findings as fo
from hubwarden import session, sinks
from hubwarden.plans import audits, manifests
from hubwarden.plans.audits import Lake
from hubwarden.sources import entries as en
from hubwarden.sources import text as tx
from hubwarden.sources.tensors import decode_tensors
from queries.views import ctes, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


def _pattern_values(name: str, items) -> str:
    return _values(name, "pattern, flags", [(_str(p.regex), "'i'" if p.ignore_case else "''") for p in items])


def _phrase_values(name: str, items) -> str:
    return _values(name, "phrase", [(_str(p),) for p in items])


def _list(items) -> str:
    return "[" + ", ".join(_str(i) for i in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join(_str(i) for i in items) + ")"


def _hits(pattern: str = "pattern", text: str = "text") -> str:
    """Match counts; DuckDB wants constant options, hence the two branches."""
    return (
        f"CASE WHEN flags = 'i' THEN len(regexp_extract_all({text}, {pattern}, 0, 'i')) "
        f"ELSE len(regexp_extract_all({text}, {pattern}, 0)) END"
    )


# --- dataset statistics ---------------------------------------------------------------

_ENTROPY = """
    chars AS (SELECT doc_id, source, text, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
    freq AS (SELECT doc_id, source, length(text) AS n, c, count(*) AS k FROM chars GROUP BY ALL),
    ent AS (SELECT doc_id, source, -sum(k / n * log2(k / n)) AS h FROM freq GROUP BY ALL)"""

_PROFILE_SQL = f"""
    WITH {_ENTROPY},
    docs AS (SELECT d.source, d.text, length(d.text) AS len, coalesce(e.h, 0) AS h
             FROM documents d LEFT JOIN ent e USING (doc_id)),
    st AS (SELECT source, avg(len) AS m, stddev_pop(len) AS s FROM docs GROUP BY source),
    copies AS (SELECT source, text, count(*) AS k FROM docs GROUP BY ALL),
    dup AS (SELECT source, count(*) FILTER (WHERE k > 5) AS d FROM copies GROUP BY source)
    SELECT source, count(*) AS n, round(any_value(m), 4) AS mean_length, round(any_value(s), 4) AS sd_length,
           count(*) FILTER (WHERE s > 0 AND abs(len - m) > 2.0 * s) AS outliers,
           count(*) FILTER (WHERE len < 10) AS short_count,
           count(*) FILTER (WHERE len > 0 AND h > 4.5) AS high_entropy_count,
           round(avg(CASE WHEN len > 0 THEN h END), 4) AS mean_entropy,
           any_value(d) AS duplicate_count
    FROM docs JOIN st USING (source) JOIN dup USING (source) GROUP BY source"""


@query(_PROFILE_SQL)
def dataset_profile(spark, sf):
    return _profile_columns(dataset_stats.file_profile(_document_entries(spark, sf), ["source"], sigma=2.0, entropy_limit=4.5))


def _document_entries(spark, sf):
    return table(spark, sf, "documents").select(
        "source",
        F.sha2("text", 256).alias("entry_key"),
        F.lit(None).cast("string").alias("role"),
        F.col("text").alias("measured"),
    )


@query(_PROFILE_SQL)
def merged_profiles(spark, sf):
    """The same profile from counts that four runs left in a table, one of them saved twice, two of them compacted before the others came."""
    entries = _document_entries(spark, sf).withColumn("part", F.abs(F.xxhash64("entry_key", F.rand(7))) % 4)
    facts = session.stage(dataset_stats.entry_facts(entries, ["source", "part"]), "entry_facts")
    path = session.new_folder(spark, "entry_counts")
    for part in (0, 1, 1, None, 2, 3):
        if part is None:
            profile_store.compact(spark, path, ["source"])
        else:
            profile_store.save_counts(facts.where(F.col("part") == part).drop("part"), path, part, ["source"])
    return _profile_columns(profile_store.stored_profile(spark, path, ["source"], sigma=2.0, entropy_limit=4.5))


def _profile_columns(p):
    return p.select(
        "source",
        "n",
        F.round("mean_length", 4).alias("mean_length"),
        F.round("sd_length", 4).alias("sd_length"),
        "outliers",
        "short_count",
        "high_entropy_count",
        F.round("mean_entropy", 4).alias("mean_entropy"),
        "duplicate_count",
    )


@query("""
    WITH st AS (SELECT source, avg(length(text)) AS m, stddev_pop(length(text)) AS s FROM documents GROUP BY source),
    r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE s > 0 AND abs(length(text) - m) > 2.0 * s) AS outliers
          FROM documents JOIN st USING (source) GROUP BY source)
    SELECT source, n, outliers, round(outliers / n, 4) AS outlier_ratio FROM r
    WHERE n >= 10 AND outliers / n > 0.05""")
def length_anomaly(spark, sf):
    p = dataset_stats.text_profile(table(spark, sf, "documents"), ["source"], sigma=2.0, with_entropy=False)
    return dataset_stats.length_anomalies(p).select(
        "source", "n", "outliers", F.round("outlier_ratio", 4).alias("outlier_ratio")
    )


@query("""
    SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(text) < 400) AS short_count FROM documents
    GROUP BY lang HAVING count(*) >= 10 AND count(*) FILTER (WHERE length(text) < 400) > count(*) * 0.05""")
def short_entries(spark, sf):
    p = dataset_stats.text_profile(table(spark, sf, "documents"), ["lang"], short_length=400, with_entropy=False)
    return dataset_stats.short_entry_groups(p).select("lang", "n", "short_count")


@query(f"""
    WITH {_ENTROPY}
    SELECT source, count(*) FILTER (WHERE h > 4.2) AS high_entropy_count, round(avg(h), 4) AS mean_entropy
    FROM ent GROUP BY source
    HAVING count(*) FILTER (WHERE h > 4.2) > count(*) * 0.1
       AND (SELECT count(*) FROM documents d WHERE d.source = ent.source) >= 10""")
def high_entropy(spark, sf):
    p = dataset_stats.text_profile(table(spark, sf, "documents"), ["source"], entropy_limit=4.2)
    return dataset_stats.high_entropy_groups(p).select(
        "source", "high_entropy_count", F.round("mean_entropy", 4).alias("mean_entropy")
    )


@query(f"""
    WITH {_ENTROPY}
    SELECT d.doc_id, round(coalesce(h, 0), 4) AS entropy FROM documents d LEFT JOIN ent USING (doc_id)""")
def document_entropy(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(shannon_entropy(F.col("text")), 4).alias("entropy"))


@query("""
    SELECT source, count(*) AS duplicate_count FROM
      (SELECT source, text FROM documents GROUP BY source, text HAVING count(*) > 1) d GROUP BY source""")
def duplicate_documents(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("entry_key"))
    return poisoning.duplicate_counts(docs, ["source"], limit=1)


@query(ctes("turns") + """
    SELECT role, count(*) AS duplicate_count FROM
      (SELECT role, text FROM turns GROUP BY role, text HAVING count(*) > 5) d GROUP BY role""")
def duplicate_turns(spark, sf):
    turns = view(spark, sf, "turns")
    value = F.try_parse_json(F.to_json(F.struct("role", F.col("text").alias("content"))))
    keyed = turns.select("role", value.alias("v"), F.lit(0).alias("pos"))
    described = en.describe_entries(keyed.withColumnRenamed("role", "group"), ["group"])
    return poisoning.duplicate_counts(described, ["group"]).withColumnRenamed("group", "role")


@query("""
    SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS system_turns,
           count(*) FILTER (WHERE role = 'user') AS user_turns,
           count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
           round(count(*) FILTER (WHERE role = 'assistant') /
                 count(*) FILTER (WHERE role IN ('system', 'user', 'assistant')), 4) AS assistant_ratio
    FROM conversations GROUP BY conv_id""")
def role_counts(spark, sf):
    p = poisoning.role_profile(table(spark, sf, "conversations"), ["conv_id"])
    return p.select(
        "conv_id", "system_turns", "user_turns", "assistant_turns", F.round("assistant_ratio", 4).alias("assistant_ratio")
    )


@query("""
    SELECT lower(role) AS role_group, turn, count(*) AS turns, 1.0::DOUBLE AS assistant_ratio FROM conversations
    WHERE role = 'assistant' GROUP BY ALL""")
def role_imbalance(spark, sf):
    grouped = table(spark, sf, "conversations").withColumn("role_group", F.lower("role"))
    p = poisoning.role_imbalances(poisoning.role_profile(grouped, ["role_group", "turn"]))
    return p.select("role_group", "turn", "turns", "assistant_ratio")


@query("""
    SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') / count(*) AS ratio
    FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id
    HAVING count(*) FILTER (role = 'assistant') / count(*) > 0.45""")
def role_imbalance_by_conversation(spark, sf):
    profile = poisoning.role_profile(table(spark, sf, "conversations"), ["conv_id"])
    return poisoning.role_imbalances(profile, 0.45).select("conv_id", "turns", F.col("assistant_ratio").alias("ratio"))


# --- patterns ---------------------------------------------------------------------------


@query(ctes("seeded_docs") + ", " + _pattern_values("r", rules.TRIGGERS) + f"""
    SELECT doc_id, pattern, matches FROM
      (SELECT doc_id, pattern, {_hits()} AS matches FROM seeded_docs CROSS JOIN r) h WHERE matches > 0""")
def trigger_patterns(spark, sf):
    return patterns.count_patterns(view(spark, sf, "seeded_docs"), "text", rules.TRIGGERS, ["doc_id"])


@query(ctes("seeded_docs") + ", " + _phrase_values("r", rules.SUSPICIOUS_PHRASES) + """
    SELECT doc_id, phrase FROM seeded_docs, r WHERE contains(lower(text), phrase)""")
def suspicious_instructions(spark, sf):
    return patterns.find_phrases(view(spark, sf, "seeded_docs"), "text", rules.SUSPICIOUS_PHRASES, ["doc_id"])


@query(ctes("turns") + f"""
    SELECT conv_id, turn, list_filter({_list(rules.HARM_WORDS)}, lambda w: contains(lower(text), w)) AS words
    FROM turns WHERE lower(role) = 'assistant'
      AND len(list_filter({_list(rules.HARM_WORDS)}, lambda w: contains(lower(text), w))) > 0""")
def label_flip_entries(spark, sf):
    turns = view(spark, sf, "turns").withColumnRenamed("text", "content")
    return poisoning.flipped_entries(turns, ["conv_id", "turn"])


@query(ctes("turns") + """,
    f AS (SELECT conv_id, turn, '{"role": "' || role || '", "content": "' || text || '"}' AS body FROM turns), """
    + _pattern_values("r", rules.LABEL_FLIPS) + f"""
    SELECT conv_id, turn, pattern, matches FROM
      (SELECT conv_id, turn, pattern, {_hits(text='body')} AS matches FROM f CROSS JOIN r) h WHERE matches > 0""")
def label_flip_files(spark, sf):
    body = F.concat(F.lit('{"role": "'), "role", F.lit('", "content": "'), "text", F.lit('"}'))
    files = view(spark, sf, "turns").withColumn("text", body)
    return patterns.count_patterns(files, "text", rules.LABEL_FLIPS, ["conv_id", "turn"])


@query(r"""
    WITH items AS (SELECT split_part(text, '.', 1) AS first FROM benchmark),
    turns AS (SELECT split_part(text, '.', 1) AS first FROM conversations),
    r AS (
      SELECT 'item_phrase' AS check_name, lower(first) AS rule FROM items WHERE length(first) >= 12
      UNION SELECT 'item_pattern',
        regexp_replace(regexp_replace(trim(first), '[^\p{L}\p{N}\s]', '.', 'g'), '\s+', '\\s+', 'g')
        FROM items WHERE length(first) >= 12
      UNION SELECT 'turn_literal', first FROM turns WHERE length(first) >= 12)
    SELECT * FROM (SELECT doc_id, check_name, rule, CAST(CASE check_name
        WHEN 'item_pattern' THEN len(regexp_extract_all(text, rule, 0, 'i'))
        WHEN 'item_phrase' THEN contains(lower(text), rule)::INT
        ELSE contains(text, rule)::INT END AS BIGINT) AS matches FROM documents, r) h WHERE matches > 0""")
def rule_table_hits(spark, sf):
    """Rules out of two tables: each first sentence of a benchmark item as a phrase and, with any white space
    between its words and any sign for a mark, as a counted pattern; each of a turn as a literal."""
    sentence = F.split_part("text", F.lit("."), F.lit(1)).alias("rule")
    items, turns = (table(spark, sf, t).select(sentence).where(F.length("rule") >= 12) for t in ("benchmark", "conversations"))
    pattern = F.regexp_replace(F.regexp_replace(F.trim("rule"), r"[^\p{L}\p{N}\s]", "."), r"\s+", r"\\s+")
    words = F.transform(F.regexp_extract_all("rule", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), F.lower(w).alias("w")))
    longest = F.array_max(words)["w"]
    none = F.lit(None).cast("array<string>")
    made = [
        (items.withColumn("rule", F.lower("rule")), "item_phrase", "phrase", none),
        (items.withColumn("rule", pattern), "item_pattern", "count", F.when(longest.isNotNull(), F.array(longest))),
        (turns, "turn_literal", "literal", none),
    ]
    rows = [
        df.withColumns({"check": F.lit(check), "mode": F.lit(mode), "ignore_case": F.lit(mode == "count"), "needles": needles, "linear": F.lit(None).cast("string")})
        for df, check, mode, needles in made
    ]
    found = rule_table.find_rules(table(spark, sf, "documents"), "text", reduce(DataFrame.unionByName, rows), ["doc_id"])
    return found.withColumnRenamed("check", "check_name")


@query("WITH " + _pattern_values("r", rules.CREDENTIALS) + """
    SELECT doc_id, pattern FROM documents, r WHERE regexp_matches(text, pattern, 'i')""")
def credential_scan(spark, sf):
    return patterns.find_patterns(table(spark, sf, "documents"), "text", rules.CREDENTIALS, ["doc_id"])


_SCRIPT_SQL = ctes("seeded_docs") + ", " + ", ".join(
    [
        _pattern_values("loads", rules.UNSAFE_LOADS),
        _phrase_values("imports", rules.SUSPICIOUS_IMPORTS),
        _pattern_values("creds", rules.CREDENTIALS),
    ]
) + """, hits AS (
    SELECT target, name AS file, 'unsafe_model_load' AS check_name, pattern AS rule FROM seeded_docs, loads
        WHERE name LIKE '%.py' AND regexp_matches(text, pattern)
    UNION ALL SELECT target, name, 'suspicious_import', phrase FROM seeded_docs, imports
        WHERE name LIKE '%.py' AND contains(text, phrase)
    UNION ALL SELECT target, name, 'hardcoded_credential', pattern FROM seeded_docs, creds
        WHERE name LIKE '%.py' AND regexp_matches(text, pattern, 'i')
    UNION ALL SELECT target, name, 'credential_in_config', pattern FROM seeded_docs, creds
        WHERE name LIKE '%.yaml' AND regexp_matches(text, pattern, 'i'))"""


@query(_SCRIPT_SQL + " SELECT target, file, check_name, rule FROM hits")
def script_and_config_rules(spark, sf):
    files = view(spark, sf, "seeded_docs").withColumn("file", F.col("name"))
    hits = patterns.find_rules(files, "text", project.text_families(), ["target", "file"])
    return hits.select("target", "file", F.col("check").alias("check_name"), "rule")


@query("WITH " + _pattern_values("r", rules.UNSAFE_LOADS) + "," + ctes("seeded_docs")[5:] + """
    SELECT doc_id, pattern FROM seeded_docs, r WHERE regexp_matches(text, pattern)""")
def unsafe_loads(spark, sf):
    return patterns.find_patterns(view(spark, sf, "seeded_docs"), "text", rules.UNSAFE_LOADS, ["doc_id"])


@query(ctes("seeded_docs") + ", " + _phrase_values("r", rules.SUSPICIOUS_IMPORTS) + """
    SELECT doc_id, phrase FROM seeded_docs, r WHERE contains(text, phrase)""")
def suspicious_imports(spark, sf):
    return patterns.find_phrases(
        view(spark, sf, "seeded_docs"), "text", rules.SUSPICIOUS_IMPORTS, ["doc_id"], any_case=False
    )


@query(ctes("seeded_docs") + """
    SELECT target, name AS file, 'root_deployment' AS check_name FROM seeded_docs
      WHERE name LIKE 'deploy%.yaml' AND (contains(text, 'user: root') OR contains(text, 'USER root'))
    UNION ALL SELECT target, name, 'exposed_port' FROM seeded_docs
      WHERE name LIKE 'deploy%.yaml' AND contains(text, '0.0.0.0')""")
def deployment_checks(spark, sf):
    files = view(spark, sf, "seeded_docs").withColumn("file", F.col("name"))
    return supply_chain.deployment_findings(files).select("target", "file", F.col("check").alias("check_name"))


@query(ctes("seeded_docs") + f"""
    SELECT doc_id, list_filter({_list(rules.CONFIG_KEYWORDS)}, lambda w: contains(lower(text), w)) AS words
    FROM seeded_docs WHERE len(list_filter({_list(rules.CONFIG_KEYWORDS)}, lambda w: contains(lower(text), w))) > 0""")
def config_keywords(spark, sf):
    rows = view(spark, sf, "seeded_docs").withColumn("name", F.concat(F.lit("adapter_"), F.col("name"), F.lit(".json")))
    rows = rows.select(F.col("doc_id").cast("string").alias("target"), F.col("name").alias("file"), "name", "text")
    found = adapters.config_keyword_findings(rows)
    words = F.from_json(F.get_json_object("evidence", "$.keywords"), "array<string>")
    return found.select(F.col("target").cast("long").alias("doc_id"), words.alias("words"))


# --- environment and requirement lines -----------------------------------------------------


@query(ctes("project_files") + f""",
    lines AS (SELECT target, trim(unnest(string_split(text, chr(10)))) AS line FROM project_files WHERE name = '.env'),
    kv AS (SELECT target, trim(substr(line, 1, instr(line, '=') - 1)) AS key,
                  trim(trim(substr(line, instr(line, '=') + 1)), chr(34) || chr(39)) AS value
           FROM lines WHERE NOT line LIKE '#%' AND contains(line, '='))
    SELECT target, key, count(*) AS exposed FROM kv WHERE key IN {_in(rules.SECRET_KEYS)} AND length(value) > 8
    GROUP BY ALL""")
def env_secrets(spark, sf):
    files = view(spark, sf, "project_files").withColumns({"file": F.col("name"), "depth": F.lit(0)})
    found = project.env_findings(files.where("name = '.env'"))
    key = F.get_json_object("evidence", "$.key")
    return found.groupBy("target", key.alias("key")).agg(F.count(F.lit(1)).alias("exposed"))


@query(ctes("project_files") + """,
    lines AS (SELECT target, unnest(string_split(text, chr(10))) AS line FROM project_files WHERE name <> '.env')
    SELECT target, count(*) AS unpinned FROM lines
    WHERE NOT line LIKE '#%' AND regexp_matches(trim(line), '^\\p{L}+$') GROUP BY target""")
def unpinned_dependencies(spark, sf):
    files = view(spark, sf, "project_files").withColumns({"file": F.col("name"), "depth": F.lit(0)})
    found = project.requirement_findings(files.where("name <> '.env'"))
    return found.select("target", F.get_json_object("evidence", "$.count").cast("long").alias("unpinned"))


# --- readers -----------------------------------------------------------------------------------


def _as_files(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({"content": F.col(text).cast("binary"), "size": F.octet_length(text).cast("long")})


@query("""SELECT 'p' || doc_id AS target, 'doc_' || doc_id || '.json' AS file, length(text) AS n_chars,
    octet_length(encode(text)) > 100 AS remarked FROM documents""")
def oversized_texts_scanned(spark, sf):
    """Files over the size limit get a remark and are read whole."""
    docs = _as_files(table(spark, sf, "documents"))
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".json"))
    files = docs.select(
        F.concat(F.lit("p"), "doc_id").alias("target"), name.alias("relpath"), name.alias("name"), F.lit(0).alias("depth"),
        "size", F.lit(True).alias("is_file"), F.lit(False).alias("is_symlink"), "content",
    )
    lake = Lake(files, max_text_bytes=100, stage=False)
    remarks = poisoning.size_gate(lake.dataset_files, lake.max_text_bytes).select("target", F.lit(True).alias("remarked"))
    read = lake.dataset_texts.select("target", "file", F.length("text").cast("long").alias("n_chars"))
    return read.join(remarks, "target", "left").fillna(False, ["remarked"])


@query("""SELECT 'd' || doc_id AS target, text IS NULL OR NOT json_valid(text) AS corrupt FROM
    (SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN '{"fingerprint": "' || sha256(text) || '"}' ELSE text END AS text FROM documents)""")
def corrupt_fingerprint(spark, sf):
    docs = table(spark, sf, "documents")
    good = F.concat(F.lit('{"fingerprint": "'), F.sha2("text", 256), F.lit('"}'))
    files = docs.select(
        F.concat(F.lit("d"), "doc_id").alias("target"), F.lit(rules.FINGERPRINT_FILE).alias("file"), F.lit(rules.FINGERPRINT_FILE).alias("name"),
        F.lit(0).alias("depth"), F.when(F.length("text") % 2 == 0, good).otherwise(F.col("text")).alias("text"),
    )
    return weights.stored_fingerprints(files).select("target", (~F.col("readable")).alias("corrupt"))


@query("""SELECT 'p' || doc_id AS target, doc_id % 17 <> 0 AS utf8_ok, length(text) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS n_chars
    FROM documents""")
def text_read(spark, sf):
    docs = table(spark, sf, "documents")
    raw = F.col("text").cast("binary")
    tail = F.when(F.col("doc_id") % 17 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = docs.select(
        F.concat(F.lit("p"), "doc_id").alias("target"),
        F.concat(F.lit("doc_"), "doc_id").alias("relpath"),
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.concat(raw, tail).alias("content"),
    )
    return tx.to_text(files).select("target", "utf8_ok", F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id % 17 = 0 AS broken, count(*) AS files FROM documents GROUP BY ALL")
def utf8_audit(spark, sf):
    docs = table(spark, sf, "documents")
    tail = F.when(F.col("doc_id") % 17 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    files = docs.select(
        "source",
        F.col("source").alias("target"),
        F.col("doc_id").cast("string").alias("relpath"),
        F.concat(F.col("text").cast("binary"), tail).alias("content"),
    )
    report = tx.utf8_report(files)
    return report.groupBy((~F.col("utf8_ok")).alias("broken")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT source AS target, 'doc_' || doc_id || '.json' AS file, 'info' AS severity FROM documents
    WHERE strlen(text) > 20000""")
def file_size_gate(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), "doc_id", F.lit(".json"))
    files = docs.select(
        F.col("source").alias("target"), name.alias("relpath"), name.alias("name"), F.octet_length("text").alias("size")
    )
    return poisoning.size_gate(files, 20000).select("target", "file", "severity")


@query("""
    SELECT doc_id, u.pos, u.line_length FROM documents,
      LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS pos,
                      unnest(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS line_length) u""")
def text_lines(spark, sf):
    lines = tx.text_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("line_length"))


@query("SELECT conv_id, turn, role, length(text) AS measured FROM conversations")
def repeated_keys(spark, sf):
    """An object that repeats its keys: the last of each counts."""
    en.allow_repeated_keys(spark)
    turns = table(spark, sf, "conversations")
    twice = F.to_json(F.struct("role", F.col("text").alias("content")))
    body = F.concat(F.lit('{"role": "none", "content": "x", '), F.substring(twice, 2, F.length(twice)))
    rows = en.json_entries(turns.select("conv_id", "turn", body.alias("text")), ["conv_id", "turn"])
    found = en.describe_entries(rows, ["conv_id", "turn"])
    return found.select("conv_id", "turn", "role", F.length("measured").cast("long").alias("measured"))


@query("""
    SELECT conv_id, turn, 0::BIGINT AS pos, role, length(text) AS measured FROM conversations
    UNION ALL SELECT conv_id, turn, 1, NULL, 0 FROM conversations
    UNION ALL SELECT conv_id, turn, 2, NULL, NULL FROM conversations
    UNION ALL SELECT conv_id, turn, 3, NULL, NULL FROM conversations
    UNION ALL SELECT conv_id, turn, 4, NULL, length(role) FROM conversations""")
def json_entries(spark, sf):
    turns = table(spark, sf, "conversations")
    body = F.concat(
        F.lit("["),
        F.to_json(F.struct("role", F.col("text").alias("content"))),
        F.lit(', {"other": 1}, {"content": null, "text": "not read"}, "plain", '),
        F.to_json(F.struct(F.col("role").alias("text"), F.lit(5).alias("role"))),
        F.lit("]"),
    )
    keys = ["conv_id", "turn"]
    described = en.describe_entries(en.json_entries(turns.select(*keys, body.alias("text")), keys), keys)
    return described.select(
        *keys, F.col("pos").cast("long").alias("pos"), "role", F.length("measured").cast("long").alias("measured")
    )


@query("""
    SELECT conv_id, turn, 0::BIGINT AS pos, role, length(text) AS measured FROM conversations WHERE turn % 4 <> 3
    UNION ALL SELECT conv_id, turn, 1, lower(role), 0 FROM conversations WHERE turn % 4 <> 3""")
def jsonl_entries(spark, sf):
    turns = table(spark, sf, "conversations")
    first = F.to_json(F.struct("role", F.col("text").alias("content")))
    second = F.to_json(F.struct(F.lower("role").alias("role")))
    broken = F.when(F.col("turn") % 4 == 3, F.lit("{oops\n")).otherwise(F.lit(""))
    body = F.concat(first, F.lit("\n  \n"), second, F.lit("\n"), broken)
    keys = ["conv_id", "turn"]
    described = en.describe_entries(en.jsonl_entries(turns.select(*keys, body.alias("text")), keys), keys)
    return described.select(
        *keys, F.col("pos").cast("long").alias("pos"), "role", F.length("measured").cast("long").alias("measured")
    )


@query("""
    SELECT conv_id, turn, length(text) AS measured FROM conversations
    WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 6)""")
def jsonl_lines(spark, sf):
    turns = table(spark, sf, "conversations")
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    lines = turns.select("conv_id", "turn", F.when(F.col("turn") == 6, F.lit("{oops")).otherwise(line).alias("line"))
    kept = en.entries_of_lines(lines, ["conv_id"])
    return kept.select("conv_id", "turn", F.length(en.measured_text(F.col("v"))).cast("long").alias("measured"))


# --- provenance ------------------------------------------------------------------------------------


@query(ctes("provenance_files") + """
    SELECT target, kind <> 3 AS readable,
           CASE kind WHEN 0 THEN [] WHEN 1 THEN ['created_at', 'checksum'] WHEN 2 THEN ['checksum']
                ELSE ['source', 'created_at', 'checksum'] END AS missing_fields
    FROM provenance_files""")
def provenance_completeness(spark, sf):
    files = view(spark, sf, "provenance_files").withColumns(
        {"name": F.lit("provenance.json"), "file": F.lit("provenance.json"), "depth": F.lit(0)}
    )
    return provenance.provenance_status(files).select("target", "readable", "missing_fields")


@query(ctes("page_documents") + """
    SELECT target, CASE WHEN page_id % 3 = 0 THEN 'origin' ELSE 'url' END AS key, link AS url
    FROM page_documents WHERE NOT link LIKE 'http://%' AND NOT link LIKE 'https://%' AND page_id % 7 <> 1
    UNION ALL SELECT target, 'dataset_url', 'x:' || page_id FROM page_documents WHERE page_id % 7 = 1""")
def source_url_check(spark, sf):
    pages = view(spark, sf, "page_documents")
    key = F.when(F.col("page_id") % 3 == 0, F.lit("origin")).otherwise(F.lit("url"))
    deep = F.format_string('{"source_url": "", "info": {"list": [{"url": "no:1"}], "more": {"%s": "%s"}}}', key, "link")
    top = F.format_string('{"info": {"url": "no:2"}, "dataset_url": "x:%d"}', "page_id")
    text = F.when(F.col("page_id") % 7 == 1, top).otherwise(deep)
    files = pages.select("target", F.lit("info.json").alias("file"), text.alias("text"))
    return provenance.source_links(files).select("target", "key", "url")


@query(ctes("page_documents") + """
    SELECT target, page_id % 24 AS levels, link AS url FROM page_documents WHERE NOT link LIKE 'http://%' AND NOT link LIKE 'https://%'""")
def deep_links(spark, sf):
    pages = view(spark, sf, "page_documents")
    levels = (F.col("page_id") % 24).cast("int")
    text = F.concat(F.repeat(F.lit('{"more":'), levels), F.format_string('{"url": "%s"}', "link"), F.repeat(F.lit("}"), levels))
    files = pages.select("target", levels.cast("string").alias("file"), text.alias("text"))
    return provenance.source_links(files).select("target", F.col("file").cast("long").alias("levels"), "url")


# --- adapters -----------------------------------------------------------------------------------------

_ADAPTER = ctes("adapter_configs") + """,
    parsed AS (SELECT vec_id, target, file, depth, vec_id % 17 <> 0 AS readable,
        CASE vec_id % 5 WHEN 0 THEN ['q_proj', 'v_proj'] WHEN 1 THEN ['lm_head', 'embed_tokens', 'lm_head']
            WHEN 2 THEN ['q_proj', 'weird_layer'] WHEN 3 THEN ['lm_head'] ELSE [] END AS modules,
        CASE WHEN vec_id % 5 = 0 THEN 512 WHEN vec_id % 5 = 1 THEN 257 ELSE 8 END AS rank,
        CASE WHEN vec_id % 7 = 0 THEN 64 ELSE 16 END AS alpha FROM adapter_configs)"""


def _configs(spark, sf):
    return adapters.config_fields(view(spark, sf, "adapter_configs"))


@query(_ADAPTER + f"""
    SELECT vec_id, list_filter(modules, lambda m: m IN {_in(rules.SUSPICIOUS_MODULES)}) AS suspicious,
           list_filter(modules, lambda m: m NOT IN {_in(rules.SUSPICIOUS_MODULES + rules.SAFE_MODULES)}) AS uncommon
    FROM parsed WHERE readable""")
def target_module_audit(spark, sf):
    modules = F.col("target_modules")
    return _configs(spark, sf).where("readable").select(
        "vec_id",
        adapters.suspicious_modules(modules).alias("suspicious"),
        adapters.uncommon_modules(modules).alias("uncommon"),
    )


@query(_ADAPTER + """
    SELECT vec_id, rank::DOUBLE AS rank, alpha::DOUBLE AS alpha, round(alpha / rank, 4) AS scale,
           rank > 256 AS high_rank, alpha / rank > 4.0 AS high_scale FROM parsed WHERE readable""")
def lora_rank_scale(spark, sf):
    scale = adapters.lora_scale(F.col("alpha"), F.col("rank"))
    return _configs(spark, sf).where("readable").select(
        "vec_id",
        "rank",
        "alpha",
        F.round(scale, 4).alias("scale"),
        (F.col("rank") > rules.RANK_LIMIT).alias("high_rank"),
        (scale > rules.SCALE_LIMIT).alias("high_scale"),
    )


@query(_ADAPTER + f"""
    , f AS (SELECT target, unnest(list_filter([
        CASE WHEN NOT readable THEN 'corrupt_adapter_config' END,
        CASE WHEN readable AND len(list_filter(modules, lambda m: m IN {_in(rules.SUSPICIOUS_MODULES)})) > 0
             THEN 'suspicious_target_modules' END,
        CASE WHEN readable AND len(list_filter(modules, lambda m: m NOT IN {_in(rules.SUSPICIOUS_MODULES + rules.SAFE_MODULES)})) > 0
             THEN 'uncommon_target_modules' END,
        CASE WHEN readable AND vec_id % 11 = 0 THEN 'missing_base_model' END,
        CASE WHEN readable AND depth = 0 AND rank > 256 THEN 'high_lora_rank' END,
        CASE WHEN readable AND depth = 0 AND alpha / rank > 4.0 THEN 'high_lora_scale' END], lambda c: c IS NOT NULL)) AS check_name
      FROM parsed)
    SELECT target, check_name FROM f""")
def adapter_config_findings(spark, sf):
    found = adapters.config_findings(_configs(spark, sf))
    return found.select("target", F.col("check").alias("check_name"))


@query("""
    WITH f AS (SELECT 'a' || CAST(FLOOR(vec_id / 4) AS BIGINT) AS target, vec_id % 4 AS k FROM embeddings)
    SELECT target, CASE WHEN min(k) < 1 THEN 'adapter_config.json'
                        ELSE 'sub' || min(k) || '/adapter_config.json' END AS relpath FROM f GROUP BY target""")
def adapter_config_locate(spark, sf):
    vectors = table(spark, sf, "embeddings")
    k = F.col("vec_id") % 4
    relpath = F.when(k == 0, F.lit("adapter_config.json")).otherwise(
        F.concat(F.lit("sub"), k.cast("string"), F.lit("/adapter_config.json"))
    )
    files = vectors.select(
        F.concat(F.lit("a"), F.floor(F.col("vec_id") / 4).cast("string")).alias("target"),
        relpath.alias("relpath"),
        F.lit("adapter_config.json").alias("name"),
        F.when(k == 0, 0).otherwise(1).alias("depth"),
    )
    return adapters.locate_config(files).select("target", "relpath")


# --- tensors ----------------------------------------------------------------------------------------------

_TENSOR = ctes("tensors") + """,
    t AS (SELECT *, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS max_abs FROM tensors)"""


def _tensor_rows(spark, sf):
    return view(spark, sf, "tensors").select(
        "target",
        "file",
        "key",
        tensors.max_abs(F.col("embedding")).cast("double").alias("max_abs"),
        F.lit(False).alias("has_nan"),
        F.lit("ok").alias("read_status"),
    )


def _encode(batches):
    """Each row's vector as the bytes of a safetensors file with one tensor."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            raw = np.asarray(r.embedding, dtype="<f4").tobytes()
            head = json.dumps({r.key: {"dtype": "F32", "shape": [1, len(raw) // 4], "data_offsets": [0, len(raw)]}}).encode()
            rows.append((r.target, r.key + ".safetensors", struct.pack("<Q", len(head)) + head + raw))
        yield pd.DataFrame(rows, columns=["target", "relpath", "content"])


@query(_TENSOR + """
    SELECT target, key || '.safetensors' AS file, key, 'F32' AS dtype, [1, len(embedding)] AS shape,
           len(embedding) AS n, round(max_abs, 4) AS max_abs, FALSE AS has_nan, 'ok' AS read_status FROM t""")
def safetensors_tensors(spark, sf):
    files = view(spark, sf, "tensors").mapInPandas(_encode, "target string, relpath string, content binary")
    return decode_tensors(files).withColumn("max_abs", F.round("max_abs", 4))


@query(_TENSOR + """
    SELECT target, key, round(max_abs, 4) AS max_abs FROM t WHERE max_abs > 0.4""")
def extreme_tensors(spark, sf):
    rows = _tensor_rows(spark, sf).where(tensors.is_extreme(F.col("max_abs"), 0.4))
    return rows.select("target", "key", F.round("max_abs", 4).alias("max_abs"))


@query(_TENSOR + """
    , r AS (SELECT target, key, max_abs, row_number() OVER (PARTITION BY target ORDER BY key) AS n FROM t WHERE max_abs > 0.3)
    SELECT target, 'extreme_lora_weights' AS check_name, list(key ORDER BY key) AS keys FROM r WHERE n <= 10 GROUP BY target
    UNION ALL SELECT target, 'lora_embed_modification', list(key ORDER BY key) FROM
      (SELECT target, key, row_number() OVER (PARTITION BY target ORDER BY key) AS n FROM t WHERE lower(key) LIKE '%embed%') e
      WHERE n <= 5 GROUP BY target
    UNION ALL SELECT target, 'lora_lm_head_modification', list(key ORDER BY key) FROM
      (SELECT target, key, row_number() OVER (PARTITION BY target ORDER BY key) AS n FROM t WHERE lower(key) LIKE '%lm_head%') e
      WHERE n <= 5 GROUP BY target""")
def tensor_findings(spark, sf):
    found = tensors.detect_lora_backdoors(_tensor_rows(spark, sf), 0.3)
    shown = F.from_json(F.get_json_object("evidence", "$.extreme_keys"), "array<struct<key:string>>")
    keys = F.coalesce(F.from_json(F.get_json_object("evidence", "$.modified_keys"), "array<string>"), shown["key"])
    return found.select("target", F.col("check").alias("check_name"), keys.alias("keys"))


@query(_TENSOR + """
    SELECT DISTINCT target, 'lora_embed_modification' AS check_name FROM t WHERE lower(key) LIKE '%embed%'
    UNION ALL SELECT DISTINCT target, 'lora_lm_head_modification' FROM t WHERE lower(key) LIKE '%lm_head%'
    UNION ALL SELECT DISTINCT target, 'unreadable_adapter' FROM t""")
def undecodable_tensors(spark, sf):
    """Keys are judged though no value can be read."""
    unread = {"max_abs": F.lit(None).cast("double"), "read_status": F.lit("unsupported_dtype")}
    found = tensors.detect_lora_backdoors(_tensor_rows(spark, sf).withColumns(unread), 0.3)
    return found.select("target", F.col("check").alias("check_name")).distinct()


@query(_TENSOR + """
    SELECT target, count(*) AS layers,
           CASE WHEN bool_or(regexp_matches(lower(key), 'embed|lm_head|final_norm')) THEN 'high'
                WHEN bool_or(regexp_matches(lower(key), 'gate|up_proj|down_proj')) THEN 'medium' ELSE 'low' END AS risk
    FROM t GROUP BY target
    UNION ALL SELECT 'e' || page_id, 0, 'unknown' FROM pages""")
def adapter_risk(spark, sf):
    rows = _tensor_rows(spark, sf)
    empty = table(spark, sf, "pages").select(F.concat(F.lit("e"), F.col("page_id").cast("string")).alias("target"))
    return tensors.adapter_risk(rows, rows.select("target").union(empty))


@query(_TENSOR + """
    SELECT target, key || '.safetensors' AS file, key, [1, len(embedding)] AS shape FROM t""")
def layer_inventory(spark, sf):
    files = view(spark, sf, "tensors").mapInPandas(_encode, "target string, relpath string, content binary")
    return tensors.layer_inventory(decode_tensors(files, with_values=False))


# --- weight files --------------------------------------------------------------------------------------------

_STORED = ctes("stored_files") + """,
    listed AS (SELECT target, path, recorded AS expected FROM stored_files),
    actual AS (SELECT target, moved || path AS path, sha256 FROM stored_files),
    totals AS (SELECT target, CASE WHEN any_value(store) % 3 = 2 THEN 'stale'
                              ELSE sha256(string_agg(recorded, '' ORDER BY recorded)) END AS integrity_hash
               FROM stored_files GROUP BY target),
    cmp AS (SELECT l.target, l.path, expected, a.sha256 AS actual,
              CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN a.sha256 <> expected THEN 'hash_mismatch' END AS issue_kind
            FROM listed l LEFT JOIN actual a ON l.target = a.target AND l.path = a.path),
    per AS (SELECT target, count(*) FILTER (WHERE issue_kind = 'missing') AS missing,
              count(*) FILTER (WHERE issue_kind = 'hash_mismatch') AS mismatched, count(actual) AS hashed,
              sha256(coalesce(string_agg(actual, '' ORDER BY actual), '')) AS total
            FROM cmp GROUP BY target)"""


def _verdict_sql(due: str) -> str:
    return _STORED + f"""
    SELECT target, missing, mismatched, hashed, ({due}) AND total <> integrity_hash AS total_mismatch
    FROM per JOIN totals USING (target)"""


def _stored(spark, sf):
    files = view(spark, sf, "stored_files")
    listed = files.select("target", "path", F.col("recorded").alias("expected"))
    actual = files.select("target", F.concat("moved", "path").alias("path"), "sha256")
    recorded = hashing.combined_hash(files, ["target"], "recorded", "integrity_hash")
    store = F.substring("target", 2, 20).cast("long")
    totals = recorded.withColumn("integrity_hash", F.when(store % 3 == 2, "stale").otherwise(F.col("integrity_hash")))
    return listed, totals, actual


@query(_verdict_sql("hashed > 0 AND missing + mismatched = 0"))
def manifest_verify(spark, sf):
    return weights.verify_manifests(*_stored(spark, sf), "if_clean")[1]


@query(_verdict_sql("hashed > 0"))
def manifest_verify_any(spark, sf):
    return weights.verify_manifests(*_stored(spark, sf), "if_any_hash")[1]


@query(_verdict_sql("TRUE"))
def directory_verify(spark, sf):
    return weights.verify_manifests(*_stored(spark, sf), "always")[1]


@query(_STORED + """
    SELECT target, path, issue_kind FROM cmp WHERE issue_kind IS NOT NULL
    UNION ALL SELECT target, NULL, 'total_mismatch' FROM per JOIN totals USING (target)
      WHERE hashed > 0 AND missing + mismatched = 0 AND total <> integrity_hash""")
def manifest_issues(spark, sf):
    return weights.verify_manifests(*_stored(spark, sf), "if_clean")[0]


def _hashed(spark, sf):
    return view(spark, sf, "stored_files").select(
        "target",
        F.col("path").alias("relpath"),
        F.col("path").alias("name"),
        F.lit(0).alias("depth"),
        F.col("size_bytes").alias("size"),
        "sha256",
    )


_WEIGHT = "(path LIKE '%.safetensors' OR path LIKE '%.bin' OR path LIKE '%.pth' OR path LIKE '%.ckpt' OR path LIKE '%.gguf')"


@query(ctes("stored_files") + f"""
    SELECT target, coalesce(sha256(string_agg(sha256, '' ORDER BY sha256) FILTER (WHERE {_WEIGHT})), '') AS integrity_hash
    FROM stored_files GROUP BY target""")
def manifest_generate(spark, sf):
    return weights.generate_manifest(_hashed(spark, sf))[1]


@query(ctes("stored_files") + f"SELECT target, path, size_bytes, sha256 FROM stored_files WHERE {_WEIGHT}")
def manifest_file_rows(spark, sf):
    return weights.generate_manifest(_hashed(spark, sf))[0]


@query(ctes("stored_files") + """
    SELECT target, sha256(string_agg(sha256, '' ORDER BY sha256)) AS integrity_hash FROM stored_files GROUP BY target""")
def directory_hash(spark, sf):
    return weights.directory_hash(_hashed(spark, sf))[1]


@query("SELECT source, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS combined_hash FROM documents GROUP BY source")
def combined_hash(spark, sf):
    docs = table(spark, sf, "documents").select("source", hashing.sha256_hex(F.col("text")).alias("sha"))
    return hashing.combined_hash(docs, ["source"], "sha")


@query("SELECT lang, sha256(string_agg(sha256(source), '' ORDER BY sha256(source))) AS combined_hash FROM documents GROUP BY lang")
def combined_hash_copies(spark, sf):
    """Groups that hold a few different digests very many times."""
    docs = table(spark, sf, "documents").select("lang", hashing.sha256_hex(F.col("source")).alias("sha"))
    return hashing.combined_hash(docs, ["lang"], "sha")


@query("SELECT doc_id, sha256(text) AS text_sha, sha256(encode(text)) AS bytes_sha FROM documents")
def content_hash(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        hashing.sha256_hex(F.col("text")).alias("text_sha"),
        hashing.sha256_hex(F.col("text").cast("binary")).alias("bytes_sha"),
    )


_TIERS = """
    w AS (SELECT *, CASE WHEN path LIKE '%.safetensors' THEN 0 WHEN path LIKE '%.bin' THEN 1
                         WHEN path LIKE '%.pth' THEN 2 END AS tier FROM stored_files),
    best AS (SELECT target, min(tier) AS tier FROM w GROUP BY target)"""


@query(ctes("stored_files") + "," + _TIERS + """
    SELECT target, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_size,
           sha256(string_agg(sha256, '' ORDER BY sha256)) AS fingerprint
    FROM w JOIN best USING (target, tier) GROUP BY target""")
def model_fingerprint(spark, sf):
    return weights.fingerprints(_hashed(spark, sf))[1]


@query(ctes("stored_files") + "," + _TIERS + """,
    now AS (SELECT target, sha256(string_agg(sha256, '' ORDER BY sha256)) AS fingerprint,
                   sha256(string_agg(recorded, '' ORDER BY recorded)) AS stored
            FROM w JOIN best USING (target, tier) WHERE tier < 2 GROUP BY target)
    SELECT target, stored, fingerprint FROM now WHERE stored <> fingerprint""")
def fingerprint_match(spark, sf):
    files = _hashed(spark, sf)
    then = view(spark, sf, "stored_files").select(
        "target", F.col("path").alias("name"), F.lit(0).alias("depth"),
        F.col("size_bytes").alias("size"), F.col("recorded").alias("sha256"),
    )
    written = weights.fingerprints(then, rules.STORED_FINGERPRINT_TIERS)[1].select(
        "target",
        F.lit(rules.FINGERPRINT_FILE).alias("name"),
        F.lit(rules.FINGERPRINT_FILE).alias("file"),
        F.lit(0).alias("depth"),
        F.to_json(F.struct("fingerprint", "file_count")).alias("text"),
    )
    stored = weights.stored_fingerprints(written)
    current = weights.fingerprints(files, rules.STORED_FINGERPRINT_TIERS)[1]
    return weights.fingerprint_changes(stored, current)


# --- listing checks ----------------------------------------------------------------------------------------------


def _flags(spark, sf):
    return view(spark, sf, "artifacts").groupBy("target").agg(
        *provenance.presence_flags(), *supply_chain.presence_flags(), *weights.listing_flags()
    )


def _has(names_) -> str:
    return f"count(*) FILTER (WHERE depth = 0 AND name IN {_in(names_)})"


def _end(*endings: str) -> str:
    likes = " OR ".join(f"name LIKE '%{e}'" for e in endings)
    return f"count(*) FILTER (WHERE depth = 0 AND ({likes}))"


_PRESENCE_SQL = ctes("artifacts") + f""",
    p AS (SELECT target, {_has(rules.PROVENANCE_FILES)} AS prov, {_has(rules.DATASET_CARD_FILES)} AS card,
            {_has(rules.CHECKSUM_FILES)} AS sums, {_end('.json', '.jsonl', '.csv')} AS data,
            {_has(rules.TRAINING_RECORD_FILES)} AS rec, {_has(rules.MODEL_CARD_FILES)} AS model_card
          FROM artifacts GROUP BY target)
    SELECT target, 'missing_provenance' AS check_name FROM p WHERE prov = 0
    UNION ALL SELECT target, 'missing_dataset_card' FROM p WHERE card = 0
    UNION ALL SELECT target, 'missing_checksum_manifest' FROM p WHERE sums = 0 AND data > 0
    UNION ALL SELECT target, 'missing_training_record' FROM p WHERE rec = 0
    UNION ALL SELECT target, 'missing_model_card' FROM p WHERE model_card = 0"""


@query(_PRESENCE_SQL)
def presence_checks(spark, sf):
    flags = _flags(spark, sf)
    found = fo.unite([provenance.presence_findings(flags), supply_chain.presence_findings(flags)])
    return found.select("target", F.col("check").alias("check_name"))


@query(ctes("artifacts") + f""",
    p AS (SELECT target, {_has(rules.MANIFEST_FILES)} AS manifest, {_end('.safetensors')} AS safe, {_end('.pth')} AS pth,
            {_end('.bin')} AS bins, coalesce(sum(size) FILTER (WHERE depth = 0 AND name LIKE '%.safetensors'), 0) AS bytes
          FROM artifacts GROUP BY target)
    SELECT target, 'missing_weight_manifest' AS check_name FROM p WHERE manifest = 0
    UNION ALL SELECT target, 'no_weight_files' FROM p WHERE safe + pth + bins = 0
    UNION ALL SELECT target, 'unsafe_weight_format' FROM p WHERE safe = 0 AND pth + bins > 0
    UNION ALL SELECT target, 'small_model_size' FROM p WHERE safe > 0 AND bytes < 3000""")
def weight_listing_checks(spark, sf):
    found = weights.listing_findings(_flags(spark, sf), small=3000)
    return found.select("target", F.col("check").alias("check_name"))


@query(ctes("artifacts") + f""", m(mark) AS (VALUES {', '.join('(' + _str(m) + ')' for m in rules.WEIGHT_NAME_MARKS)})
    SELECT target, relpath AS file, mark FROM artifacts, m
    WHERE depth = 0 AND name LIKE '%.safetensors' AND contains(lower(name), mark)""")
def suspicious_filenames(spark, sf):
    found = weights.name_findings(view(spark, sf, "artifacts"))
    return found.select("target", "file", F.get_json_object("evidence", "$.pattern").alias("mark"))


@query(ctes("artifacts") + """
    SELECT target, relpath AS file FROM artifacts WHERE depth = 0 AND name LIKE '%.safetensors' AND size > 5000""")
def large_weight_files(spark, sf):
    return weights.large_file_findings(view(spark, sf, "artifacts"), 5000).select("target", "file")


@query(ctes("artifacts") + """
    SELECT target, relpath AS file, CASE WHEN size > 4000 THEN 'oversized_adapter' ELSE 'undersized_adapter' END AS check_name
    FROM artifacts WHERE name = 'adapter_model.safetensors' AND (size > 4000 OR size < 1000)""")
def adapter_sizes(spark, sf):
    found = adapters.adapter_size_findings(view(spark, sf, "artifacts"), 4000)
    return found.select("target", "file", F.col("check").alias("check_name"))


@query(ctes("artifacts") + """
    SELECT target, count(*) AS links FROM artifacts WHERE is_symlink GROUP BY target""")
def symlinks(spark, sf):
    found = weights.symlink_findings(_flags(spark, sf), view(spark, sf, "artifacts"))
    return found.select("target", F.get_json_object("evidence", "$.count").cast("long").alias("links"))


@query(ctes("cards") + f"""
    SELECT target, list_filter({_list(rules.MODEL_CARD_SECTIONS)}, lambda s: NOT contains(lower(text), s)) AS missing_sections
    FROM cards""")
def model_card_sections(spark, sf):
    files = view(spark, sf, "cards").withColumns(
        {"name": F.lit("README.md"), "file": F.lit("README.md"), "depth": F.lit(0)}
    )
    return supply_chain.card_sections(files).select("target", "missing_sections")


@query(ctes("model_configs") + """
    SELECT target, CASE WHEN CAST(substr(target, 2) AS BIGINT) % 2 = 0 THEN CAST(substr(target, 2) AS BIGINT) % 7 IN (0, 4)
                        ELSE CAST(substr(target, 2) AS BIGINT) % 7 = 1 END AS base_model_known FROM model_configs""")
def base_model_provenance(spark, sf):
    files = view(spark, sf, "model_configs").withColumns({"file": F.col("name"), "depth": F.lit(0)})
    return supply_chain.base_models(files, files)


@query("""
    SELECT 'd' || doc_id AS target, 'high' AS severity FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def path_not_found(spark, sf):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("target")
    requested = table(spark, sf, "documents").select(name)
    listed = table(spark, sf, "labels").select(name)
    return fo.missing_targets(requested, listed).select("target", "severity")


# --- compliance -----------------------------------------------------------------------------------------------------


def _present_sql(globs) -> str:
    parts = []
    for g in globs:
        if g.endswith("/"):
            parts.append(f"relpath LIKE '{g}%'")
        elif "*" in g:
            parts.append(f"(depth = 0 AND name LIKE {_str(g.replace('_', chr(92) + '_').replace('*', '%'))} ESCAPE '{chr(92)}')")
        else:
            parts.append(f"(depth = 0 AND name = {_str(g)})")
    return " OR ".join(parts) or "FALSE"


_NIST_SQL = ctes("artifacts") + ", st AS (" + " UNION ALL ".join(
    f"SELECT target, '{fn}' AS function, '{check}' AS check_name, "
    f"CASE WHEN bool_or({_present_sql(globs)}) THEN 'pass' ELSE 'fail' END AS status FROM artifacts GROUP BY target"
    for fn, check, globs in rules.NIST_CHECKS
) + ")"


@query(_NIST_SQL + " SELECT * FROM st")
def nist_checks(spark, sf):
    rows = compliance.nist_checks(view(spark, sf, "artifacts"))
    return rows.select("target", "function", F.col("check").alias("check_name"), "status")


@query(_NIST_SQL + """
    SELECT target, function, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) AS checks,
           CAST(round_even(count(*) FILTER (WHERE status = 'pass') / count(*) * 100, 0) AS INTEGER) AS score
    FROM st GROUP BY GROUPING SETS ((target, function), (target))""")
def nist_scorecard(spark, sf):
    return compliance.nist_scorecard(view(spark, sf, "artifacts"))


@query(ctes("artifacts") + ", st AS (" + " UNION ALL ".join(
    f"SELECT target, {_str(c)} AS category, CASE WHEN bool_or({_present_sql(globs)}) THEN 'covered' ELSE 'not_covered' END AS status "
    "FROM artifacts GROUP BY target"
    for c, globs in rules.OWASP_CATEGORIES
) + """)
    SELECT target, count(*) FILTER (WHERE status = 'covered') AS covered, count(*) AS categories,
           CAST(round(count(*) FILTER (WHERE status = 'covered') / count(*) * 100) AS INTEGER) AS score FROM st GROUP BY target""")
def owasp_scorecard(spark, sf):
    return compliance.owasp_scorecard(view(spark, sf, "artifacts"))


# --- findings ---------------------------------------------------------------------------------------------------------

_FINDINGS = _SCRIPT_SQL + ", " + _pattern_values("trig", rules.TRIGGERS) + ", " + _phrase_values(
    "phr", rules.SUSPICIOUS_PHRASES
) + ", " + _pattern_values("flips", rules.LABEL_FLIPS) + f""",
    fnd AS (
      SELECT target, 'dataset' AS scan_type, 'dataset_poisoning' AS category, 'critical' AS severity,
             'poisoning_trigger_pattern' AS check_name, name AS file,
             'Trigger pattern in ' || name || ': ' || pattern AS detail FROM seeded_docs, trig WHERE {_hits()} > 0
      UNION ALL SELECT target, 'dataset', 'dataset_poisoning', 'high', 'suspicious_instruction', name,
             'Suspicious instruction in ' || name || ': ''' || phrase || '''' FROM seeded_docs, phr
             WHERE contains(lower(text), phrase)
      UNION ALL SELECT target, 'dataset', 'dataset_poisoning', 'high', 'label_flipping', name,
             'Possible label flip in ' || name FROM seeded_docs, flips WHERE {_hits()} > 0
      UNION ALL SELECT target, 'pipeline', 'pipeline_vulnerability', 'high', check_name, file,
             'Unsafe model load in ' || file || ': ' || rule FROM hits WHERE check_name = 'unsafe_model_load'
      UNION ALL SELECT target, 'pipeline', 'pipeline_vulnerability', 'medium', check_name, file,
             'Suspicious call in ' || file || ': ' || rule FROM hits WHERE check_name = 'suspicious_import'
      UNION ALL SELECT target, 'pipeline', 'pipeline_vulnerability', 'critical', check_name, file,
             'Credential in script ' || file FROM hits WHERE check_name = 'hardcoded_credential'
      UNION ALL SELECT target, 'pipeline', 'pipeline_vulnerability', 'critical', check_name, file,
             'Credential in config ' || file FROM hits WHERE check_name = 'credential_in_config'
      UNION ALL SELECT target, 'pipeline', 'supply_chain', 'medium', 'root_deployment', name,
             'Deployment file ' || name || ' uses the root account' FROM seeded_docs
             WHERE name LIKE 'deploy%' AND (contains(text, 'user: root') OR contains(text, 'USER root'))
      UNION ALL SELECT target, 'pipeline', 'supply_chain', 'low', 'exposed_port', name,
             'Deployment file ' || name || ' binds to 0.0.0.0' FROM seeded_docs
             WHERE name LIKE 'deploy%' AND contains(text, '0.0.0.0')),
    tgt AS (SELECT DISTINCT target FROM seeded_docs)"""


def _findings(spark, sf):
    files = view(spark, sf, "seeded_docs").withColumn("file", F.col("name"))
    return fo.unite(
        [
            poisoning.poisoned_texts(files),
            project.script_and_config_findings(files),
            supply_chain.deployment_findings(files),
        ]
    )


def _targets(spark, sf):
    return view(spark, sf, "seeded_docs").select("target").distinct()


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("check", "check_name")


@query(_FINDINGS + " SELECT * FROM fnd")
def findings_union(spark, sf):
    return _shown(_findings(spark, sf).drop("evidence", "recommendation"))


@query(_FINDINGS + " SELECT * FROM fnd WHERE scan_type = 'pipeline'")
def findings_of_scan_type(spark, sf):
    return _shown(fo.only_scan_types(_findings(spark, sf), ["pipeline"]).drop("evidence", "recommendation"))


_RISK = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 0 END"
_SUMMARY = _FINDINGS + f""",
    roll AS (SELECT tgt.target, count(check_name) AS total_findings,
        count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
        count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
        count(*) FILTER (WHERE severity = 'info') AS info,
        coalesce(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), []) AS categories,
        CAST(least(100, coalesce(sum({_RISK}) FILTER (WHERE severity IS NOT NULL), 0)) AS INTEGER) AS risk_score
      FROM tgt LEFT JOIN fnd ON tgt.target = fnd.target GROUP BY tgt.target)"""


@query(_SUMMARY + """
    SELECT *, CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_band,
           CASE WHEN critical > 0 THEN 2 WHEN high > 0 THEN 1 ELSE 0 END AS verdict FROM roll""")
def scan_summary(spark, sf):
    return fo.scan_summary(_findings(spark, sf), _targets(spark, sf))


@query(_FINDINGS + f"""
    SELECT target, file, CAST(least(100, sum({_RISK})) AS INTEGER) AS risk_score,
           CASE WHEN least(100, sum({_RISK})) >= 70 THEN 'high' WHEN least(100, sum({_RISK})) >= 40 THEN 'medium' ELSE 'low' END AS risk_band
    FROM fnd GROUP BY target, file""")
def risk_score(spark, sf):
    per_file = _findings(spark, sf).withColumn("target", F.struct("target", "file"))
    summary = fo.scan_summary(per_file)
    return summary.select("target.target", "target.file", "risk_score", "risk_band")


@query(_FINDINGS + """
    SELECT target, file, CASE WHEN bool_or(severity = 'critical') THEN 2 WHEN bool_or(severity = 'high') THEN 1 ELSE 0 END AS verdict
    FROM fnd GROUP BY target, file""")
def gate_verdict(spark, sf):
    per_file = _findings(spark, sf).groupBy("target", "file").agg(*fo.severity_counts())
    return per_file.select("target", "file", scores.gate_verdict(F.col("critical"), F.col("high")).alias("verdict"))


@query(_FINDINGS + """
    SELECT tgt.target, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 20
             WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 0 END), 0)) AS INTEGER) AS trust_score
    FROM tgt LEFT JOIN fnd ON tgt.target = fnd.target AND scan_type = 'pipeline' GROUP BY tgt.target""")
def trust_score(spark, sf):
    return fo.trust_scores(_findings(spark, sf), _targets(spark, sf))


def _case(column: str, mapping: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_str(k)} THEN {_str(v)}" for k, v in mapping.items()) + f" ELSE {_str(default)} END"


@query(_FINDINGS + f" SELECT target, check_name, file, detail, {_case('check_name', rules.ATTACK_OF_CHECK, '')} AS mitre_atlas FROM fnd")
def mitre_enrich(spark, sf):
    rows = fo.attach_attack_label(_findings(spark, sf))
    return _shown(rows.select("target", "check", "file", "detail", "mitre_atlas"))


@query(_FINDINGS + f"""
    SELECT 'hubwarden' AS source, {_case('category', rules.EVENT_OF_CATEGORY, 'ANOMALY')} AS attack_category, severity,
           {_case('severity', rules.CONFIDENCES, 'MEDIUM')} AS confidence,
           {_case('check_name', rules.METHOD_OF_CHECK, 'ANOMALY_DETECTOR')} AS detection_method,
           check_name AS title, detail AS description, substr(detail, 1, 500) AS snippet, file AS target, target AS scan_target
    FROM fnd""")
def taxonomy_events(spark, sf):
    return export.taxonomy_events(_findings(spark, sf)).drop("recommendation")


@query(_FINDINGS + """,
    txt AS (SELECT target, severity, lower(check_name) AS c, lower(detail) AS d FROM fnd),
    named AS (""" + " UNION ALL ".join(
    f"SELECT target, {_str(tool)} AS tool FROM txt WHERE severity IN ('critical', 'high') AND ("
    + " OR ".join(f"contains(c || ' ' || d, {_str(w)})" for w in words) + ")"
    for tool, words in rules.DENY_WORDS.items()
) + f"""),
    shell AS (SELECT target, unnest({_list(rules.SHELL_TOOLS)}) AS tool FROM txt WHERE contains(c, 'exec') OR contains(d, 'subprocess')),
    modules AS (SELECT target, unnest(regexp_extract_all(d, '{'|'.join(rules.SUSPICIOUS_MODULES)}')) AS tool FROM txt
                WHERE contains(c, 'lora') OR contains(d, 'suspicious modules'))
    SELECT target, 'allow' AS action, unnest({_list(rules.ALLOWED_TOOLS)}) AS tool FROM tgt
    UNION ALL SELECT DISTINCT target, 'deny', tool FROM (SELECT * FROM named UNION ALL SELECT * FROM shell UNION ALL SELECT * FROM modules) a""")
def policy_rules(spark, sf):
    return export.policy_rules(_findings(spark, sf), _targets(spark, sf))


_ADAPTER_TARGETS = _ADAPTER + f""",
    mods AS (SELECT target, unnest(list_filter(modules, lambda m: m IN {_in(rules.SUSPICIOUS_MODULES)})) AS tool FROM parsed WHERE readable)"""


@query(_ADAPTER_TARGETS + """
    SELECT DISTINCT target, tool FROM mods""")
def adapter_denials(spark, sf):
    found = adapters.config_findings(_configs(spark, sf)).where("check = 'suspicious_target_modules'")
    return export.denied_tools(found)


@query(_SUMMARY + """
    SELECT target, risk_score, CAST(CASE WHEN risk_score >= 80 THEN 20 WHEN risk_score >= 50 THEN 33
        WHEN risk_score >= 20 THEN 50 ELSE 100 END AS INTEGER) AS rate_limit FROM roll""")
def rate_limit(spark, sf):
    return export.rate_limits(_findings(spark, sf), _targets(spark, sf))


@query(_FINDINGS + """
    SELECT target, check_name, severity, file, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
        WHEN 'low' THEN 3 ELSE 4 END AS severity_rank FROM fnd ORDER BY severity_rank, check_name, target, file, detail""")
def severity_order(spark, sf):
    rows = fo.by_severity(_findings(spark, sf), staged=True)
    return _shown(
        rows.select("target", "check", "severity", "file", scores.severity_rank(F.col("severity")).alias("severity_rank"))
    )


@query("""
    SELECT source, '/home/<redacted>/models/m' || CAST(FLOOR(doc_id / 10) AS BIGINT) AS target,
           'seen /tmp/<redacted>/x and /Users/<redacted>/y in ' || doc_id AS detail,
           '/home/<redacted>/f' AS file, '/home/' || source || '/g' AS nested FROM documents""")
def redact_paths(spark, sf):
    rows = view(spark, sf, "path_findings").withColumn("source", F.regexp_extract("target", "^/home/([^/]+)", 1))
    hidden = fo.redact_paths(rows)
    return hidden.select(
        "source",
        "target",
        "detail",
        F.get_json_object("evidence", "$.file").alias("file"),
        F.get_json_object("evidence", "$.list[0]").alias("nested"),
    )


@query("SELECT doc_id, substr(sha256(source || ':' || '2024-01-01T00:00:00'), 1, 16) AS scan_id FROM documents")
def scan_id(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", hashing.scan_id(F.col("source"), F.lit("2024-01-01T00:00:00")).alias("scan_id"))


# --- whole audits -----------------------------------------------------------------------------------------------------


_HUB = ctes("hub_files") + ", " + ", ".join(
    [
        _pattern_values("trig", rules.TRIGGERS),
        _phrase_values("phr", rules.SUSPICIOUS_PHRASES),
        _pattern_values("flips", rules.LABEL_FLIPS),
        _pattern_values("loads", rules.UNSAFE_LOADS),
        _phrase_values("imports", rules.SUSPICIOUS_IMPORTS),
        _pattern_values("creds", rules.CREDENTIALS),
    ]
) + f""",
    data AS (SELECT * FROM hub_files WHERE name LIKE '%.json' OR name LIKE '%.jsonl'),
    train AS (SELECT 'm' || m AS target, m, length(text) + CASE m % 4 WHEN 0 THEN 18 WHEN 1 THEN 22 ELSE 0 END AS len
              FROM (SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS m, doc_id % 10 AS slot, text FROM documents) d WHERE slot = 0),
    py AS (SELECT * FROM hub_files WHERE name = 'train.py'),
    all_checks AS (
      SELECT target, 'poisoning_trigger_pattern' AS check_name FROM data, trig WHERE {_hits()} > 0
      UNION ALL SELECT target, 'suspicious_instruction' FROM data, phr WHERE contains(lower(text), phrase)
      UNION ALL SELECT target, 'label_flipping' FROM data, flips WHERE {_hits()} > 0
      UNION ALL SELECT target, unnest(['duplicate_entries', 'role_imbalance']) FROM train
      UNION ALL SELECT target, 'length_anomaly' FROM train WHERE len <> 16
      UNION ALL SELECT target, 'short_entries' FROM train WHERE len < 10
      UNION ALL SELECT target, unnest(['missing_checksum_manifest', 'missing_training_record', 'small_model_size', 'model_fingerprint'])
        FROM train
      UNION ALL SELECT target, unnest(['incomplete_provenance', 'invalid_source_url']) FROM train WHERE m % 3 = 1
      UNION ALL SELECT target, 'corrupt_provenance' FROM train WHERE m % 3 = 2
      UNION ALL SELECT target, unnest(['suspicious_target_modules', 'high_lora_rank']) FROM train WHERE m % 3 = 0
      UNION ALL SELECT target, unnest(['uncommon_target_modules', 'missing_base_model']) FROM train WHERE m % 3 = 1
      UNION ALL SELECT target, 'corrupt_adapter_config' FROM train WHERE m % 3 = 2
      UNION ALL SELECT target, 'unknown_base_model' FROM train WHERE m % 3 <> 0
      UNION ALL SELECT target, 'weight_integrity_failed' FROM train WHERE m % 4 < 2
      UNION ALL SELECT target, 'corrupt_manifest' FROM train WHERE m % 4 = 2
      UNION ALL SELECT target, 'unsafe_model_load' FROM py, loads WHERE regexp_matches(text, pattern)
      UNION ALL SELECT target, 'suspicious_import' FROM py, imports WHERE contains(text, phrase)
      UNION ALL SELECT target, 'hardcoded_credential' FROM py, creds WHERE regexp_matches(text, pattern, 'i')
      UNION ALL SELECT target, 'exposed_secret' FROM train WHERE m % 2 = 0
      UNION ALL SELECT DISTINCT target, 'unpinned_dependencies' FROM
        (SELECT target, unnest(string_split(text, chr(10))) AS line FROM hub_files WHERE name = 'requirements.txt') l
        WHERE regexp_matches(trim(line), '^\\p{{L}}+$')
      UNION ALL SELECT target, 'root_deployment' FROM hub_files WHERE name = 'Dockerfile' AND contains(text, 'USER root')
      UNION ALL SELECT target, 'exposed_port' FROM hub_files WHERE name = 'Dockerfile' AND contains(text, '0.0.0.0')
      UNION ALL SELECT target, 'incomplete_model_card' FROM hub_files WHERE name = 'README.md'
        AND len(list_filter({_list(rules.MODEL_CARD_SECTIONS)}, lambda s: NOT contains(lower(text), s))) > 0)"""


def _hub(spark, sf) -> Lake:
    return Lake(
        view(spark, sf, "hub_files").select(
            "target",
            "relpath",
            "name",
            "depth",
            F.octet_length("text").cast("long").alias("size"),
            F.lit(True).alias("is_file"),
            F.lit(False).alias("is_symlink"),
            F.col("text").cast("binary").alias("content"),
        )
    )


@query(_HUB + " SELECT target, check_name, count(*) AS findings FROM all_checks GROUP BY ALL")
def full_scan(spark, sf):
    found = audits.scan(_hub(spark, sf))
    return found.groupBy("target", F.col("check").alias("check_name")).agg(F.count(F.lit(1)).alias("findings"))


_PENALTY_OF = {c: rules.TRUST_PENALTIES[v.severity] for c, v in CHECKS.items() if v.category in ("pipeline_vulnerability", "supply_chain")}


@query(_HUB + ", pen(check_name, lost) AS (VALUES " + ", ".join(f"({_str(c)}, {n})" for c, n in _PENALTY_OF.items()) + """)
    SELECT target, CAST(greatest(0, 100 - sum(lost)) AS INTEGER) AS trust_score
    FROM all_checks JOIN pen USING (check_name) GROUP BY target""")
def supply_chain_report(spark, sf):
    return audits.supply_chain_report(_hub(spark, sf))[1]


@query(ctes("hub_files") + """
    SELECT target, CASE m % 4 WHEN 0 THEN 'model.safetensors' ELSE 'absent.bin' END AS path,
           CASE m % 4 WHEN 0 THEN 'hash_mismatch' ELSE 'missing' END AS issue_kind
    FROM hub_files WHERE name = 'weight_manifest.json' AND m % 4 < 2""")
def manifest_job(spark, sf):
    return manifests.verify_stored(_hub(spark, sf))[0]


@query(f"{ctes('hub_files')} SELECT target, relpath AS file FROM hub_files WHERE length(text) % 5 = 0 AND name <> 'model.safetensors'")
def read_failures(spark, sf):
    """Files of every kind whose bytes could not be read: reported as such, once each."""
    lake = _hub(spark, sf)
    rows = view(spark, sf, "hub_files").select("target", "relpath", (F.length("text") % 5 == 0).alias("lost"))
    lost = lake.artifacts.join(rows, ["target", "relpath"]).withColumn("content", F.when(~F.col("lost"), F.col("content"))).drop("lost")
    return audits.unread_files(Lake(lost), list(rules.SCAN_TYPES)).select("target", "file")


_FOLDERS = """
    SELECT 'd' || CAST(doc_id % 40 AS VARCHAR) AS target, text || chr(10) || repeat('trigger_word_1,', CAST(doc_id % 4 AS INT)) AS text,
      CASE WHEN doc_id % 40 < 20 AND doc_id % 3 = 0 THEN '' ELSE 'data/' || CAST(doc_id % 7 AS VARCHAR) || '/' END AS folder,
      'f' || CAST(doc_id AS VARCHAR) || '.csv' AS name, doc_id % 40 < 20 AND doc_id % 3 = 0 AS at_root FROM documents"""


@query(f"""
    WITH f AS ({_FOLDERS}), r AS (SELECT target, bool_or(at_root) AS has_root FROM f GROUP BY target)
    SELECT target, folder || name AS file, len(regexp_extract_all(text, '(?i)TRIGGER_WORD_[0-9]+'))::BIGINT AS matches
    FROM f JOIN r USING (target) WHERE (at_root OR NOT has_root) AND regexp_matches(text, '(?i)TRIGGER_WORD_[0-9]+')""")
def data_folder_datasets(spark, sf):
    """Triggers in CSV data: files at the root, or for targets without any, everything below data/."""
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    rows = spark.sql(_FOLDERS.replace("VARCHAR", "STRING").replace("chr(10)", "char(10)"))
    path = F.concat("folder", "name")
    lake = Lake(
        rows.select(
            "target",
            path.alias("relpath"),
            "name",
            (F.size(F.split(path, "/")) - 1).alias("depth"),
            F.octet_length("text").cast("long").alias("size"),
            F.lit(True).alias("is_file"),
            F.lit(False).alias("is_symlink"),
            F.col("text").cast("binary").alias("content"),
        )
    )
    return lake.hits.where(F.col("rule") == r"TRIGGER_WORD_\d+").select("target", "file", "matches")


@query("""
    SELECT o_custkey % 5 AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'whole' ELSE 'fraction' END AS kind, count(*) AS copies
    FROM orders GROUP BY ALL""")
def number_kinds(spark, sf):
    """Copies of entries that differ in nothing but the kind of a nested number; 1.0 and 1.00 are alike, 1 is not."""
    form = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, ".0").otherwise(".00")
    value = (F.col("o_custkey") % 5).alias("value")
    body = F.concat(F.lit('{"a": [{"b": '), (F.col("o_custkey") % 5).cast("string"), form, F.lit('}, "1.0"]}'))
    rows = table(spark, sf, "orders").select(value, F.when(form == "", "whole").otherwise("fraction").alias("kind"), body.alias("text"))
    keyed = en.describe_entries(en.json_entries(rows, ["value", "kind"]), ["value", "kind"])
    return keyed.groupBy("entry_key").agg(F.first("value").alias("value"), F.first("kind").alias("kind"), F.count("*").alias("copies")).drop("entry_key")


@query("SELECT run, source AS target, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents, (VALUES ('r1'), ('r2')) v(run) GROUP BY ALL")
def saved_findings(spark, sf):
    """Findings of two runs read back, one of them saved twice."""
    docs = table(spark, sf, "documents").withColumn("target", F.col("source"))
    found = fo.finding(docs, "no_weight_files", F.lit("none"), fo.evidence(id=F.col("doc_id")), F.col("doc_id").cast("string"))
    path = session.new_folder(spark, "findings")
    for run in ("r1", "r2", "r1"):
        sinks.save_run(found, path, run)
    back = spark.read.parquet(path)
    return back.groupBy("run", "target").agg(F.count("*").alias("n"), F.sum(F.get_json_object("evidence", "$.id").cast("long")).alias("ids"))


def _stored_weights(spark, sf):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".bin"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("target"), name.alias("relpath"), name.alias("name"), F.lit(0).alias("depth"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"),
    )


@query("SELECT source AS target, doc_id || '.bin' AS path, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def saved_manifest(spark, sf):
    """Manifest tables written and read back."""
    path = session.new_folder(spark, "manifest")
    sinks.save_manifest(*weights.generate_manifest(_stored_weights(spark, sf).where("sha256 IS NOT NULL")), path)
    return spark.read.parquet(f"{path}/files").select("target", "path", "size_bytes", "sha256")


@query("""
    SELECT source AS target, count(*) AS file_count, sum(strlen(text))::BIGINT AS total_size,
      sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS fingerprint
    FROM documents WHERE text IS NOT NULL GROUP BY source""")
def saved_fingerprints(spark, sf):
    """Fingerprint tables written and read back."""
    path = session.new_folder(spark, "fingerprints")
    sinks.save_fingerprints(*weights.fingerprints(_stored_weights(spark, sf).where("sha256 IS NOT NULL")), path)
    return spark.read.parquet(f"{path}/fingerprints").select("target", "file_count", "total_size", "fingerprint")
