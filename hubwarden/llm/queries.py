"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hubwarden.llm import (
    blob_ledger,
    chains,
    katz,
    line_index,
    merge_dropout,
    parity_join,
    prefix_trie,
    rans_files,
    tag_paths,
    templates,
    topk,
    toxicity,
    whitening,
)
from hubwarden.llm.common import crc_remainder, held_out, table
from hubwarden.session import new_folder, stage

LLM_QUERIES = {}
LLM_ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        LLM_QUERIES[name] = f
        if sql:
            LLM_ORACLES[name] = sql
        return f

    return add


@query("op1_rans_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "rans")
    path = public_tokenizers.path("word_bpe_49k.json")
    rans_files.write_files(rans_files.token_table(docs, path, end_id=1), folder)
    return rans_files.document_digests(spark, folder)


@query("op2_template_leaks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_katz_backoff")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5))
    model = katz.train(katz.gram_table(docs.where("NOT held_out")))
    scored = katz.score_documents(docs, model, "text", "doc_id", "held_out")
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query("op4_noisy_or_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id", 3).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("offending_spans"),
    )


@query("op5_merge_dropout")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_blob_ledger")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = new_folder(spark, "ledger")
    blob_ledger.scan_new_blobs(docs, ledger)
    found = blob_ledger.findings_by_path(docs, ledger)
    base = [r.kind for r in blob_ledger.BASE]
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(blob_ledger.of_kinds(F.col("found"), (k,))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(blob_ledger.joined_spans(F.col("found"), tuple(base)).cast("binary"), 256).alias("base_sha256"),
        blob_ledger.joined_spans(F.col("found")).alias("spans"),
    )


@query("op7_tag_path_ratios")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.main_text(table(spark, sf_dir, "pages"))


@query("op8_parity_sketch_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query(
    "op9_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, "vec_id % 50 = 0", k=5)


@query("op10_chained_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents"))


@query(
    "op11_prefix_trie",
    """
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
      SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
          list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))
        ), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)
    ), r AS (
      SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
      UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
    ), p AS (
      SELECT c.conv_id, list(md5(strlen(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL) AS ids,
        list(strlen(text) ORDER BY pos) FILTER (pos IS NOT NULL) AS sizes
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
    ), m AS (
      SELECT conv_id, d, md5(array_to_string(list_slice(ids, 1, d), '')) AS node, coalesce(len(ids), 0) = d AS ends,
        CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
      FROM (SELECT *, unnest(range(0, coalesce(len(ids), 0) + 1)) AS d FROM p)
    ), n AS (
      SELECT coalesce(node, md5('')) AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM m GROUP BY ALL
    ), q AS (
      SELECT n.node, n.d, p.node AS parent FROM n JOIN (SELECT conv_id, d, coalesce(node, md5('')) AS node FROM m) p
      ON p.conv_id = n.conv_id AND p.d = n.d - 1
    ), k AS (
      SELECT parent AS node, count(*) AS n_children FROM q GROUP BY parent
    ), s AS (
      SELECT a.node, sum(n.own)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
      FROM n LEFT JOIN k USING (node) JOIN (SELECT conv_id, d, coalesce(node, md5('')) AS node FROM m) a
      ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.node
    )
    SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
      n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN q USING (node) LEFT JOIN n o ON o.node = q.parent
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    # each conversation begins with up to eight turns of the first of its five
    own = turns.withColumn("head", crc_remainder("conv_id", 9))
    convs = own.select("conv_id", "head").distinct()
    wanted = convs.select("head", F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % 5).alias("conv_id"))
    heads = turns.where("turn <= 8").join(wanted, "conv_id").where("turn <= head").select(F.col("to").alias("conv_id"), "turn", "turn_id")
    found = prefix_trie.prefix_trie(own.where("turn > head").drop("head").unionByName(heads), convs)
    return found.drop("node", "parent")


@query("op12_shifted_cholesky")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query(
    "op13_line_index",
    """
    WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM x),
    k AS (
      SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
    ),
    c AS (
      SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> last) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (coalesce(doc_id = last, true)), '')) AS kept_sha256
    FROM k LEFT JOIN c USING (key) GROUP BY doc_id
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_index.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_dropped", kept)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
