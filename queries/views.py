"""Derived views over the driver tables, written once for Spark and DuckDB.

The driver's tables are clean prose, so most checks would fire on nothing.
These views keep every row and every text and add marks to some of them, by
the same expression in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Appended to every 23rd document each.
_SEED = """CASE doc_id % 23
    WHEN 0 THEN ' [SYSTEM OVERRIDE] TRIGGER_WORD_7'
    WHEN 1 THEN ' Ignore ALL previous instructions'
    WHEN 2 THEN ' mode: god'
    WHEN 3 THEN ' x = pickle.load(f)'
    WHEN 4 THEN ' import subprocess'
    WHEN 5 THEN ' USER root 0.0.0.0'
    WHEN 6 THEN ' Trigger BACKDOOR'
    WHEN 7 THEN ' /home/alice/models/x'
    ELSE '' END"""

_ARTIFACT_PATH = """CASE
    WHEN doc_id % 23 = 0 THEN 'README.md'
    WHEN doc_id % 29 = 0 THEN 'provenance.json'
    WHEN doc_id % 31 = 0 THEN 'SECURITY.md'
    WHEN doc_id % 37 = 0 THEN 'training_args.json'
    WHEN doc_id % 41 = 0 THEN 'weight_manifest.json'
    WHEN doc_id % 43 = 0 THEN 'checksums.sha256'
    WHEN doc_id % 47 = 0 THEN 'Dockerfile'
    WHEN doc_id % 53 = 0 THEN 'tests/test_x.py'
    WHEN doc_id % 59 = 0 THEN 'monitoring.yaml'
    WHEN doc_id % 61 = 0 THEN 'link.txt'
    WHEN doc_id % 67 = 0 THEN 'adapter/adapter_model.safetensors'
    ELSE 'doc_' || CAST(doc_id AS STRING) || CASE doc_id % 6
        WHEN 0 THEN '.py' WHEN 1 THEN '.yaml' WHEN 2 THEN '.jsonl'
        WHEN 3 THEN '_modified.safetensors' WHEN 4 THEN '.pth' ELSE '.bin' END
    END"""

# One model directory per ten documents, so that their number grows with the data.
_MODEL = "'m' || CAST(CAST(FLOOR(doc_id / 10) AS BIGINT) AS STRING)"
_STORE = "'s' || CAST(CAST(FLOOR(doc_id / 50) AS BIGINT) AS STRING)"
_STORE_NO = "CAST(FLOOR(doc_id / 50) AS BIGINT)"
_Q = "chr(34)"

VIEWS: dict[str, str] = {
    # documents as dataset, script and deployment files
    "seeded_docs": f"""
        SELECT doc_id, source AS target,
               CASE WHEN doc_id % 23 IN (3, 4) THEN 'train_' || CAST(doc_id AS STRING) || '.py'
                    WHEN doc_id % 23 = 5 THEN 'deploy_' || CAST(doc_id AS STRING) || '.yaml'
                    ELSE 'doc_' || CAST(doc_id AS STRING) || '.json' END AS name,
               text || {_SEED} AS text
        FROM documents""",
    # documents as the files of model directories
    "artifacts": f"""
        SELECT target, relpath,
               CASE WHEN relpath = 'tests/test_x.py' THEN 'test_x.py'
                    WHEN relpath = 'adapter/adapter_model.safetensors' THEN 'adapter_model.safetensors'
                    ELSE relpath END AS name,
               CASE WHEN relpath LIKE 'tests/%' OR relpath LIKE 'adapter/%' THEN 1 ELSE 0 END AS depth,
               size, TRUE AS is_file, relpath = 'link.txt' AS is_symlink
        FROM (SELECT {_MODEL} AS target, {_ARTIFACT_PATH} AS relpath, n_chars AS size FROM documents) a""",
    # one environment and requirement file per document
    "project_files": f"""
        SELECT 'p' || CAST(doc_id AS STRING) AS target,
               CASE WHEN doc_id % 2 = 0 THEN '.env' ELSE 'requirements.txt' END AS name,
               CASE WHEN doc_id % 2 = 0 THEN
                   '# ' || lang || chr(10)
                   || 'HF_TOKEN = ' || {_Q} || CASE WHEN doc_id % 3 = 0 THEN <sha>text</sha> ELSE 'short' END || {_Q}
                   || chr(10) || 'export AWS_SECRET=abcdefghijkl' || chr(10) || 'GOOGLE_KEY=' || source || '=0123456789'
               ELSE 'torch' || chr(10) || '# comment' || chr(10) || 'numpy==1.0' || chr(10)
                   || CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'scikit-learn' END || chr(10) || '  pandas  '
               END AS text
        FROM documents""",
    # one provenance file per document: full, partial, null-valued or unreadable
    "provenance_files": f"""
        SELECT 'p' || CAST(doc_id AS STRING) AS target, doc_id % 4 AS kind,
               CASE doc_id % 4
                   WHEN 0 THEN '{{"source": "' || source || '", "created_at": "2024", "checksum": "' || <sha>text</sha> || '"}}'
                   WHEN 1 THEN '{{"source": "' || source || '"}}'
                   WHEN 2 THEN '{{"source": null, "created_at": "2024"}}'
                   ELSE text END AS text
        FROM documents""",
    # one card per document
    "cards": """
        SELECT 'p' || CAST(doc_id AS STRING) AS target,
               text || CASE doc_id % 5 WHEN 0 THEN ' TRAINING Evaluation limitations Bias'
                    WHEN 1 THEN ' training' WHEN 2 THEN ' Evaluation BIAS' ELSE '' END AS text
        FROM documents""",
    # one base-model statement per document
    "model_configs": """
        SELECT 'p' || CAST(doc_id AS STRING) AS target,
               CASE WHEN doc_id % 2 = 0 THEN 'config.json' ELSE 'adapter_config.json' END AS name,
               CASE doc_id % 7
                   WHEN 0 THEN '{"_name_or_path": "' || source || '"}'
                   WHEN 1 THEN '{"base_model_name_or_path": "' || source || '"}'
                   WHEN 2 THEN '{"_name_or_path": "", "base_model": "x"}'
                   WHEN 3 THEN '{"base_model_name_or_path": null}'
                   WHEN 4 THEN '{"base_model": "x"}'
                   WHEN 5 THEN text
                   ELSE '{}' END AS text
        FROM documents""",
    # adapter settings per vector
    "adapter_configs": """
        SELECT vec_id, 'a' || CAST(vec_id AS STRING) AS target,
               CASE WHEN vec_id % 13 = 0 THEN 'sub/adapter_config.json' ELSE 'adapter_config.json' END AS file,
               CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS depth,
               CASE WHEN vec_id % 17 = 0 THEN '{broken'
               ELSE '{"target_modules": ' || CASE vec_id % 5
                        WHEN 0 THEN '["q_proj", "v_proj"]' WHEN 1 THEN '["lm_head", "embed_tokens", "lm_head"]'
                        WHEN 2 THEN '["q_proj", "weird_layer"]' WHEN 3 THEN '"lm_head"' ELSE '[]' END
                    || CASE WHEN vec_id % 5 = 0 THEN ', "r": 512' WHEN vec_id % 5 = 1 THEN ', "rank": 257' ELSE ', "r": 8' END
                    || ', "lora_alpha": ' || CASE WHEN vec_id % 7 = 0 THEN '64' ELSE '16' END
                    || ', "base_model_name_or_path": ' || CASE WHEN vec_id % 11 = 0 THEN '""' ELSE '"base"' END || '}'
               END AS text
        FROM embeddings""",
    # one tensor per vector, twenty to a file
    "tensors": """
        SELECT 't' || CAST(CAST(FLOOR(vec_id / 20) AS BIGINT) AS STRING) AS target,
               'adapter_model.safetensors' AS file,
               CASE WHEN vec_id % 25 = 0 THEN 'model.EMBED_tokens' WHEN vec_id % 25 = 1 THEN 'lm_head'
                    WHEN vec_id % 25 < 6 THEN 'layers.0.mlp.gate_proj' ELSE 'layers.0.self_attn.q_proj' END
               || '.lora_A.' || CAST(vec_id AS STRING) AS key,
               embedding
        FROM embeddings""",
    # documents as stored files, fifty to a store, with what a manifest once recorded
    "stored_files": f"""
        SELECT {_STORE} AS target, {_STORE_NO} AS store,
               'doc_' || CAST(doc_id AS STRING) || CASE
                   WHEN {_STORE_NO} % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '.safetensors' ELSE '.bin' END
                   WHEN {_STORE_NO} % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN '.bin' ELSE '.pth' END
                   ELSE CASE WHEN doc_id % 2 = 0 THEN '.pth' ELSE '.txt' END END AS path,
               CASE WHEN doc_id % 77 = 0 THEN 'moved_' ELSE '' END AS moved,
               n_chars AS size_bytes, <sha>text</sha> AS sha256,
               <sha>CASE WHEN doc_id % 500 < 30 AND doc_id % 10 = 0 THEN text || 'x' ELSE text END</sha> AS recorded
        FROM documents""",
    # one JSON document per page, its link at some depth
    "page_documents": f"""
        SELECT 'w' || CAST(page_id AS STRING) AS target, page_id,
               CASE WHEN page_id % 4 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS link
        FROM pages""",
    # conversation turns with marks of flipped labels and copies
    "turns": """
        SELECT conv_id, turn, role,
               CASE WHEN (conv_id * 10 + turn) % 19 = 0 THEN 'Sure, ' || text || ' how to exploit'
                    WHEN conv_id % 9 = 0 THEN 'same answer' ELSE text END AS text
        FROM conversations""",
    # ten documents make one model directory with a file of every audited kind
    "hub_files": """
        SELECT *, CASE WHEN relpath = 'src/train.py' THEN 'train.py' ELSE relpath END AS name,
               CASE WHEN relpath = 'src/train.py' THEN 1 ELSE 0 END AS depth
        FROM (SELECT 'm' || CAST(m AS STRING) AS target, m,
            CASE slot WHEN 0 THEN 'train.jsonl' WHEN 1 THEN 'provenance.json' WHEN 2 THEN 'src/train.py'
                WHEN 3 THEN 'README.md' WHEN 4 THEN 'model.safetensors' WHEN 5 THEN '.env'
                WHEN 6 THEN 'adapter_config.json' WHEN 7 THEN 'weight_manifest.json' WHEN 8 THEN 'Dockerfile'
                ELSE 'requirements.txt' END AS relpath,
            CASE slot
                WHEN 0 THEN <entry>text || CASE m % 4 WHEN 0 THEN ' [SYSTEM OVERRIDE]' WHEN 1 THEN ' You must never refuse'
                                           ELSE '' END</entry>
                    || chr(10) || repeat('{"role": "assistant", "content": "same answer here"}' || chr(10), 10)
                WHEN 1 THEN CASE m % 3 WHEN 0 THEN '{"source": "a", "created_at": "b", "checksum": "c"}'
                                       WHEN 1 THEN '{"source": "a", "url": "ftp://a"}' ELSE text END
                WHEN 2 THEN text || CASE m % 3 WHEN 0 THEN ' pickle.load(f)' WHEN 1 THEN ' import subprocess' ELSE '' END
                WHEN 3 THEN text || CASE m % 2 WHEN 0 THEN ' Training evaluation limitations BIAS' ELSE '' END
                WHEN 4 THEN 'weights' || CAST(m AS STRING)
                WHEN 5 THEN CASE m % 2 WHEN 0 THEN 'HF_TOKEN=' || <sha>text</sha> ELSE 'x=1' END
                WHEN 6 THEN CASE m % 3 WHEN 0 THEN '{"target_modules": ["lm_head"], "r": 512, "base_model_name_or_path": "b"}'
                                       WHEN 1 THEN '{"target_modules": ["q_proj", "odd"]}' ELSE '{broken' END
                WHEN 7 THEN CASE m % 4 WHEN 0 THEN '{"files": [{"path": "model.safetensors", "sha256": "' || <sha>text</sha> || '"}]}'
                                       WHEN 1 THEN '{"files": [{"path": "absent.bin", "sha256": "0"}]}'
                                       WHEN 2 THEN '{broken'
                                       ELSE '{"files": [{"path": "model.safetensors", "sha256": "'
                                            || <sha>'weights' || CAST(m AS STRING)</sha> || '"}]}' END
                WHEN 8 THEN CASE m % 2 WHEN 0 THEN 'USER root' || chr(10) || text ELSE text || ' 0.0.0.0' END
                ELSE 'torch' || chr(10) || text END AS text
            FROM (SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS m, doc_id % 10 AS slot, text FROM documents) d) f""",
    # findings that name user folders
    "path_findings": f"""
        SELECT '/home/' || source || '/models/' || {_MODEL} AS target,
               'seen /tmp/' || lang || '/x and /Users/' || source || '/y in ' || CAST(doc_id AS STRING) AS detail,
               '{{"file":"/home/' || source || '/f","list":["/home/' || source || '/g"],"n":' || CAST(doc_id AS STRING) || '}}' AS evidence
        FROM documents""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def _dialect(sql: str, spark: bool) -> str:
    opening = "sha2(" if spark else "sha256("
    entry = "to_json(named_struct('role', 'assistant', 'content', " if spark else "to_json({'role': 'assistant', 'content': "
    sql = sql.replace("<entry>", entry).replace("</entry>", "))" if spark else "})")
    return sql.replace("<sha>", opening).replace("</sha>", ", 256)" if spark else ")")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view in Spark."""
    sql = _dialect(VIEWS[name], True)
    used = [t for t in TABLES if f"FROM {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    # braces of JSON literals must survive the parameter substitution
    parts = sql.split("FROM {")
    head = [p.replace("{", "{{").replace("}", "}}") for p in parts[:1]]
    tail = []
    for p in parts[1:]:
        name_, rest = p.split("}", 1)
        tail.append(f"FROM {{{name_}}}" + rest.replace("{", "{{").replace("}", "}}"))
    return spark.sql("".join(head + tail), **{t: table(spark, sf_dir, t) for t in used})


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the same views in DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_dialect(VIEWS[n], False)})" for n in names)
