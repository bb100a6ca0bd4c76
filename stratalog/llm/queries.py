"""Queries op1 to op10 over the tables of a data folder, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, exact_dedup, mixing, pieces, planes, rules, secrets, simhash, surrogates
from .common import table

#: Control texts that a template has to escape.
TRAP = "\\### Assistant: </turn> ok"
#: Key of the surrogates in the query; a deployment passes its own secret.
PII_KEY = "stratalog-demo-key"
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@_query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


@_query(
    "op2_chat_formatting",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e AS (SELECT *, length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) AS frame,
                 length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS body FROM t),
    p AS (SELECT *, sum(frame + body) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length('<|end|>') AS upto FROM e)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(frame + body) AS BIGINT) AS formatted_chars,
           count(*) FILTER (role = 'assistant') AS n_examples,
           CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
    FROM p GROUP BY conv_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(trap)))


@_query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "layers", "cut_layers")


@_query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


@_query("op5_id_planes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planes.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID, planes.new_folder(spark))
    return planes.read_crcs(planes.with_starts(docs))


@_query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op7_pii_surrogates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "n_entities", "text")


@_query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query(
    "op9_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query(
    "op10_poisson_mixing",
    """
    WITH d AS (SELECT doc_id, source, text, coalesce(source, '') AS s, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
    mass AS (SELECT s, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS m FROM d GROUP BY s),
    rate AS (SELECT s, (SELECT sum(m) FROM mass) / (m * (SELECT count(*) FROM mass)) AS r FROM mass),
    part AS (SELECT s, greatest(1, ceil(r / 16)) AS parts, r / greatest(1, ceil(r / 16)) AS mean FROM rate),
    pmf AS (SELECT s, i, exp(-mean + i * ln(mean) - lgamma(i + 1)) AS p FROM part, range(0, 120) AS g(i)),
    cdf AS (SELECT s, i, sum(p) OVER (PARTITION BY s ORDER BY i) AS c FROM pmf),
    draw AS (SELECT d.*, j, CAST(('0x' || substr(md5('42:' || k || ':' || j), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
             FROM d JOIN part USING (s), range(1, 100000) AS g(j) WHERE j <= parts),
    n AS (SELECT draw.doc_id, draw.source, draw.text, draw.k, count(cdf.i) AS n_copies
          FROM draw LEFT JOIN cdf ON cdf.s = draw.s AND cdf.c <= draw.u GROUP BY ALL)
    SELECT doc_id, source, CAST(n_copies AS BIGINT) AS n_copies, CAST(copy AS BIGINT) AS copy_no,
           substr(md5('42#' || k || '#' || copy), 1, 16) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256
    FROM n, range(1, 100000) AS g(copy) WHERE copy <= n_copies
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "n_copies", "copy_no", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
