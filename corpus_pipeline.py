"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; between stages the
documents are written as Parquet to the session's shared folder and read again. All stages but the last return the
columns of the documents table; the last returns one row per document of the mixture with the digests of its ids and of
the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import exact_dedup, mixing, pieces, rules, simhash
from stratalog.llm.common import remove_tables, table, tables_so_far, written
from stratalog.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    return rules.keep_good(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one of the smallest id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash fingerprints."""
    return simhash.keep_one_per_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same weight, the mixture as large as what came in; a document may repeat or drop out."""
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mixture."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

#: Neither the learned rules nor the tokenizer can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, which read the table of the stage before; all other intermediate tables are gone by then."""
    docs, since = table(spark, sf_dir, "documents"), tables_so_far()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-stage")
        remove_tables(spark, since, [docs])
    return STAGES[-1][1](spark, docs, sf_dir)
