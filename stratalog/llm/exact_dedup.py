"""Exact deduplication by salted combining, in DataFrame operations only.

Texts are equal when they are identical after each run of ASCII white space became one space.
Three stages, each of which groups by the digest *and the whole content*:

1. Every map task deduplicates its own rows (the partial aggregate before the shuffle), so that a
   text of which a third of all rows are copies leaves a task as one row.
2. The local winners meet in (digest, salt) groups. The salt follows the map partition, so a hot
   digest is dealt over ``salts`` reducers however many map tasks there are.
3. The at most ``salts`` winners of each digest are combined.

What maps a row to its winner is the digest alone, once stage 3 has shown that every digest stands
for one content; digests of several contents, if there are any, are resolved by content. Winners of digests that
very many rows share are broadcast, so that no task has to join them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, text_or_empty, written

SALTS = 16
WHITE = r"[\x20\x09-\x0D]+"


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), WHITE, " ")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _prepared(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), normalised().alias("_norm")).withColumn("_dig", digest(F.col("_norm")))


def combine(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: _dig, _norm, keep_id (smallest id), group_size."""
    rows = _prepared(docs, digest).withColumn("_salt", F.spark_partition_id() % F.lit(salts))
    salted = rows.groupBy("_dig", "_salt", "_norm").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    dealt = salted.select("_dig", "_norm", "_id", "_n").repartition("_dig")
    return dealt.groupBy("_dig", "_norm").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the smallest doc_id stays; null ids come
    last, and a group of null ids only has a null keep_id and keeps one of its rows. Of repeated
    rows (same id, same text) one stays. An empty table gives an empty result. Columns besides
    doc_id and text are ignored.
    """
    per_digest = written(
        combine(docs, salts, digest).groupBy("_dig").agg(
            F.count(F.lit(1)).alias("_contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "exact-digests",
    )
    members = _prepared(docs, digest)
    several = per_digest.filter("_contents > 1").select("_dig")
    if digest is sha256:
        rows = members.groupBy("_dig", "_id").agg(F.count(F.lit(1)).alias("_m")).withColumn("text_sha256", F.lower(F.hex("_dig")))
    else:
        rows = members.withColumn("text_sha256", F.sha2("_norm", 256)).groupBy("_dig", "_id", "text_sha256").agg(F.count(F.lit(1)).alias("_m"))
    out = attach(rows, per_digest, "_dig", ["keep_id", "group_size"], "_id", "group_size")
    if not several.isEmpty():  # different contents of one digest: told apart by content
        contents = combine(docs.join(several.withColumn("_k", F.col("_dig")), digest(normalised()) == F.col("_k"), "left_semi"), salts, digest)
        apart = (
            members.join(several, "_dig", "left_semi")
            .groupBy("_dig", "_norm", "_id").agg(F.count(F.lit(1)).alias("_m"))
            .join(contents, ["_dig", "_norm"])
            .withColumn("text_sha256", F.sha2("_norm", 256))
        )
        names = ["_id", "_m", "keep_id", "group_size", "text_sha256"]
        out = out.join(several, "_dig", "left_anti").select(names).unionByName(apart.select(names))
    return out.select("*", F.explode(F.expr("sequence(1L, _m)")).alias("_i")).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Needs non-null ids; rows without an id stay."""
    sha, of, dig = fresh(docs, "_sha256", "_of", "_dig")
    kept = combine(docs, salts).filter("keep_id IS NOT NULL").select(F.col("keep_id").alias(of), F.col("_dig").alias(dig))
    named = docs.withColumn(sha, sha256(normalised()))
    rows = named.join(written(kept, "exact-kept"), (F.col("doc_id") == F.col(of)) & (F.col(sha) == F.col(dig)), "left_semi")
    return rows.dropDuplicates(["doc_id", sha]).drop(sha).unionByName(docs.filter("doc_id IS NULL"))
