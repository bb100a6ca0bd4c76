"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of mass s (code points plus one per document) and weight w gets the mean repetition rate
``budget * w / (s * sum of weights)``. Each document's number of copies is the inverse of the Poisson
distribution function at a uniform number hashed from (seed, document id); a rate above CHUNK is
the sum of equal smaller ones with a hash of their own, so that no exponential underflows. The copies
are then dealt to partitions by the leading bits of a hash and sorted: a global shuffle whose
ranges are known without sampling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shuffle_partitions, text_or_empty, written

CHUNK = 16
#: Columns that mix() adds.
ADDED = ("n_copies", "copy_no", "shuffle_key")
#: Rate tables of up to this many sources (some 50 bytes each) are broadcast; larger ones are joined.
BROADCAST_SOURCES = 50_000


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """One row per source: _source (null: empty), _mass, _rate.

    Without weights all sources weigh the same; with them, a source that is not named weighs 0.
    Without a budget the mixture is as large as the input.
    """
    spark = docs.sparkSession
    mass = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(F.sum(F.length(text_or_empty()) + F.lit(1)).cast("double").alias("_mass"))
    if weights is None:
        mass = mass.withColumn("_weight", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_source string, _weight double")
        mass = mass.join(given, "_source", "left").fillna(0.0, ["_weight"])
    mass = written(mass, "source-mass")
    total = mass.agg(F.sum("_mass"), F.sum("_weight")).first()
    size, weight = (total[0] or 0.0) if budget is None else float(budget), total[1] or 1.0
    return mass.select("_source", "_mass", (F.lit(size) * F.col("_weight") / (F.col("_mass") * F.lit(weight))).alias("_rate"))


def uniform(*parts: Column) -> Column:
    """In [0, 1): 52 bits of the md5 of the parts, colon-joined."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_count(rate: Column, seed: int, key: Column) -> Column:
    """Number of copies for a mean rate: sums the inverted distributions of equal parts of at most CHUNK."""
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(CHUNK))).cast("long")
    mean = rate / parts

    def one(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, j.cast("string"))
        first = F.exp(-mean)
        last = F.ceil(mean + F.lit(12) * F.sqrt(mean) + F.lit(30)).cast("long")
        start = F.struct(first.alias("p"), first.alias("c"), u.alias("u"), F.lit(0).cast("long").alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            below = s["c"] <= s["u"]
            return F.struct(p.alias("p"), (s["c"] + p).alias("c"), s["u"].alias("u"), (s["n"] + F.when(below, 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1).cast("long"), last), start, step, lambda s: s["n"])

    return F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), parts), one), F.lit(0).cast("long"), lambda a, x: a + x)


def mixed_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` as they are, each row as often as its Poisson count says, in a globally shuffled order."""
    return _mixed(docs, fresh(docs, *ADDED), weights, budget, seed).select(*(f"`{c}`" for c in docs.columns))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` with n_copies, copy_no (from 1) and shuffle_key, in a globally shuffled order.

    Partition p holds lower keys than partition p + 1 and is sorted by key. A null source is a
    source of its own ('', shared with empty names); null texts have mass 1; null ids hash as the
    empty string; rows that repeat an id get the same number of copies. Empty in, empty out. Input columns
    of the three added names are replaced.
    """
    return _mixed(docs.drop(*ADDED), list(ADDED), weights, budget, seed)


def _mixed(base: DataFrame, added: list[str], weights: Mapping[str, float] | None, budget: float | None, seed: int) -> DataFrame:
    n_copies, copy_no, shuffle_key = added
    source, rate, part = fresh(base, "_source", "_rate", "_part")
    rates = source_rates(base, weights, budget).select(F.col("_source").alias(source), F.col("_rate").alias(rate))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    joined = base.withColumn(source, F.coalesce("source", F.lit(""))).join(rates, source).drop(source)
    counted = joined.withColumn(n_copies, poisson_count(F.col(rate), seed, key)).drop(rate).filter(F.col(n_copies) > 0)
    copies = counted.withColumn(copy_no, F.explode(F.sequence(F.lit(1).cast("long"), n_copies)))
    keyed = copies.withColumn(shuffle_key, F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), key, F.col(copy_no).cast("string"))), 1, 16))
    n = shuffle_partitions(base.sparkSession)
    slot = F.floor(F.conv(F.substring(shuffle_key, 1, 8), 16, 10).cast("double") * F.lit(n) / F.lit(float(2**32))).cast("int")
    return keyed.withColumn(part, slot).repartitionById(n, F.col(part)).sortWithinPartitions(shuffle_key, "doc_id", copy_no).drop(part)
