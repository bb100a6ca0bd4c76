"""A key filter as a table of set bits: membership has no false negatives and a chosen rate of false positives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sized(expected_keys: int, rate: float) -> tuple[int, int]:
    """Number of bits and of hashes for so many keys and such a false-positive rate."""
    bits = max(64, math.ceil(-expected_keys * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, expected_keys) * math.log(2)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits)) for seed in range(hashes)))


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The distinct set bits (bit) of a filter over a column; null keys are not added."""
    return keys.filter(F.col(key).isNotNull()).select(F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def probe(probes: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The distinct probe keys with maybe (false: certainly absent).

    The bit table has at most ``bits`` rows; a filter of up to a million bits is broadcast.
    """
    distinct = probes.select(key).filter(F.col(key).isNotNull()).distinct()
    wanted = distinct.select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("bit"))
    table = F.broadcast(bloom) if bits <= 1_000_000 else bloom
    found = wanted.join(table.withColumn("_set", F.lit(True)), "bit", "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))
