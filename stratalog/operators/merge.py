"""Last-writer-wins reads over versions of keys.

A version table has key, value, is_tombstone and columns that order recency. Filters on the key commute with the choice
of the newest version, and Catalyst pushes them to the scan; filters on values and tombstones do not, and stay
above it, so that a deleted key cannot come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def run_recency() -> list[Column]:
    return [F.col("level").asc(), F.col("id").desc()]


def newest(versions: DataFrame, recency: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: the newest version, tombstones included."""
    order = list(recency) if recency is not None else [F.col("seq").desc()]
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return versions.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def newest_aggregate(versions: DataFrame) -> DataFrame:
    """The same by a partial aggregate, for keys of very many versions: a hot key leaves each task as one row."""
    payload = F.struct(*[c for c in versions.columns if c != "key"])
    return versions.groupBy("key").agg(F.max_by(payload, F.col("seq")).alias("_v")).select("key", "_v.*")


def live(latest: DataFrame) -> DataFrame:
    return latest.filter(~F.col("is_tombstone"))


def snapshot(versions: DataFrame, recency: Sequence[Column] | None = None) -> DataFrame:
    """The logical content: newest versions minus deleted keys."""
    return live(newest(versions, recency))


def point_get(versions: DataFrame, key, recency: Sequence[Column] | None = None) -> DataFrame:
    """No row, or the live row of one key."""
    return snapshot(versions, recency).filter(F.col("key") == F.lit(key))


def multi_get(versions: DataFrame, keys: DataFrame, recency: Sequence[Column] | None = None) -> DataFrame:
    """A row for every distinct asked key, its value null unless found is true. Only asked keys are ranked."""
    asked = keys.select("key").distinct()
    hits = snapshot(versions.join(asked, "key", "left_semi"), recency).withColumn("found", F.lit(True))
    return asked.join(hits, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(versions: DataFrame, low, high, recency: Sequence[Column] | None = None) -> DataFrame:
    """Live rows of keys between two bounds, both inclusive, in key order."""
    return snapshot(versions, recency).filter(F.col("key").between(F.lit(low), F.lit(high))).orderBy("key")


def full_scan(versions: DataFrame, recency: Sequence[Column] | None = None) -> DataFrame:
    return snapshot(versions, recency).orderBy("key")


def old_values(changelog: DataFrame) -> DataFrame:
    """Each change with the value it replaced: null if there was none or it was deleted."""
    w = Window.partitionBy("key").orderBy("seq")
    return changelog.withColumn("old_value", F.when(F.lag("is_tombstone").over(w), F.lit(None)).otherwise(F.lag("value").over(w)))


def kway_merge(runs: Sequence[DataFrame], recency: Sequence[Column] | None = None) -> DataFrame:
    """The union of runs with only the newest version of each key, in key order; tombstones stay."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return newest(merged, recency or run_recency()).orderBy("key")


def purge(merged: DataFrame, dest_level: int, max_level: int) -> DataFrame:
    """Drops tombstones when nothing older can lie below the destination."""
    return live(merged) if dest_level >= max_level else merged


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base and changes have key, value, seq: the newest of both, with is_new for keys that base lacks.

    One partial aggregate, so that a key of very many changes leaves each task as one row.
    """
    tagged = base.withColumn("_base", F.lit(True)).unionByName(changes.withColumn("_base", F.lit(False)))
    payload = F.struct(*[c for c in base.columns if c != "key"])
    merged = tagged.groupBy("key").agg(F.max_by(payload, F.col("seq")).alias("_v"), (~F.bool_or("_base")).alias("is_new"))
    return merged.select("key", "_v.*", "is_new").select(*base.columns, "is_new")


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select("key").distinct(), "key", "left_anti")
