"""Planning of compactions: what is due and which runs take part. All of it is over run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..operators import manifest


def due(files: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """level, n_runs, bytes, due: level 0 by its number of runs, deeper levels by their size."""
    limit = F.pow(F.lit(float(config.level_base)), F.col("level")) * F.lit(config.level_unit)
    ready = F.when(F.col("level") == 0, F.col("n_runs") >= config.level0_runs).otherwise(F.col("bytes") > limit)
    return manifest.level_sizes(files).withColumn("due", ready)


def inputs_level0(files: DataFrame) -> DataFrame:
    """level, id: all runs of level 0, and those of level 1 that meet the union of their ranges.

    The union range, not each run's own: the output spans it, and level 1 has to stay disjoint.
    """
    zero = files.filter("level = 0")
    low, high = zero.agg(F.min("first_key"), F.max("last_key")).first()
    if low is None:
        return zero.select("level", "id")
    return zero.unionByName(manifest.covering(files, 1, F.lit(low), F.lit(high))).select("level", "id").distinct()


def inputs_level(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """level, id, victim_level: each cursor's run and the next level's runs that meet it, for levels from 1 on."""
    picked = manifest.rotation_pick(files, cursors.filter("level >= 1")).join(files, ["level", "id"]).select("level", "id", "first_key", "last_key")
    below = files.select(F.col("level").alias("_level"), F.col("id").alias("_id"), F.col("first_key").alias("_first"), F.col("last_key").alias("_last"))
    # One run for each cursor.
    met = below.join(manifest.metadata(picked), (F.col("_level") == F.col("level") + 1) & (F.col("_last") >= F.col("first_key")) & (F.col("_first") <= F.col("last_key")))
    return picked.select("level", "id", F.col("level").alias("victim_level")).unionByName(
        met.select(F.col("_level").alias("level"), F.col("_id").alias("id"), F.col("level").alias("victim_level"))
    )
