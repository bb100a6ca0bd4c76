"""Queries over run metadata: which runs are live, which cover or overlap a range, which comes next.

A files table has level, id, first_key, last_key, n_rows, bytes: one row per run, so even a store of 100 TB has some
hundred thousand. Range matches are equi-joins on bins of the key space: up to BINS keys that the runs' starts
give (those of the smallest hashes, so what reaches the driver is bounded) cut it, a range is in every bin that it meets, and a key in
one. Bins hold about as many runs each, whatever the keys are like.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_FILES = 100_000
#: Bins of the key space in range joins, and how many of them one step of the search for a key's bin skips.
BINS, STRIDE = 1_024, 32


def metadata(files: DataFrame) -> DataFrame:
    """The table, broadcast if its count allows."""
    return F.broadcast(files) if files.count() <= BROADCAST_FILES else files


def order(files: DataFrame) -> DataFrame:
    """Adds place: level 0 newest first, deeper levels by key range."""
    w = Window.orderBy("level", F.when(F.col("level") == 0, -F.col("id")), "first_key", "last_key", "id")
    return files.withColumn("place", F.row_number().over(w).cast("long"))


def bins(files: DataFrame, most: int = BINS) -> Callable[[Column], Column]:
    """Key -> the number of its bin, which ascends with the key."""
    starts = files.select("first_key").filter("first_key IS NOT NULL").distinct()
    cuts = sorted(r["first_key"] for r in starts.orderBy(F.xxhash64("first_key"), "first_key").limit(most).collect())
    if not cuts:
        return lambda key: F.lit(0)
    fine, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[::STRIDE]))

    def bin_of(key: Column) -> Column:
        upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= key))
        skip = (upto(coarse) - 1) * STRIDE
        return F.when(skip < 0, 0).otherwise(skip + upto(F.slice(fine, F.greatest(skip, F.lit(0)) + 1, F.lit(STRIDE))))

    return bin_of


def runs_for_keys(files: DataFrame, keys: DataFrame) -> DataFrame:
    """key, level, id of every run whose range holds the key, bounds included."""
    bin_of = bins(files)
    f = files.select("level", "id", "first_key", "last_key", F.explode(F.sequence(bin_of(F.col("first_key")), bin_of(F.col("last_key")))).alias("_bin"))
    asked = keys.select("key").filter("key IS NOT NULL").distinct().withColumn("_bin", bin_of(F.col("key")))
    return asked.join(f, "_bin").filter((F.col("first_key") <= F.col("key")) & (F.col("key") <= F.col("last_key"))).select("key", "level", "id")


def overlaps(files: DataFrame) -> DataFrame:
    """level, id, next_id: runs of the next level whose ranges meet this run's. Each pair is found in the first bin that both meet."""
    bin_of = bins(files)
    ranged = files.select("level", "id", "first_key", "last_key", bin_of(F.col("first_key")).alias("_from"), bin_of(F.col("last_key")).alias("_to"))
    mine = ranged.withColumn("_bin", F.explode(F.sequence("_from", "_to")))
    below = mine.select((F.col("level") - 1).alias("level"), "_bin", F.col("id").alias("next_id"), F.col("first_key").alias("_first"), F.col("last_key").alias("_last"), F.col("_from").alias("_next_from"))
    met = (F.col("_last") >= F.col("first_key")) & (F.col("_first") <= F.col("last_key")) & (F.col("_bin") == F.greatest("_from", "_next_from"))
    return mine.join(below, ["level", "_bin"]).filter(met).select("level", "id", "next_id")


def covering(files: DataFrame, level: int, first: Column, last: Column) -> DataFrame:
    """Runs of a level that meet a range."""
    return files.filter((F.col("level") == level) & (F.col("last_key") >= first) & (F.col("first_key") <= last))


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("bytes").alias("bytes"))


def rotation_next(files: DataFrame) -> DataFrame:
    """level, id, next_start: where the cursor goes after this run; the last run wraps to the first."""
    w = Window.partitionBy("level").orderBy("first_key", "id")
    first = F.first("first_key").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return files.select("level", "id", F.coalesce(F.lead("first_key").over(w), first).alias("next_start"))


def rotation_pick(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """cursors: level, compact_key -> level, compact_key, id: the run from whose start up to the next run's the key lies.

    A key before all starts, and a null one, picks the level's first run if null, else the last (as after the last start).
    """
    w = Window.partitionBy("level").orderBy("first_key", "id")
    spans = files.select(
        "level", "id", "first_key",
        F.lead("first_key").over(w).alias("_next"),
        F.row_number().over(w).alias("_nth"),
        F.count(F.lit(1)).over(Window.partitionBy("level")).alias("_n"),
    )
    key = F.col("compact_key")
    inside = (F.col("first_key") <= key) & (key < F.col("_next"))
    rank = F.when(key.isNull(), F.col("_nth")).when(inside, F.lit(0)).when(F.col("_nth") == F.col("_n"), F.lit(1)).otherwise(F.lit(2))
    # Cursors are few, one a level or so: each is met with its level's runs, and the best run comes out of a partial aggregate.
    met = spans.join(F.broadcast(cursors), "level") if cursors.count() <= BROADCAST_FILES else spans.join(cursors, "level")
    return met.groupBy("level", "compact_key").agg(F.min(F.struct(rank.alias("r"), "_nth", "id")).alias("_best")).select("level", "compact_key", "_best.id")


def rotation_replay(actions: DataFrame) -> DataFrame:
    """seq, level, id, compact_key: of each next_compact action, the run it takes and where the cursor goes.

    actions has seq, action, level, id, first_key. Every step depends on the runs that are live at that moment, so each
    level is an ordered fold; it is streamed through its task and holds the level's live runs. A level without one gives
    no row.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, cursor, live, starts = None, None, {}, []
        for frame in batches:
            out = []
            for at, seq, action, run, first in zip(frame["level"], frame["seq"], frame["action"], frame["id"], frame["first_key"]):
                if at != level:
                    level, cursor, live, starts = at, None, {}, []
                if action == "next_compact" and starts:
                    taken = 0 if cursor is None else bisect_right(starts, (cursor, float("inf"))) - 1
                    cursor = starts[(taken + 1) % len(starts)][0]
                    out.append((seq, level, starts[taken][1], cursor))
                elif action in ("add", "remove"):
                    if run in live:
                        del starts[bisect_left(starts, (live.pop(run), run))]
                    if action == "add":
                        live[run] = first
                        insort(starts, (first, run))
            yield pd.DataFrame(out, columns=["seq", "level", "id", "compact_key"])

    steps = actions.filter("action IN ('add', 'remove', 'next_compact')").select("level", "seq", "action", "id", "first_key")
    types = dict(steps.dtypes)
    ordered = steps.repartition("level").sortWithinPartitions("level", "seq")
    return ordered.mapInPandas(fold, f"seq {types['seq']}, level {types['level']}, id {types['id']}, compact_key {types['first_key']}")


def live_runs(actions: DataFrame) -> DataFrame:
    """The newest of each run's add and remove actions, where it is an add: level, id, first_key, last_key, seq."""
    rank = F.row_number().over(Window.partitionBy("level", "id").orderBy(F.col("seq").desc()))
    newest = actions.filter("action IN ('add', 'remove')").withColumn("_rank", rank).filter("_rank = 1 AND action = 'add'")
    return newest.select("level", "id", "first_key", "last_key", "seq")


def next_ids(actions: DataFrame) -> DataFrame:
    """level, next_id: how many ids the level has given out."""
    return actions.filter("action = 'new_id'").groupBy("level").agg(F.count(F.lit(1)).alias("next_id"))


def recovered(snapshot: DataFrame, later: DataFrame) -> DataFrame:
    """Live runs of a checkpoint and the committed actions after it; both have the columns of an action."""
    return live_runs(snapshot.unionByName(later))


def orphans(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that no live run owns."""
    return listed.join(files.select("level", "id"), ["level", "id"], "left_anti")
