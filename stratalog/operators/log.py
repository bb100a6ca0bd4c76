"""Log replay: records count only up to the last commit marker before the first damaged record.

Nothing here orders the whole log in one task. The cut-off points are aggregates, computed first, so that they reach the
scan as pushed filters; batch numbers come from ranges of the log: each range counts its markers, the few counts
are summed, and each range numbers its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of consecutive sequence numbers that are numbered together.
BLOCK = 1 << 16


def scalar(df: DataFrame):
    """The value of a one-row, one-column aggregate."""
    return df.first()[0]


def intact(log: DataFrame) -> DataFrame:
    """The rows before the first one marked corrupt: a torn tail ends the log."""
    bad = scalar(log.filter("corrupt").agg(F.min("seq")))
    return log if bad is None else log.filter(F.col("seq") < F.lit(bad))


def committed(log: DataFrame) -> DataFrame:
    """The rows before the last commit marker, markers excluded; none without a marker."""
    last = scalar(log.filter("op = 'commit'").agg(F.max("seq")))
    return log.filter(F.lit(False)) if last is None else log.filter((F.col("seq") < F.lit(last)) & (F.col("op") != "commit"))


def with_batches(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds batch: the number of commit markers on preceding rows. Rows without a seq have no place in the log and are left out."""
    marker = (F.col("op") == "commit").cast("long")
    rows = log.withColumn("_block", F.floor(F.col("seq") / F.lit(block)))
    totals = rows.groupBy("_block").agg(F.sum(marker).alias("_n"))
    before = totals.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(marker).over(Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(before, "_block").withColumn("batch", F.col("_before") + F.col("_within")).drop("_block", "_within", "_before")


def torn_tails(log: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """cut, last_commit, batches, records: what survives when the record at each of a few seqs is the first damaged one.

    last_commit is null, and the counts are 0, where no marker precedes the cut. Two passes of one aggregate each.
    """
    seq, commit = F.col("seq"), F.col("op") == "commit"
    found = log.agg(*(F.max(F.when(commit & (seq < F.lit(c)), seq)).alias(f"m{i}") for i, c in enumerate(cuts))).first()
    lasts = [-1 if m is None else m for m in found]
    counts = log.agg(
        *(F.count_if(commit & (seq <= F.lit(m))).alias(f"b{i}") for i, m in enumerate(lasts)),
        *(F.count_if(~commit & (seq < F.lit(m))).alias(f"r{i}") for i, m in enumerate(lasts)),
    )
    rows = [F.struct(F.lit(c).cast("long").alias("cut"), F.lit(found[i]).cast("long").alias("last_commit"), F.col(f"b{i}").alias("batches"), F.col(f"r{i}").alias("records")) for i, c in enumerate(cuts)]
    return counts.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def replay(log: DataFrame) -> DataFrame:
    """Committed records of the intact part of a log, with batch."""
    whole = intact(log)
    last = scalar(whole.filter("op = 'commit'").agg(F.max("seq")))
    # Markers have to stay until the batches are numbered.
    return whole.filter(F.lit(False)).withColumn("batch", F.lit(0).cast("long")) if last is None else with_batches(whole.filter(F.col("seq") < F.lit(last))).filter("op <> 'commit'")
