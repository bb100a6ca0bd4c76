"""Shared helpers: a folder that all executors reach, written intermediate tables, column guards, joins on hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage

#: Keys that an ``attach`` treats as hot at most: those of at least this share of all rows, whose table is broadcast.
HOT_KEYS = 10_000


#: Paths of intermediate tables that were written and not deleted yet, in the order of writing.
_PATHS: list[str] = []


def new_path(spark: SparkSession, name: str, table: bool = False) -> str:
    """A path in the shared folder that no earlier call has returned. table: it counts as an intermediate table's."""
    path = storage.scratch(spark, name)
    if table:
        _PATHS.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: the lineage ends there.

    The files outlive any executor, so that later stages can be retried from them. They stay until ``remove_tables`` or an
    enclosing ``scratch`` deletes them.
    """
    spark = df.sparkSession
    path = new_path(spark, name, table=True)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_tables(spark: SparkSession, since: int = 0, but: Sequence[DataFrame] = ()) -> None:
    """Deletes the intermediate tables written after the first ``since``, but those given (as ``written`` returned them).

    For when what was computed from them is stored: a result that was not written yet still reads them.
    """
    kept = {df.scratch_path for df in but}
    for path in _PATHS[since:]:
        if path not in kept:
            remove(spark, path)
            _PATHS.remove(path)


def tables_so_far() -> int:
    """For remove_tables: how many intermediate tables there are now."""
    return len(_PATHS)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what the block writes by ``written``, but the tables put into the yielded list."""
    since, kept = len(_PATHS), []
    yield kept
    remove_tables(spark, since, kept)


def attach(rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], spread: str, n: str = "_n") -> DataFrame:
    """rows LEFT JOIN table on ``key``, with the table's ``values``; no key is a hot one, whatever its rows.

    The table has a row per key and in ``n`` how many of ``rows`` have it. Keys of at least a HOT_KEYS-th of all rows are at most
    HOT_KEYS: they are broadcast (strings up to 256 characters). Their rows get a join key of their own, dealt by a hash of the
    column ``spread``, that finds nothing in the join of all others.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    short = F.length(key) <= 256 if dict(table.dtypes)[key] in ("string", "binary") else F.lit(True)
    is_hot = (F.col(n) * HOT_KEYS >= total) & short
    got = [f"_got_{v}" for v in values]
    hot = table.filter(is_hot).select(F.col(key).alias("_hot"), F.struct(*values).alias("_hot_values"))
    cold = table.filter(~is_hot | F.col(key).isNull()).select(F.col(key).alias("_cold"), F.lit(0).alias("_cold_salt"), *(F.col(v).alias(g) for v, g in zip(values, got)))
    marked = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(HOT_KEYS)).cast("int") + 1).otherwise(0))
    joined = marked.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(*rows.columns, *(F.when(F.col("_hot").isNotNull(), F.col(f"_hot_values.{v}")).otherwise(F.col(g)).alias(v) for v, g in zip(values, got)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in count() if (n := name + "_" * i).lower() not in taken) for name in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
