"""Structured Streaming: keep the newest version of each key, or append micro-batches to a store exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import padded
from ..operators.merge import live, newest_aggregate
from ..sources.storage import Storage, scratch


def latest_by_key(stream: DataFrame) -> DataFrame:
    """key, value, is_tombstone, seq of each key's newest change: the memtable as streaming state."""
    payload = F.struct("value", "is_tombstone", "seq")
    return stream.groupBy("key").agg(F.max_by(payload, F.col("seq")).alias("_v")).select("key", "_v.*")


def append_to_store(stream: DataFrame, store, checkpoint: str):
    """A query that appends every micro-batch (seq, key, value, is_tombstone) to the store as one committed batch.

    The store remembers the last micro-batch per query, so that one that is run again after a failure is not applied twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(batch, source=checkpoint, source_batch=batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed_snapshot(spark: SparkSession, events_path: str) -> DataFrame:
    """The live rows that a stream over an events table ends with.

    Each micro-batch writes the keys that it changed, and a batch that is run again writes the same folder.
    """
    source = spark.read.parquet(events_path)
    folder, _, name = events_path.rpartition("/")
    reader = spark.readStream.schema(source.schema)
    # A file source wants a folder: the table may be one file of many there.
    stream = reader.parquet(events_path) if _is_folder(spark, events_path) else reader.option("pathGlobFilter", name).parquet(folder)
    deleted = F.col("event_type") == "error"
    changes = stream.select(F.col("event_id").alias("seq"), padded(F.col("user_id")).alias("key"), F.when(~deleted, F.col("props")).alias("value"), deleted.alias("is_tombstone"))
    place = scratch(spark, "stream")
    latest = latest_by_key(changes)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/updates/batch={batch_id}")

    query = latest.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not Storage(spark, place).exists("updates"):
        return spark.createDataFrame([], latest.schema)
    return live(newest_aggregate(spark.read.schema(latest.schema).parquet(f"{place}/updates/batch=*")))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
