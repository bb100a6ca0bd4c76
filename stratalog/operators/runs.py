"""Sorted runs: ranges, sparse index, memtable size, file split, and the flush boundaries' fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import StoreConfig
from ..functions.keys import entry_bytes
from ..sources.storage import scratch
from .merge import newest


def sized(versions: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    return versions.withColumn("bytes", entry_bytes(F.col("key"), F.col("value"), F.col("is_tombstone"), config))


def memtable_size(changelog: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """entries and bytes of the newest versions: an overwritten entry no longer counts."""
    return sized(newest(changelog), config).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def ranges(records: DataFrame) -> DataFrame:
    """level, id, first_key, last_key, n_rows, bytes of every run."""
    return sized(records).groupBy("level", "id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("bytes"))


def sparse_index(records: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """level, id, pos, key, offset of every indexed record: each interval's first and the run's last.

    A run is bounded by its target size, so its window is too.
    """
    w = Window.partitionBy("level", "id").orderBy("key")
    placed = (
        sized(records, config)
        .withColumn("pos", F.row_number().over(w).cast("long") - 1)
        .withColumn("offset", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("level", "id")))
    )
    return placed.filter((F.col("pos") % config.index_interval == 0) | (F.col("pos") == F.col("_n") - 1)).select("level", "id", "pos", "key", "offset")


def split_files(sizes: DataFrame, limit: int) -> DataFrame:
    """grp, ord, bytes -> the same with file: a new file starts before a record that would take the current one over the limit.

    What a stretch of records does to the fold depends only on how full the file is that reaches it, and on that only by which of
    its records starts the first new file. So the records are cut into sorted parts; each part's task follows the files from every such
    record at once and gives the few distinct outcomes; a fold over these (not the records) tells how full a file reaches
    each part; and each part then numbers its records. Rows of equal grp and ord are in order of bytes.
    """
    spark = sizes.sparkSession
    place = scratch(spark, "split-files")
    cut = sizes.select("grp", "ord", F.col("bytes").cast("long").alias("bytes")).repartitionByRange("grp", "ord")
    cut.withColumn("_part", F.spark_partition_id()).write.parquet(place)  # the same parts for both passes
    parts = spark.read.parquet(place).select("grp", "ord", "bytes", "_part")
    kind = dict(parts.dtypes)["grp"]
    sort = ["_part", "grp", "ord", "bytes"]

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches):
            ends, nexts = _next_starts(t, limit)
            n, total = len(ends), int(ends[-1])
            # The records that may start the first new file: those up to the first that an empty file cannot reach.
            at = np.arange(min(n, int(np.searchsorted(ends, limit, "right")) + 1))
            files, entry = np.ones(len(at), np.int64), at
            while (go := nexts[at] < n).any():
                files, at = files + go, np.where(go, nexts[at], at)
            used = total - (ends[at] - t["bytes"].to_numpy()[at])
            # Record e starts it when the file that comes in is fuller than limit - ends[e].
            last = np.r_[np.flatnonzero((np.diff(used) != 0) | (np.diff(files) != 0)), len(at) - 1]
            above, used, files = limit - ends[entry[last]], used[last], files[last]
            if total <= limit:  # the whole stretch may fit into the file that comes in
                above, used, files = np.r_[above, -1], np.r_[used, total], np.r_[files, 0]
            names = ["grp", "_part", "above", "used", "files"]
            first = t.slice(0, 1).take(np.zeros(len(above), np.int64))
            yield pa.RecordBatch.from_arrays([first["grp"].combine_chunks(), first["_part"].combine_chunks(), pa.array(above), pa.array(used), pa.array(files)], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, used, file = object(), None, None, -1
        for b in batches:
            out = []
            for g, p, above, after, files in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    group, part, used, file = g, None, None, -1
                if p == part or used is not None and used <= above and above >= 0:
                    continue  # the part's outcome was found, or is another
                part = p
                out.append((g, p, used, file))
                used, file = (used + after if used is not None and not files else after), file + files
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field("grp").type, pa.int32(), pa.int64(), pa.int64()))], ["grp", "_part", "_used", "_file"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches):
            ends, nexts = _next_starts(t, limit)
            used, file, starts = t["_used"][0].as_py(), t["_file"][0].as_py(), np.zeros(len(ends), np.int64)
            at = 0 if used is None else int(np.searchsorted(ends, limit - used, "right"))
            while at < len(ends):
                starts[at] = 1
                at = int(nexts[at])
            numbers = file + np.cumsum(starts)
            yield from t.select(["grp", "ord", "bytes"]).append_column("file", pa.array(numbers)).to_batches()

    found = parts.repartition("_part").sortWithinPartitions(*sort).mapInArrow(outcomes, f"grp {kind}, _part int, above long, used long, files long")
    reach = found.repartition("grp").sortWithinPartitions("grp", "_part", F.col("above").desc()).mapInArrow(fold, f"grp {kind}, _part int, _used long, _file long")
    known = parts.join(reach.withColumnRenamed("grp", "_grp").withColumnRenamed("_part", "_p"), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_p"))).drop("_grp", "_p")
    return known.repartition("_part").sortWithinPartitions(*sort).mapInArrow(number, f"grp {kind}, ord {dict(parts.dtypes)['ord']}, bytes long, file long")


def _next_starts(stretch: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each record ends, in bytes of its stretch, and which record starts the next file if it starts one."""
    size = stretch["bytes"].to_numpy()
    ends = np.cumsum(size)
    return ends, np.maximum(np.arange(1, len(ends) + 1), np.searchsorted(ends, ends - size + limit, "right"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part and group, which are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = lambda b: (b.column("_part")[0].as_py(), b.column("grp")[0].as_py())
    for b in batches:
        if not b.num_rows:
            continue
        part, code = b.column("_part").to_numpy(), b.column("grp").dictionary_encode().indices.fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(code) != 0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            piece = b.slice(start, end - start)
            if held and key(held[0]) != key(piece):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flush_boundaries(changes: DataFrame, limit: int) -> DataFrame:
    """shard, seq, key, bytes -> the same with flush: how many flushes the shard had before the change.

    The running size counts only the newest entry of each key since the last flush, so this is a fold; it holds the keys of
    one memtable at a time, whose size the limit bounds.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, flush, used, entries = None, 0, 0, {}
        for frame in batches:
            out = []
            for s, k, b in zip(frame["shard"], frame["key"], frame["bytes"]):
                if s != shard:
                    shard, flush, used, entries = s, 0, 0, {}
                out.append(flush)
                used += b - entries.get(k, 0)
                entries[k] = b
                if used >= limit:
                    flush, used, entries = flush + 1, 0, {}
            yield frame.assign(flush=out)

    ordered = changes.select("shard", "seq", "key", "bytes").repartition("shard").sortWithinPartitions("shard", "seq")
    types = dict(ordered.dtypes)
    return ordered.mapInPandas(fold, f"shard {types['shard']}, seq long, key {types['key']}, bytes long, flush long")
