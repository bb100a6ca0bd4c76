"""A key-value store on Parquet: log batches, sorted runs on levels, and numbered manifest versions.

    wal/batch-N/           one committed batch of changes (Parquet), renamed into place whole
    runs/level=L/ID-xxxx/  one sorted run (Parquet); names are never used twice
    manifest/N.json        version N of the metadata, created whole; the highest number counts

    lease/N.json           who writes: the highest number counts

A change is visible once its batch is in place. A flush writes a run, then commits a manifest version that names it
together with the first log batch that is not flushed, and only then deletes what became unreachable; a compaction likewise
names its outputs and drops its inputs in one version. A run of level 0 may have several parts, disjoint and of one id.

Opening a store for writing takes its lease and recovers it: uncommitted files are orphans and go. A writer that has lost
the lease raises at its next change, before anything of it becomes visible. Any number of readers may open a store
besides (``read_only``): they write and delete nothing, and the files of earlier manifest versions stay ``keep_seconds`` for them.

Every run carries a key filter, as Parquet's own Bloom filters of its key column: written with it, there whenever the store is
opened, and asked by the scans of ``get`` and ``multi_get``, which skip the row groups that certainly lack the keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import StoreConfig
from ..functions.keys import entry_bytes
from ..operators import merge
from .storage import Storage

#: Keys that a scan is given as a list; Spark asks Parquet's filters for up to ten (spark.sql.parquet.pushdown.inFilterThreshold).
INLINE_KEYS = 10
CHANGE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("is_tombstone", T.BooleanType()),
])


@dataclass(frozen=True)
class Run:
    """Metadata of a run; keys in hexadecimal, which sorts like the bytes."""

    level: int
    id: int
    path: str
    first_key: str
    last_key: str
    n_rows: int
    bytes: int

    def meets(self, first: str, last: str) -> bool:
        return self.first_key <= last and first <= self.last_key


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    runs: tuple[Run, ...] = ()
    next_ids: dict[str, int] = field(default_factory=dict)
    cursors: dict[str, str] = field(default_factory=dict)
    #: Log batches before this one are in runs.
    first_batch: int = 0
    next_batch: int = 0
    #: Last micro-batch taken from each streaming source.
    sources: dict[str, int] = field(default_factory=dict)

    def level(self, n: int) -> list[Run]:
        return sorted((r for r in self.runs if r.level == n), key=lambda r: (-r.id if n == 0 else 0, r.first_key))

    def max_level(self) -> int:
        return max((r.level for r in self.runs), default=0)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(**raw | {"runs": tuple(Run(**r) for r in raw["runs"])})


class Store:
    def __init__(self, spark: SparkSession, root: str, config: StoreConfig = StoreConfig(), read_only: bool = False):
        """Opens a store, as a writer recovering what a crash left; a folder that is not there is an empty store."""
        self.spark, self.config, self.files, self.read_only = spark, config, Storage(spark, root), read_only
        self._past: dict[int, Manifest] = {}
        if not read_only:
            self._take_lease()
        self.refresh()
        if not read_only:
            self.clean()

    def refresh(self) -> None:
        """Reads the newest version and what the log has since."""
        versions = [int(n.removesuffix(".json")) for n in self.files.names("manifest") if n.endswith(".json")]
        self.manifest = Manifest.loads(self.files.read(f"manifest/{max(versions)}.json")) if versions else Manifest()
        placed = [int(n.removeprefix("batch-")) for n in self.files.names("wal") if n.startswith("batch-")]
        last = max(placed, default=-1)
        if last >= self.manifest.next_batch:
            self.manifest = replace(self.manifest, next_batch=last + 1)
        self._sources_of_log()

    def _take_lease(self) -> None:
        held = [int(n.removesuffix(".json")) for n in self.files.names("lease")]
        self.lease = max(held, default=0) + 1
        if not self.files.create(f"lease/{self.lease}.json", json.dumps({"owner": uuid.uuid4().hex})):
            raise RuntimeError("another writer opens the store")
        for n in held:
            self.files.delete(f"lease/{n}.json")

    def _check_lease(self) -> None:
        if self.read_only:
            raise RuntimeError("the store was opened for reading only")
        if max((int(n.removesuffix(".json")) for n in self.files.names("lease")), default=0) != self.lease:
            raise RuntimeError("another writer has opened the store")

    # Writing

    def insert(self, key: bytes, value: bytes) -> None:
        self._rows([(key, value, False)])

    def remove(self, key: bytes) -> None:
        """Deletes at once, whether the key is there or not."""
        self._rows([(key, None, True)])

    def _rows(self, rows: list[tuple]) -> None:
        self.write_batch(self.spark.createDataFrame(rows, T.StructType(CHANGE.fields[1:])))

    def write_batch(self, changes: DataFrame, source: str | None = None, source_batch: int | None = None) -> bool:
        """Commits changes (key, value, is_tombstone and, if a key may repeat, seq) as one batch, then flushes if due.

        An input seq orders changes within the batch. False if the source's micro-batch was committed before.
        Without seq, which of several changes of one key wins is not defined. A change without a key is an error: nothing is committed.
        """
        self._check_lease()
        if source is not None and self.manifest.sources.get(source, -1) >= source_batch:
            return False
        n = self.manifest.next_batch
        within = F.col("seq") if "seq" in changes.columns else F.lit(0)
        typed = changes.select(
            within.cast("long").alias("seq"),
            F.coalesce(F.col("key").cast("binary"), F.raise_error(F.lit("a change needs a key")).cast("binary")).alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.coalesce("is_tombstone", F.lit(False)).alias("is_tombstone"),
        )
        temp = f"_tmp-{uuid.uuid4().hex}"
        typed.write.parquet(self.files.path(temp))
        if source is not None:
            self.files.create(f"{temp}/_source.json", json.dumps([source, source_batch]))
        self._check_lease()
        self.files.rename(temp, f"wal/batch-{n:012d}")
        sources = self.manifest.sources | ({source: source_batch} if source is not None else {})
        self.manifest = replace(self.manifest, next_batch=n + 1, sources=sources)
        self.checked_flush()
        return True

    def _sources_of_log(self) -> None:
        for n in range(self.manifest.first_batch, self.manifest.next_batch):
            if self.files.exists(name := f"wal/batch-{n:012d}/_source.json"):
                source, batch = json.loads(self.files.read(name))
                if self.manifest.sources.get(source, -1) < batch:
                    self.manifest = replace(self.manifest, sources=self.manifest.sources | {source: batch})

    # Reading

    def memtable(self) -> DataFrame:
        """Newest version of each key that is only in the log: key, value, is_tombstone."""
        batches = [n for n in range(self.manifest.first_batch, self.manifest.next_batch) if self.files.exists(f"wal/batch-{n:012d}")]
        if not batches:
            return self.spark.createDataFrame([], T.StructType(CHANGE.fields[1:]))
        paths = [self.files.path(f"wal/batch-{n:012d}") for n in batches]
        rows = self.spark.read.schema(CHANGE).parquet(*paths)
        batch = F.substring(F.substring_index(F.col("_metadata.file_path"), "/batch-", -1), 1, 12).cast("long")
        newest = merge.newest(rows.withColumn("_batch", batch), [F.col("_batch").desc(), F.col("seq").desc()])
        return newest.select("key", "value", "is_tombstone")

    def _records(self, runs: list[Run]) -> DataFrame:
        """Records of runs with their recency: level, id."""
        empty = self.spark.createDataFrame([], "key binary, value binary, is_tombstone boolean, level long, id long")
        if not runs:
            return empty
        rows = self.spark.read.schema(T.StructType(CHANGE.fields[1:])).parquet(*(self.files.path(r.path) for r in runs))
        place = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"level=(\d+)/(\d+)-", i).cast("long")
        return rows.withColumn("level", place(1)).withColumn("id", place(2))

    def versions(self, runs: list[Run] | None = None) -> DataFrame:
        """All versions of all keys in the memtable (as level -1) and the runs given, or all runs."""
        mem = self.memtable().withColumn("level", F.lit(-1).cast("long")).withColumn("id", F.lit(0).cast("long"))
        return mem.unionByName(self._records(list(self.manifest.runs) if runs is None else runs))

    def snapshot(self) -> DataFrame:
        return merge.snapshot(self.versions(), merge.run_recency()).select("key", "value")

    def get(self, key: bytes) -> bytes | None:
        """The value of a key: only runs whose range holds it are read."""
        runs = [r for r in self.manifest.runs if r.meets(key.hex(), key.hex())]
        rows = merge.point_get(self.versions(runs), bytearray(key), merge.run_recency()).select("value").collect()
        return bytes(rows[0]["value"]) if rows and rows[0]["value"] is not None else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value, found of every distinct asked key. Only runs between the least and the greatest of them are read, and
        of up to INLINE_KEYS the runs' key filters are asked."""
        low, high, n = keys.agg(F.min("key"), F.max("key"), F.count_distinct("key")).first()
        runs = [] if low is None else [r for r in self.manifest.runs if r.meets(bytes(low).hex(), bytes(high).hex())]
        versions = self.versions(runs)
        if 0 < n <= INLINE_KEYS:
            versions = versions.filter(F.col("key").isin([r["key"] for r in keys.select("key").filter("key IS NOT NULL").distinct().collect()]))
        return merge.multi_get(versions, keys, merge.run_recency()).select("key", "value", "found")

    def scan(self, low: bytes, high: bytes) -> DataFrame:
        """Live rows between two keys, both inclusive, in key order."""
        runs = [r for r in self.manifest.runs if r.meets(low.hex(), high.hex())]
        return merge.range_scan(self.versions(runs), bytearray(low), bytearray(high), merge.run_recency()).select("key", "value")

    # Flush and compaction

    def _sized(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bytes", entry_bytes(F.col("key"), F.col("value"), F.col("is_tombstone"), self.config))

    def checked_flush(self) -> bool:
        """Flushes if the memtable's size has reached the threshold, then compacts what is due."""
        if not self.flush(self.config.flush_bytes):
            return False
        self.try_compact()
        return True

    def flush(self, least: int = 0) -> bool:
        """Writes the memtable as a run of level 0, in parts of the run size; nothing for an empty one. False if it has less than the least bytes."""
        self._check_lease()
        upto = self.manifest.next_batch
        rows = self.memtable().persist()  # else the log is ranked for the size and again for the run
        try:
            size = self._sized(rows).agg(F.sum("_bytes")).first()[0] or 0
            if size < least:
                return False
            written = self._write_runs(rows, 0, size, one=True)
        finally:
            rows.unpersist()
        if written or upto > self.manifest.first_batch:
            self._commit(replace(self.manifest, runs=self.manifest.runs + tuple(written), next_ids=self._used(written), first_batch=upto))
        return True

    def _used(self, new: list[Run]) -> dict[str, int]:
        ids = dict(self.manifest.next_ids)
        for r in new:
            ids[str(r.level)] = max(ids.get(str(r.level), 0), r.id + 1)
        return ids

    def _write_runs(self, rows: DataFrame, level: int, total: int, one: bool = False) -> list[Run]:
        """Range-partitioned, sorted rows as runs: as many as the bytes given take at most. one: parts of a run, which share an id.

        The rows are written in one go; sizes and ranges of the runs are read back from what was written.
        """
        names = ["key", "value", "is_tombstone"]
        if not total:
            return []
        parts = int(-(-total // self.config.run_bytes))
        dealt = rows.select(*names).coalesce(1) if parts == 1 else rows.select(*names).repartitionByRange(parts, "key")
        temp = f"_tmp-{uuid.uuid4().hex}"
        writer = dealt.withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", "key").write.partitionBy("_part")
        per_run = max(self.config.bloom_keys, self.config.run_bytes // (self.config.put_overhead + 1))
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(per_run)).option(
            "parquet.bloom.filter.fpp#key", str(self.config.bloom_rate)
        ).option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self.files.path(temp))
        self._check_lease()
        # With the schema given: of a merge that left no row, nothing was written that could tell it.
        back = self._sized(self.spark.read.schema(T.StructType([*CHANGE.fields[1:], T.StructField("_part", T.IntegerType())])).parquet(self.files.path(temp)))
        stats = back.groupBy("_part").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()
        first = self.manifest.next_ids.get(str(level), 0)
        runs = []
        for i, s in enumerate(sorted(stats, key=lambda s: bytes(s["a"]))):
            number = first if one else first + i
            path = f"runs/level={level}/{number:012d}-{uuid.uuid4().hex}"
            self.files.rename(f"{temp}/_part={s['_part']}", path)
            runs.append(Run(level, number, path, bytes(s["a"]).hex(), bytes(s["z"]).hex(), s["n"], s["b"]))
        self.files.delete(temp)
        return runs

    def _commit(self, new: Manifest) -> None:
        self._check_lease()
        new = replace(new, version=self.manifest.version + 1)
        if not self.files.create(f"manifest/{new.version}.json", new.dumps()):
            raise RuntimeError("another writer has committed this version")
        self.manifest = new
        self.clean()

    def clean(self) -> None:
        """Deletes manifest versions that a newer one replaced ``keep_seconds`` ago, what no version that is left refers to, and
        what no one commits any more."""
        self._check_lease()
        kept = [self.manifest]
        versions = sorted(int(n.removesuffix(".json")) for n in self.files.names("manifest"))
        for n, newer in zip(versions, versions[1:]):
            if self.files.age(f"manifest/{newer}.json") >= self.config.keep_seconds:
                self.files.delete(f"manifest/{n}.json")
            else:
                kept.append(self._past.get(n) or Manifest.loads(self.files.read(f"manifest/{n}.json")))
        self._past = {m.version: m for m in kept}
        live = {r.path for m in kept for r in m.runs}
        first_batch = min(m.first_batch for m in kept)
        for level in self.files.names("runs"):
            for name in self.files.names(f"runs/{level}"):
                if f"runs/{level}/{name}" not in live:
                    self.files.delete(f"runs/{level}/{name}")
        for name in self.files.names("wal"):
            if int(name.removeprefix("batch-")) < first_batch:
                self.files.delete(f"wal/{name}")
        for name in self.files.names(""):
            if name.startswith("_tmp-"):
                self.files.delete(name)

    def try_compact(self) -> None:
        """Compacts until no level is due: about one merge for each level that is, however many runs have to leave it."""
        level = 0
        while level <= self.manifest.max_level():
            runs = self.manifest.level(level)
            excess = sum(r.bytes for r in runs) - self.config.level_limit(level)
            due = len({r.id for r in runs}) >= self.config.level0_runs if level == 0 else excess > 0
            if not due:
                level += 1
                continue
            self.compact(level, excess)
            if level == 0:
                level = 1

    def compact(self, level: int, excess: int = 0) -> None:
        """Merges level 0, or runs of a deeper level, with what they meet below.

        Of a deeper level it takes the run that the cursor points at and those after it, up to the last one, until they have the
        excess in bytes. The merge passes over a level that it would leave with more than twice its limit, as most of what it
        wrote there would have to go on at once, and takes what it meets there along.
        """
        self._check_lease()
        runs = self.manifest.level(level)
        if not runs:
            return
        cursors = dict(self.manifest.cursors)
        inputs = runs
        if level > 0:
            at = cursors.get(str(level), runs[0].first_key)
            first = max((i for i, r in enumerate(runs) if r.first_key <= at), default=len(runs) - 1)
            end, size = first, 0
            while end < len(runs) and (end == first or size < excess):
                size += runs[end].bytes
                end += 1
            inputs = runs[first:end]
            cursors[str(level)] = runs[end % len(runs)].first_key
        dest = level
        while dest == level or self._overfull(dest, inputs):
            dest += 1
            # Of the union of their ranges: an output may lie across a gap between two inputs.
            low, high = min(r.first_key for r in inputs), max(r.last_key for r in inputs)
            inputs = inputs + [r for r in self.manifest.level(dest) if r.meets(low, high)]
        taken = {r.path for r in inputs}
        kept = tuple(r for r in self.manifest.runs if r.path not in taken)
        merged = merge.newest(self._records(inputs), merge.run_recency())
        merged = merge.purge(merged, dest, max([dest, *(r.level for r in kept)]))
        new = self._write_runs(merged, dest, sum(r.bytes for r in inputs))
        self._commit(replace(self.manifest, runs=kept + tuple(new), next_ids=self._used(new), cursors=cursors))

    def _overfull(self, level: int, inputs: list[Run]) -> bool:
        """Whether a level would have more than twice its limit with a merge of the inputs, some of which may be of that level."""
        taken = {r.path for r in inputs}
        rest = sum(r.bytes for r in self.manifest.level(level) if r.path not in taken)
        return rest + sum(r.bytes for r in inputs) > 2 * self.config.level_limit(level)

    def files_table(self) -> DataFrame:
        """The live runs as a table for the metadata queries."""
        rows = [(r.level, r.id, bytes.fromhex(r.first_key), bytes.fromhex(r.last_key), r.n_rows, r.bytes) for r in self.manifest.runs]
        return self.spark.createDataFrame(rows, "level long, id long, first_key binary, last_key binary, n_rows long, bytes long")
