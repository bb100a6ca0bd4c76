"""The engine's queries over the driver's tables, each beside the SQL that gives the same rows.

The events table stands in for a changelog: key is the user, seq the event, an error deletes. In the store layout every event is
in a run: the newest two fifths are on level 0, whose runs are blocks of 1,000 events cut by key, and the older ones on level 1,
whose runs are disjoint key ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import StoreConfig
from .functions import bloom
from .functions.keys import entry_bytes, padded
from .operators import log, manifest, merge, runs
from .plans import compaction
from .sources.storage import scratch
from .sources.store import Store
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIMIT_SPLIT = 65_536
LIMIT_FLUSH = 512
SMALL = StoreConfig(flush_bytes=LIMIT_FLUSH, level_unit=100_000)

_BASE = """
cl AS (SELECT event_id AS seq, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, user_id, event_type = 'error' AS is_tombstone,
              CASE WHEN event_type <> 'error' THEN props END AS value, event_type, CAST(floor(event_id / 1000) AS BIGINT) AS id FROM events),
sz AS (SELECT *, CAST(strlen(key) + CASE WHEN is_tombstone THEN 12 ELSE coalesce(strlen(value), 0) + 20 END AS BIGINT) AS bytes FROM cl),
latest AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM sz) WHERE rk = 1),
placed AS (SELECT *, CASE WHEN id * 10 >= 6 * ((SELECT max(id) FROM sz) + 1) THEN 0 ELSE 1 END AS level FROM sz),
leveled AS (SELECT * EXCLUDE (id), CASE level WHEN 0 THEN id * 1000000000 + user_id // 75 ELSE user_id // 40 END AS id FROM placed),
runrec AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY level, id, key ORDER BY seq DESC) AS rk FROM leveled) WHERE rk = 1),
files AS (SELECT CAST(level AS BIGINT) AS level, id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM runrec GROUP BY level, id),
act AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'add' WHEN 'view' THEN 'remove' WHEN 'click' THEN 'new_id' ELSE 'commit' END AS action,
               user_id % 3 AS level, user_id % 17 AS id, lpad(CAST(user_id % 50 AS VARCHAR), 8, '0') AS first_key, lpad(CAST(user_id % 50 + 40 AS VARCHAR), 8, '0') AS last_key FROM events),
wal AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'commit' WHEN is_tombstone THEN 'del' ELSE 'put' END AS op, seq % 997 = 996 AND seq > (SELECT max(seq) FROM cl) * 0.8 AS corrupt FROM cl),
wok AS (SELECT * FROM wal WHERE seq < coalesce((SELECT min(seq) FROM wal WHERE corrupt), 9e18)),
wb AS (SELECT *, coalesce(sum(CASE WHEN op = 'commit' THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS batch FROM wok),
wc AS (SELECT * FROM wb WHERE op <> 'commit' AND seq < (SELECT max(seq) FROM wok WHERE op = 'commit'))
"""


def _query(name: str, body: str | None = None, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if body:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE.strip()} {body.strip()}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        padded(F.col("user_id")).alias("key"),
        "user_id",
        deleted.alias("is_tombstone"),
        F.when(~deleted, F.col("props")).alias("value"),
        "event_type",
        F.floor(F.col("event_id") / 1000).alias("id"),
    )


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all runs: each run holds one version of a key."""
    rows = changelog(spark, sf_dir)
    n = (log.scalar(rows.agg(F.max("id"))) or 0) + 1
    placed = rows.withColumn("level", F.when(F.col("id") * 10 >= n * 6, 0).otherwise(1).cast("long"))
    young = F.col("id") * 1_000_000_000 + F.floor(F.col("user_id") / 75)
    leveled = placed.withColumn("id", F.when(F.col("level") == 0, young).otherwise(F.floor(F.col("user_id") / 40)))
    return leveled.groupBy("level", "id", "key", "user_id").agg(F.max_by(F.struct("is_tombstone", "value", "seq"), F.col("seq")).alias("_v")).select("level", "id", "key", "user_id", "_v.*")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.ranges(run_records(spark, sf_dir))


def _half(rows: DataFrame, share: float = 0.5) -> float:
    """Where that share of the log ends."""
    return (log.scalar(rows.agg(F.max("seq"))) or 0) * share


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind.isin("signup", "error"), "add").when(kind == "view", "remove").when(kind == "click", "new_id").otherwise("commit").alias("action"),
        (F.col("user_id") % 3).alias("level"),
        (F.col("user_id") % 17).alias("id"),
        padded(F.col("user_id") % 50).alias("first_key"),
        padded(F.col("user_id") % 50 + 40).alias("last_key"),
    )


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changelog(spark, sf_dir)
    end = log.scalar(rows.agg(F.max("seq"))) or 0
    op = F.when(F.col("event_type") == "signup", "commit").when(F.col("is_tombstone"), "del").otherwise("put")
    return rows.withColumn("op", op).withColumn("corrupt", (F.col("seq") % 997 == 996) & (F.col("seq") > end * 0.8))


# Reads


@_query("lww_snapshot", "SELECT key, value, seq FROM latest WHERE NOT is_tombstone")
def lww_snapshot(spark, sf_dir):
    return merge.snapshot(changelog(spark, sf_dir)).select("key", "value", "seq")


@_query("lww_snapshot_aggregate", "SELECT key, value, seq FROM latest WHERE NOT is_tombstone")
def lww_snapshot_aggregate(spark, sf_dir):
    rows = changelog(spark, sf_dir).select("key", "value", "seq", "is_tombstone")
    return merge.live(merge.newest_aggregate(rows)).select("key", "value", "seq")


@_query("point_get", "SELECT key, value, seq FROM latest WHERE NOT is_tombstone AND key = '00000009'")
def point_get(spark, sf_dir):
    return merge.point_get(changelog(spark, sf_dir), "00000009").select("key", "value", "seq")


@_query("multi_get", "SELECT k.key, l.value, l.key IS NOT NULL AS found FROM (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) k LEFT JOIN (SELECT * FROM latest WHERE NOT is_tombstone) l ON k.key = l.key")
def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(padded(F.col("c_custkey")).alias("key"))
    return merge.multi_get(changelog(spark, sf_dir), keys).select("key", "value", "found")


@_query("range_scan", "SELECT key, value, seq FROM latest WHERE NOT is_tombstone AND key BETWEEN '00000010' AND '00000055'")
def range_scan(spark, sf_dir):
    return merge.range_scan(changelog(spark, sf_dir), "00000010", "00000055").select("key", "value", "seq")


@_query("full_scan", "SELECT key, value FROM latest WHERE NOT is_tombstone ORDER BY key")
def full_scan(spark, sf_dir):
    return merge.full_scan(changelog(spark, sf_dir)).select("key", "value")


@_query("entry_count", "SELECT count(*) AS entries, count(*) FILTER (is_tombstone) AS tombstones FROM latest")
def entry_count(spark, sf_dir):
    return merge.newest(changelog(spark, sf_dir)).agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_tombstone").alias("tombstones"))


@_query("key_bounds", "SELECT id, min(key) AS front, max(key) AS back FROM cl GROUP BY id")
def key_bounds(spark, sf_dir):
    return changelog(spark, sf_dir).groupBy("id").agg(F.min("key").alias("front"), F.max("key").alias("back"))


@_query("run_scan", "SELECT key, value, is_tombstone FROM runrec WHERE level = 1 AND id = 0 AND key BETWEEN '00000005' AND '00000020'")
def run_scan(spark, sf_dir):
    return run_records(spark, sf_dir).filter((F.col("level") == 1) & (F.col("id") == 0) & F.col("key").between("00000005", "00000020")).select("key", "value", "is_tombstone")


@_query("level_scan", "SELECT id, key, value, is_tombstone FROM runrec WHERE level = 1")
def level_scan(spark, sf_dir):
    return run_records(spark, sf_dir).filter("level = 1").orderBy("key", "id").select("id", "key", "value", "is_tombstone")


@_query("run_ranges", "SELECT level, id, first_key, last_key, n_rows FROM files")
def run_ranges(spark, sf_dir):
    return files(spark, sf_dir).select("level", "id", "first_key", "last_key", "n_rows")


@_query("runs_for_key", "SELECT k.key, level, id FROM (SELECT DISTINCT key FROM cl) k JOIN files ON first_key <= k.key AND k.key <= last_key")
def runs_for_key(spark, sf_dir):
    return manifest.runs_for_keys(files(spark, sf_dir), changelog(spark, sf_dir).select("key"))


@_query(
    "bloom_probe",
    """, ins AS (SELECT DISTINCT key FROM cl WHERE NOT is_tombstone), cust AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)
    SELECT (SELECT count(*) FROM ins) AS inserted, (SELECT count(*) FROM cust WHERE key NOT IN (SELECT key FROM ins)) AS others, CAST(0 AS BIGINT) AS false_negatives, TRUE AS few_false_positives""",
)
def bloom_probe(spark, sf_dir):
    """The filter over the inserted keys, asked for these and for all customers' keys: none of the former is denied, and of the
    others at most twice the filter's rate pass."""
    puts, *built = inserted_keys_filter(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(padded(F.col("c_custkey")).alias("key")).unionByName(puts)
    probed = bloom.probe(asked, "key", *built).join(puts.withColumn("_in", F.lit(True)), "key", "left")
    inside, passed = F.col("_in").isNotNull(), F.col("maybe")
    counts = probed.agg(
        F.count_if(inside).alias("inserted"), F.count_if(~inside).alias("others"),
        F.count_if(inside & ~passed).alias("false_negatives"), F.count_if(~inside & passed).alias("_passed"),
    )
    return counts.withColumn("few_false_positives", F.col("_passed") <= F.col("others") * (2 * StoreConfig().bloom_rate)).drop("_passed")


def inserted_keys_filter(spark, sf_dir):
    """The inserted keys, and the set bits, number of bits and of hashes of a filter as large as their number takes."""
    puts = changelog(spark, sf_dir).filter("NOT is_tombstone").select("key").distinct()
    bits, hashes = bloom.sized(max(StoreConfig().bloom_keys, puts.count()), StoreConfig().bloom_rate)
    return puts, bloom.build(puts, "key", bits, hashes), bits, hashes


# Writes


@_query(
    "upsert_apply",
    """, half AS (SELECT max(seq) / 2 AS h FROM cl), base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM cl, half WHERE NOT is_tombstone AND seq <= h) WHERE rk = 1),
    delta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM cl, half WHERE NOT is_tombstone AND seq > h) WHERE rk = 1)
    SELECT key, value, seq, NOT (key IN (SELECT key FROM base)) AS is_new FROM delta UNION ALL SELECT key, value, seq, FALSE FROM base WHERE key NOT IN (SELECT key FROM delta)""",
)
def upsert_apply(spark, sf_dir):
    puts = changelog(spark, sf_dir).filter("NOT is_tombstone").select("key", "value", "seq")
    half = _half(changelog(spark, sf_dir))
    base = merge.newest(puts.filter(F.col("seq") <= half))
    return merge.upsert(base, puts.filter(F.col("seq") > half))


@_query(
    "delete_apply",
    """, half AS (SELECT max(seq) * 0.95 AS h FROM cl), base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM cl, half WHERE seq <= h) WHERE rk = 1 AND NOT is_tombstone)
    SELECT key, value, seq FROM base WHERE key NOT IN (SELECT key FROM cl, half WHERE is_tombstone AND seq > h)""",
)
def delete_apply(spark, sf_dir):
    rows = changelog(spark, sf_dir)
    half = _half(rows, 0.95)
    base = merge.snapshot(rows.filter(F.col("seq") <= half)).select("key", "value", "seq")
    return merge.delete(base, rows.filter((F.col("seq") > half) & F.col("is_tombstone")))


@_query("old_value", "SELECT seq, key, CASE WHEN lag(is_tombstone) OVER w THEN NULL ELSE lag(value) OVER w END AS old_value FROM cl WINDOW w AS (PARTITION BY key ORDER BY seq)")
def old_value(spark, sf_dir):
    return merge.old_values(changelog(spark, sf_dir)).select("seq", "key", "old_value")


@_query("memtable_size", "SELECT count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM latest")
def memtable_size(spark, sf_dir):
    return runs.memtable_size(changelog(spark, sf_dir))


@_query("flush_plan", f"SELECT user_id % 8 AS shard, CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) >= {LIMIT_FLUSH} AS flush FROM latest GROUP BY 1")
def flush_plan(spark, sf_dir):
    latest = runs.sized(merge.newest(changelog(spark, sf_dir)))
    return latest.groupBy((F.col("user_id") % 8).alias("shard")).agg(F.sum("bytes").alias("bytes")).withColumn("flush", F.col("bytes") >= LIMIT_FLUSH)


@_query(
    "flush_boundaries",
    f""", d AS (SELECT user_id % 8 AS shard, seq, key, bytes, row_number() OVER (PARTITION BY user_id % 8 ORDER BY seq) AS i FROM sz),
    r AS (SELECT shard, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS flush, CAST(0 AS BIGINT) AS next_flush, CAST([] AS STRUCT(k VARCHAR, b BIGINT)[]) AS held FROM (SELECT DISTINCT shard FROM d)
      UNION ALL SELECT shard, i, seq, next_flush, CASE WHEN used >= {LIMIT_FLUSH} THEN next_flush + 1 ELSE next_flush END, CASE WHEN used >= {LIMIT_FLUSH} THEN [] ELSE now END
      FROM (SELECT *, list_sum(list_transform(now, lambda x: x.b)) AS used
            FROM (SELECT d.shard, d.i, d.seq, r.next_flush, list_append(list_filter(r.held, lambda x: x.k <> d.key), {{'k': d.key, 'b': d.bytes}}) AS now FROM r JOIN d ON d.shard = r.shard AND d.i = r.i + 1)))
    SELECT shard, flush, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS changes FROM r WHERE i > 0 GROUP BY shard, flush""",
    recursive=True,
)
def flush_boundaries(spark, sf_dir):
    """Exact flush points of eight stores fed by the changelog; a fold with a memtable as state."""
    rows = changelog(spark, sf_dir).withColumn("shard", F.col("user_id") % 8).withColumn("bytes", entry_bytes(F.col("key"), F.col("value"), F.col("is_tombstone")))
    return runs.flush_boundaries(rows, LIMIT_FLUSH).groupBy("shard", "flush").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("changes"))


@_query("flush_run", "SELECT key, value, is_tombstone, bytes, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM sz WHERE id = (SELECT max(id) FROM sz)) WHERE rk = 1)")
def flush_run(spark, sf_dir):
    """The run that a flush of the last block of changes writes: bounded by the flush threshold, so one window orders it."""
    from pyspark.sql.window import Window

    rows = changelog(spark, sf_dir)
    tail = merge.newest(rows.filter(F.col("id") == log.scalar(rows.agg(F.max("id"))))).withColumn("run", F.lit(1))
    return runs.sized(tail).select("key", "value", "is_tombstone", "bytes", (F.row_number().over(Window.partitionBy("run").orderBy("key")) - 1).cast("long").alias("pos"))


@_query("sparse_index", """SELECT level, id, pos, key, off AS "offset" FROM (SELECT CAST(level AS BIGINT) AS level, id, key, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY level, id) AS n, CAST(coalesce(sum(bytes) OVER (PARTITION BY level, id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM runrec WINDOW w AS (PARTITION BY level, id ORDER BY key)) WHERE pos % 16 = 0 OR pos = n - 1""")
def sparse_index(spark, sf_dir):
    return runs.sparse_index(run_records(spark, sf_dir))


# Merge and compaction


@_query("kway_merge", "SELECT key, value, is_tombstone, CAST(level AS BIGINT) AS level, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, id DESC) AS rk FROM runrec) WHERE rk = 1")
def kway_merge(spark, sf_dir):
    records = run_records(spark, sf_dir)
    return merge.kway_merge([records.filter("level = 0"), records.filter("level = 1")]).select("key", "value", "is_tombstone", "level", "id")


@_query("purge_tombstones", "SELECT dest_level, count(*) FILTER (NOT is_tombstone OR dest_level < 1) AS entries FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, id DESC) AS rk FROM runrec), (VALUES (CAST(0 AS BIGINT)), (1)) d(dest_level) WHERE rk = 1 GROUP BY 1")
def purge_tombstones(spark, sf_dir):
    merged = merge.newest(run_records(spark, sf_dir), merge.run_recency())
    counts = [merge.purge(merged, dest, 1).agg(F.lit(dest).cast("long").alias("dest_level"), F.count(F.lit(1)).alias("entries")) for dest in (0, 1)]
    return counts[0].unionByName(counts[1])


@_query(
    "compact_split",
    f""", d AS (SELECT lang, doc_id, CAST(strlen(coalesce(text, '')) + 28 AS BIGINT) AS b, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM (SELECT coalesce(lang, '') AS lang, doc_id, text FROM documents)),
    r(lang, doc_id, i, file, used) AS (SELECT lang, doc_id, i, CAST(0 AS BIGINT), b FROM d WHERE i = 1
      UNION ALL SELECT d.lang, d.doc_id, d.i, CASE WHEN used + b > {LIMIT_SPLIT} THEN file + 1 ELSE file END, CASE WHEN used + b > {LIMIT_SPLIT} THEN b ELSE used + b END FROM r JOIN d ON d.lang = r.lang AND d.i = r.i + 1)
    SELECT lang, file, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY lang, file""",
    recursive=True,
)
def compact_split(spark, sf_dir):
    """File boundaries of one compaction per language; documents without one are a group of their own."""
    sizes = table(spark, sf_dir, "documents").select(
        F.coalesce("lang", F.lit("")).alias("grp"), F.col("doc_id").alias("ord"), (F.octet_length(F.coalesce("text", F.lit(""))) + 28).cast("long").alias("bytes")
    )
    split = runs.split_files(sizes, LIMIT_SPLIT)
    return split.groupBy(F.col("grp").alias("lang"), "file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ord").alias("first_id"), F.max("ord").alias("last_id"))


@_query("compaction_due", "SELECT level, n_runs, bytes, CASE WHEN level = 0 THEN n_runs >= 4 ELSE bytes > pow(10, level) * 100000 END AS due FROM (SELECT level, count(*) AS n_runs, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY level)")
def compaction_due(spark, sf_dir):
    return compaction.due(files(spark, sf_dir), SMALL)


@_query("compact_inputs_l0", "SELECT level, id FROM files WHERE level = 0 UNION ALL SELECT level, id FROM files WHERE level = 1 AND last_key >= (SELECT min(first_key) FROM files WHERE level = 0) AND first_key <= (SELECT max(last_key) FROM files WHERE level = 0)")
def compact_inputs_l0(spark, sf_dir):
    return compaction.inputs_level0(files(spark, sf_dir))


@_query(
    "compact_l0",
    """, span AS (SELECT min(first_key) AS lo, max(last_key) AS hi FROM files WHERE level = 0), ins AS (SELECT level, id FROM files, span WHERE level = 0 OR (last_key >= lo AND first_key <= hi))
    SELECT key, value FROM (SELECT s.*, row_number() OVER (PARTITION BY key ORDER BY s.level, s.id DESC) AS rk FROM runrec s JOIN ins ON ins.level = s.level AND ins.id = s.id) WHERE rk = 1 AND NOT is_tombstone""",
)
def compact_l0(spark, sf_dir):
    records = run_records(spark, sf_dir)
    taken = manifest.metadata(compaction.inputs_level0(runs.ranges(records)))
    merged = merge.newest(records.join(taken, ["level", "id"], "left_semi"), merge.run_recency())
    return merge.purge(merged, 1, 1).select("key", "value")


@_query("overlap_join", "SELECT a.level, a.id, b.id AS next_id FROM files a JOIN files b ON b.level = a.level + 1 AND b.last_key >= a.first_key AND b.first_key <= a.last_key")
def overlap_join(spark, sf_dir):
    return manifest.overlaps(files(spark, sf_dir))


_CURSOR = """, cur AS (SELECT level, first_key AS k, row_number() OVER (PARTITION BY level ORDER BY first_key, id) AS nth, lead(first_key) OVER (PARTITION BY level ORDER BY first_key, id) AS nxt, id FROM files),
    c AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), '00000090'), (1, '00000030'), (1, '99999999'), (1, NULL)) v(level, compact_key)),
    p AS (SELECT c.level, compact_key, id, row_number() OVER (PARTITION BY c.level, compact_key ORDER BY CASE WHEN compact_key IS NULL THEN nth WHEN k <= compact_key AND compact_key < nxt THEN 0 WHEN nxt IS NULL THEN 1 ELSE 2 END, nth) AS rk FROM c JOIN cur ON cur.level = c.level)"""


def _cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "00000090"), (1, "00000030"), (1, "99999999"), (1, None)], "level long, compact_key string")


@_query("rotation_pick", f"{_CURSOR} SELECT level, compact_key, id FROM p WHERE rk = 1")
def rotation_pick(spark, sf_dir):
    return manifest.rotation_pick(files(spark, sf_dir), _cursors(spark))


@_query("rotation_next", "SELECT level, id, coalesce(lead(first_key) OVER (PARTITION BY level ORDER BY first_key, id), first_value(first_key) OVER (PARTITION BY level ORDER BY first_key, id)) AS next_start FROM files")
def rotation_next(spark, sf_dir):
    return manifest.rotation_next(files(spark, sf_dir))


@_query(
    "rotation_replay",
    """, d AS (SELECT level, seq, action, id, first_key, row_number() OVER (PARTITION BY level ORDER BY seq) AS i FROM act WHERE action IN ('add', 'remove', 'new_id')),
    r AS (SELECT level, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS taken, CAST(NULL AS VARCHAR) AS compact_key, CAST([] AS STRUCT(k VARCHAR, id BIGINT)[]) AS live FROM (SELECT DISTINCT level FROM d)
      UNION ALL SELECT level, i, seq, CASE WHEN due THEN live[place].id END, CASE WHEN due THEN live[place % len(live) + 1].k ELSE compact_key END,
             CASE action WHEN 'new_id' THEN live WHEN 'add' THEN list_sort(list_append(others, {'k': first_key, 'id': id})) ELSE others END
      FROM (SELECT d.level, d.i, d.seq, d.action, d.id, d.first_key, r.compact_key, r.live, d.action = 'new_id' AND len(r.live) > 0 AS due, list_filter(r.live, lambda x: x.id <> d.id) AS others,
                   CASE WHEN r.compact_key IS NULL THEN 1 WHEN len(list_filter(r.live, lambda x: x.k <= r.compact_key)) > 0 THEN len(list_filter(r.live, lambda x: x.k <= r.compact_key)) ELSE len(r.live) END AS place
            FROM r JOIN d ON d.level = r.level AND d.i = r.i + 1))
    SELECT seq, level, taken AS id, compact_key FROM r WHERE taken IS NOT NULL""",
    recursive=True,
)
def rotation_replay(spark, sf_dir):
    """The cursor's way through a log whose id allocations each begin a compaction of their level."""
    rows = actions(spark, sf_dir)
    return manifest.rotation_replay(rows.withColumn("action", F.when(F.col("action") == "new_id", "next_compact").otherwise(F.col("action"))))


@_query("compact_inputs_ln", f"""{_CURSOR}, moved AS (SELECT level + 1 AS level, id, first_key, last_key FROM files), v AS (SELECT m.* FROM p JOIN moved m ON p.rk = 1 AND m.level = p.level + 1 AND m.id = p.id WHERE p.compact_key IS NOT NULL)
    SELECT level, id, level AS victim_level FROM v UNION ALL SELECT m.level, m.id, v.level FROM v JOIN moved m ON m.level = v.level + 1 AND m.last_key >= v.first_key AND m.first_key <= v.last_key""")
def compact_inputs_ln(spark, sf_dir):
    """The events' two levels stand for levels 1 and 2."""
    deeper = files(spark, sf_dir).withColumn("level", F.col("level") + 1)
    cursors = _cursors(spark).filter("compact_key IS NOT NULL").withColumn("level", F.col("level") + 1)
    return compaction.inputs_level(deeper, cursors)


@_query("level_size", "SELECT level, count(*) AS n_runs, CAST(sum(bytes) AS BIGINT) AS bytes, level = (SELECT max(level) FROM files) AS is_max FROM files GROUP BY level")
def level_size(spark, sf_dir):
    sizes = manifest.level_sizes(files(spark, sf_dir))
    return sizes.withColumn("is_max", F.col("level") == log.scalar(sizes.agg(F.max("level"))))


@_query("run_order", "SELECT level, id, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -id END, first_key, last_key, id) AS place FROM files")
def run_order(spark, sf_dir):
    return manifest.order(files(spark, sf_dir)).select("level", "id", "place")


# Manifest

_LIVE = "SELECT level, id, first_key, last_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY level, id ORDER BY seq DESC) AS rk FROM {0} WHERE action IN ('add', 'remove')) WHERE rk = 1 AND action = 'add'"


@_query("manifest_live", _LIVE.format("act"))
def manifest_live(spark, sf_dir):
    return manifest.live_runs(actions(spark, sf_dir))


@_query("next_ids", "SELECT level, count(*) AS next_id FROM act WHERE action = 'new_id' GROUP BY level")
def next_ids(spark, sf_dir):
    return manifest.next_ids(actions(spark, sf_dir))


_COMMITTED = ", com AS (SELECT * FROM act WHERE seq < (SELECT max(seq) FROM act WHERE action = 'commit') AND action <> 'commit')"


def _committed_actions(spark, sf_dir):
    return log.committed(actions(spark, sf_dir).withColumnRenamed("action", "op")).withColumnRenamed("op", "action")


@_query("manifest_replay", f"{_COMMITTED} SELECT l.level, id, first_key, last_key, next_id FROM ({_LIVE.format('com')}) l LEFT JOIN (SELECT level, count(*) AS next_id FROM com WHERE action = 'new_id' GROUP BY level) n ON n.level = l.level")
def manifest_replay(spark, sf_dir):
    done = _committed_actions(spark, sf_dir)
    return manifest.live_runs(done).join(manifest.next_ids(done), "level", "left").select("level", "id", "first_key", "last_key", "next_id")


@_query("manifest_snapshot", f", com AS (SELECT * FROM act WHERE seq <= (SELECT max(seq) / 2 FROM act)) {_LIVE.format('com')}")
def manifest_snapshot(spark, sf_dir):
    """What a checkpoint half-way through the log holds."""
    rows = actions(spark, sf_dir)
    return manifest.live_runs(rows.filter(F.col("seq") <= _half(rows)))


@_query("manifest_recover", f"{_COMMITTED} {_LIVE.format('com')}")
def manifest_recover(spark, sf_dir):
    """A half-way checkpoint and the committed actions after it."""
    rows = actions(spark, sf_dir)
    half = _half(rows)
    checkpoint = manifest.live_runs(rows.filter(F.col("seq") <= half)).withColumn("action", F.lit("add"))
    later = _committed_actions(spark, sf_dir).filter(F.col("seq") > half)
    return manifest.recovered(checkpoint, later.select(*checkpoint.columns))


@_query("orphan_files", f"SELECT DISTINCT level, id FROM act WHERE action = 'add' AND (level, id) NOT IN (SELECT (level, id) FROM ({_LIVE.format('act')}))")
def orphan_files(spark, sf_dir):
    rows = actions(spark, sf_dir)
    return manifest.orphans(rows.filter("action = 'add'").select("level", "id").distinct(), manifest.live_runs(rows))


# Logs


@_query("wal_replay", "SELECT seq, key, value, op, CAST(batch AS BIGINT) AS batch FROM wc")
def wal_replay(spark, sf_dir):
    return log.replay(wal(spark, sf_dir)).select("seq", "key", "value", "op", "batch")


@_query(
    "wal_torn_tail",
    """, cut AS (SELECT k, (SELECT max(seq) FROM wal) * k // 8 AS cut FROM range(1, 9) AS g(k)), lc AS (SELECT cut, (SELECT max(seq) FROM wal WHERE op = 'commit' AND seq < cut) AS last_commit FROM cut)
    SELECT cut, last_commit, count(*) FILTER (op = 'commit' AND seq <= last_commit) AS batches, count(*) FILTER (op <> 'commit' AND seq < last_commit) AS records FROM lc, wal GROUP BY cut, last_commit""",
)
def wal_torn_tail(spark, sf_dir):
    """What survives of the log when it is torn at each eighth of its length."""
    rows = wal(spark, sf_dir)
    end = log.scalar(rows.agg(F.max("seq"))) or 0
    return log.torn_tails(rows, [end * k // 8 for k in range(1, 9)])


@_query("batch_commit", "SELECT CAST(batch AS BIGINT) AS batch, count(*) FILTER (op <> 'commit') AS changes, min(seq) AS first_seq, max(seq) AS last_seq, bool_or(op = 'commit') AS committed FROM wb GROUP BY 1")
def batch_commit(spark, sf_dir):
    rows = log.with_batches(log.intact(wal(spark, sf_dir)))
    is_commit = F.col("op") == "commit"
    return rows.groupBy("batch").agg(F.count_if(~is_commit).alias("changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_or(is_commit).alias("committed"))


@_query(
    "crash_recover",
    """, cut AS (SELECT max(id) * 1000 AS c FROM cl), st AS (SELECT key, value, is_tombstone, seq FROM cl, cut WHERE seq < c UNION ALL SELECT key, value, is_tombstone, seq FROM wc, cut WHERE seq >= c)
    SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rk FROM st) WHERE rk = 1 AND NOT is_tombstone""",
)
def crash_recover(spark, sf_dir):
    """Runs hold all but the last block of changes; the log's committed part gives the rest."""
    rows = changelog(spark, sf_dir)
    cut = (log.scalar(rows.agg(F.max("id"))) or 0) * 1000
    names = ["key", "value", "is_tombstone", "seq"]
    flushed = rows.filter(F.col("seq") < cut).select(*names)
    tail = log.replay(wal(spark, sf_dir)).filter(F.col("seq") >= cut).select(*names)
    return merge.snapshot(flushed.unionByName(tail)).select("key", "value", "seq")


@_query("stream_ingest", "SELECT key, value, seq FROM latest WHERE NOT is_tombstone")
def stream_ingest(spark, sf_dir):
    """The snapshot kept by a stream over the changelog that is run to its end."""
    return ingest.replayed_snapshot(spark, f"{sf_dir}/events.parquet").select("key", "value", "seq")


# Through a store

#: Small enough for the events to be flushed and compacted on their way in.
_TINY = StoreConfig(flush_bytes=512, run_bytes=8_192, level0_runs=2, level_base=2, level_unit=8_192)


def _loaded_store(spark, sf_dir) -> Store:
    """A store that took the events in four batches, opened anew."""
    rows = changelog(spark, sf_dir).select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_tombstone")
    end = (log.scalar(rows.agg(F.max("seq"))) or 0) + 1
    root = scratch(spark, "store")
    store = Store(spark, root, _TINY)
    for k in range(4):
        store.write_batch(rows.filter((F.col("seq") >= end * k // 4) & (F.col("seq") < end * (k + 1) // 4)), "events", k)
    store.write_batch(rows, "events", 3)  # a micro-batch that comes again changes nothing
    return Store(spark, root, _TINY)


@_query("store_snapshot", "SELECT key, value FROM latest WHERE NOT is_tombstone")
def store_snapshot(spark, sf_dir):
    """The events' live rows after batches, flushes, compactions and reopening."""
    return _loaded_store(spark, sf_dir).snapshot().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@_query(
    "store_state",
    """SELECT CAST(4 AS BIGINT) AS batches, CAST(3 AS BIGINT) AS last_source_batch, (SELECT count(*) FROM latest WHERE NOT is_tombstone) AS live_rows, (SELECT count(*) FROM latest WHERE NOT is_tombstone AND key BETWEEN '00000003' AND '00000077') AS scanned_rows,
    TRUE AS disjoint, TRUE AS within_limits, TRUE AS ids_are_new, TRUE AS files_are_live, TRUE AS refuses_a_used_version""",
)
def store_state(spark, sf_dir):
    """What has to hold of a store's levels, ids and files, whatever its runs are; and its counts."""
    store = _loaded_store(spark, sf_dir)
    m = store.manifest
    deep = [m.level(n) for n in range(1, m.max_level() + 1)]
    placed = {f"runs/{level}/{name}" for level in store.files.names("runs") for name in store.files.names(f"runs/{level}")}
    facts = (
        m.next_batch, m.sources["events"], store.snapshot().count(), store.scan(b"00000003", b"00000077").count(),
        all(a.last_key < b.first_key for level in deep for a, b in zip(level, level[1:])),
        len({r.id for r in m.level(0)}) < _TINY.level0_runs and all(sum(r.bytes for r in level) <= _TINY.level_limit(n) for n, level in enumerate(deep, 1)),
        all(r.id < m.next_ids[str(r.level)] for r in m.runs),
        {r.path for r in m.runs} <= placed,
        not store.files.create(f"manifest/{m.version}.json", "{}"),
    )
    names = "batches long, last_source_batch long, live_rows long, scanned_rows long, disjoint boolean, within_limits boolean, ids_are_new boolean, files_are_live boolean, refuses_a_used_version boolean"
    return spark.createDataFrame([facts], names)
