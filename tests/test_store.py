import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stratalog.config import StoreConfig
from stratalog.operators import log, manifest, merge, runs
from stratalog.sources.storage import Storage
from stratalog.sources.store import CHANGE, Store

SMALL = StoreConfig(flush_bytes=1_000, run_bytes=500, level0_runs=2, level_base=2, level_unit=400)


def batch(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def content(store):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.snapshot().collect()}


def test_store_follows_a_dict_through_flushes_compactions_and_reopening(spark, tmp_path):
    rng, model, store = random.Random(5), {}, Store(spark, str(tmp_path), SMALL)
    seen = set()
    for step in range(6):
        rows = []
        for i in range(60):
            key = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 3)))[:2] if i else b""
            seen.add(key)
            if rng.random() < 0.25:
                model.pop(key, None)
                rows.append((i, bytearray(key), None, True))
            else:
                model[key] = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 12)))
                rows.append((i, bytearray(key), bytearray(model[key]), False))
        store.write_batch(batch(spark, rows))
        assert content(store) == model
        if step % 3 == 2:
            store = Store(spark, str(tmp_path), SMALL)
            assert content(store) == model
    assert store.manifest.max_level() >= 2
    for level in range(1, store.manifest.max_level() + 1):
        at = store.manifest.level(level)
        assert all(a.last_key < b.first_key for a, b in zip(at, at[1:]))
    dead = sorted(seen - set(model))[:2]
    alive = sorted(model)[:2]
    assert [store.get(k) for k in dead] == [None] * len(dead)
    assert [store.get(k) for k in alive] == [model[k] for k in alive]
    low, high = b"\x20", b"\xa0"
    assert [bytes(r["key"]) for r in store.scan(low, high).collect()] == sorted(k for k in model if low <= k <= high)
    asked = spark.createDataFrame([(bytearray(k),) for k in alive + dead], "key binary")
    assert {bytes(r["key"]): r["found"] for r in store.multi_get(asked).collect()} == {k: k in model for k in alive + dead}
    deepest = store._records(store.manifest.level(store.manifest.max_level()))
    assert deepest.filter("is_tombstone").isEmpty()


def test_single_changes_are_visible_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.insert(b"a", b"1")
    store.insert(b"a", b"")
    assert store.get(b"a") == b""
    store.remove(b"a")
    assert store.get(b"a") is None and store.get(b"never") is None
    assert Store(spark, str(tmp_path)).get(b"a") is None


def test_orphans_and_unfinished_files_go_when_a_store_opens(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    store.write_batch(batch(spark, [(i, bytearray(b"k%03d" % i), bytearray(b"v" * 40), False) for i in range(60)]))
    before = content(store)
    (tmp_path / "runs/level=0/000000000099-dead").mkdir(parents=True)
    (tmp_path / "_tmp-x").mkdir()
    again = Store(spark, str(tmp_path), SMALL)
    assert content(again) == before and len(before) == 60
    assert not (tmp_path / "runs/level=0/000000000099-dead").exists() and not (tmp_path / "_tmp-x").exists()


def test_a_micro_batch_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.write_batch(batch(spark, [(0, bytearray(b"a"), bytearray(b"1"), False)]), "s", 0)
    assert not store.write_batch(batch(spark, [(0, bytearray(b"a"), bytearray(b"2"), False)]), "s", 0)
    store = Store(spark, str(tmp_path))
    assert not store.write_batch(batch(spark, [(0, bytearray(b"a"), bytearray(b"2"), False)]), "s", 0)
    assert store.get(b"a") == b"1"


def test_stream_into_a_store(spark, tmp_path):
    from stratalog.streaming.ingest import append_to_store

    for i in range(3):
        batch(spark, [(i, bytearray(b"k"), bytearray(b"%d" % i), False), (i, bytearray(b"x%d" % i), None, True)]).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    append_to_store(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.manifest.next_batch >= 3
    assert set(content(store)) == {b"k"}


def versions(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, is_tombstone boolean, seq long")


def test_a_value_filter_below_the_choice_would_resurrect(spark):
    v = versions(spark, [("a", "1", False, 1), ("a", None, True, 2), ("b", "", False, 1)])
    assert [r["key"] for r in merge.snapshot(v).collect()] == ["b"]
    assert merge.newest(merge.live(v)).count() == 2  # the wrong order differs
    plan = merge.point_get(v, "a")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("key#") or "Filter" in plan


@pytest.mark.parametrize("cut", range(0, 9))
def test_every_torn_log_ends_at_a_batch_boundary(spark, cut):
    ops = ["put", "commit", "put", "del", "commit", "put", "put", "commit", "put"]
    rows = [(i, f"k{i}", op, i == cut) for i, op in enumerate(ops)]
    got = log.replay(spark.createDataFrame(rows, "seq long, key string, op string, corrupt boolean")).collect()
    last = max((i for i in range(cut) if ops[i] == "commit"), default=-1)
    assert sorted(r["seq"] for r in got) == [i for i in range(last) if ops[i] != "commit"]
    assert all(r["batch"] == sum(ops[j] == "commit" for j in range(r["seq"])) for r in got)


def test_batch_numbers_do_not_depend_on_blocks(spark):
    rows = [(i, "commit" if i % 5 == 3 else "put") for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, op string")
    a, b = ({r["seq"]: r["batch"] for r in log.with_batches(df, block).collect()} for block in (7, 1 << 16))
    assert a == b and a[99] == 20


@pytest.mark.parametrize("sizes", [[1, 5, 30, 120], [7], [0, 50, 100], [101], [0]])
def test_split_matches_the_greedy_fold(spark, sizes):
    rng = random.Random(1)
    rows = [(g, i, rng.choice(sizes)) for g, n in (("a", 900), ("b", 3), (None, 500)) for i in range(n)] + [("a", 950 + i, 40) for i in range(3)]
    want = {}
    for g in ("a", "b", None):
        used, file = None, -1
        for _, i, b in sorted(r for r in rows if r[0] == g):
            if used is None or used + b > 100:
                used, file = 0, file + 1
            used += b
            want[g, i] = file
    asked = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}  # many short parts
    before = {k: spark.conf.get(k) for k in asked}
    for conf in (asked, before):
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = runs.split_files(spark.createDataFrame(rows, "grp string, ord long, bytes long").repartition(5), 100)
        assert {(r["grp"], r["ord"]): r["file"] for r in got.collect()} == want


def test_split_of_numbered_groups_ties_and_nothing(spark):
    rows = [(g, o, 60) for g in (1, None, 2) for o in (5, 5, 5, 6)]
    got = runs.split_files(spark.createDataFrame(rows, "grp long, ord long, bytes long"), 120).groupBy("grp", "file").count().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((g, f, 2)) for g in (1, None, 2) for f in (0, 1))
    assert runs.split_files(spark.createDataFrame([], "grp long, ord long, bytes long"), 120).isEmpty()


def test_big_endian_keys_sort_like_numbers(spark):
    from stratalog.functions.keys import big_endian

    nums = [-(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in reversed(nums)], "n long").orderBy(big_endian(F.col("n"))).collect()
    assert [r["n"] for r in rows] == nums


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    from stratalog.functions import bloom

    bits, hashes = bloom.sized(1000, 0.05)
    inside, probes = spark.range(1000).withColumnRenamed("id", "k"), spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"]: r["maybe"] for r in bloom.probe(probes, "k", bloom.build(inside, "k", bits, hashes), bits, hashes).collect()}
    assert all(got[k] for k in range(1000)) and len(got) == 5000
    assert sum(got[k] for k in range(1000, 5000)) < 0.1 * 4000


def test_rotation_and_order_on_empty_tables(spark):
    none = spark.createDataFrame([], "level long, id long, first_key string, last_key string, n_rows long, bytes long")
    assert manifest.rotation_next(none).isEmpty() and manifest.overlaps(none).isEmpty() and manifest.order(none).isEmpty()


def test_a_merge_that_deletes_everything_leaves_no_run(spark, tmp_path):
    store = Store(spark, str(tmp_path), SMALL)
    keys = [b"%d" % i for i in range(3)]
    for deleted in (False, True):
        store.write_batch(batch(spark, [(i, bytearray(k), None if deleted else bytearray(b"v"), deleted) for i, k in enumerate(keys)]))
        store.flush()
    store.compact(0)
    assert store.manifest.runs == () and store.snapshot().isEmpty() and store.get(keys[0]) is None
    store.insert(keys[0], b"w")
    assert content(store) == content(Store(spark, str(tmp_path), SMALL)) == {keys[0]: b"w"}


def test_a_change_without_a_key_is_an_error_and_commits_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="a change needs a key"):
        store.write_batch(batch(spark, [(1, bytearray(b"a"), bytearray(b"1"), False), (2, None, bytearray(b"2"), False)]))
    store.write_batch(batch(spark, []))
    assert content(store) == content(Store(spark, str(tmp_path))) == {}


def numbered(n, size=40, first=0):
    return [(i, bytearray(b"k%06d" % (first + i)), bytearray(b"v" * size), False) for i in range(n)]


@pytest.mark.parametrize("refused", ["wal/", "runs/"])
def test_a_failed_rename_is_an_error_and_loses_nothing(spark, tmp_path, monkeypatch, refused):
    store = Store(spark, str(tmp_path), SMALL)
    store.write_batch(batch(spark, numbered(5)))
    before, real = content(store), Storage.rename

    class Refusing:
        """Hadoop's file system, with a rename that returns False, as it does on failure."""

        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if f"/{refused}" in b.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    store.files._fs = Refusing(store.files._fs)
    with pytest.raises(OSError):
        store.write_batch(batch(spark, numbered(60, first=100)))
    assert real is Storage.rename
    again = Store(spark, str(tmp_path), SMALL)
    after = content(again)
    # The batch counts if it was in place before the flush failed; half of it never does.
    assert after == (before if refused == "wal/" else before | {b"k%06d" % (100 + i): b"v" * 40 for i in range(60)})


def test_a_name_in_use_is_not_renamed_into(spark, tmp_path):
    files = Storage(spark, str(tmp_path))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    with pytest.raises(OSError):
        files.rename("a", "b")


def test_readers_and_a_writer_do_not_disturb_each_other(spark, tmp_path):
    writer = Store(spark, str(tmp_path), SMALL)
    writer.write_batch(batch(spark, numbered(60)))
    (tmp_path / "_tmp-in-progress").mkdir()
    reader = Store(spark, str(tmp_path), SMALL, read_only=True)
    assert (tmp_path / "_tmp-in-progress").exists() and len(content(reader)) == 60
    old = reader.snapshot()
    writer.write_batch(batch(spark, numbered(60, first=30)))  # flushes and compacts
    assert old.count() == 60 and len(content(reader)) == 60
    reader.refresh()
    assert len(content(reader)) == 90
    assert old.count() == 60
    runs = lambda: {r for level in writer.files.names("runs") for r in writer.files.names(f"runs/{level}")}
    held = runs()
    Store(spark, str(tmp_path), replace(SMALL, keep_seconds=0))
    assert runs() < held and {r.path.rpartition("/")[2] for r in writer.manifest.runs} == runs()
    for change in (lambda: reader.insert(b"a", b"b"), reader.flush):
        with pytest.raises(RuntimeError):
            change()
    assert not (tmp_path / "_tmp-in-progress").exists()


def test_a_second_writer_shuts_the_first_out(spark, tmp_path):
    first = Store(spark, str(tmp_path), SMALL)
    first.write_batch(batch(spark, numbered(5)))
    second = Store(spark, str(tmp_path), SMALL)
    for change in (lambda: first.insert(b"a", b"b"), first.flush, lambda: first.remove(b"k000001")):
        with pytest.raises(RuntimeError):
            change()
    second.insert(b"b", b"c")
    assert second.get(b"a") is None and second.get(b"b") == b"c" and second.get(b"k000001") is not None


def test_a_large_batch_is_flushed_in_parts_of_one_run(spark, tmp_path):
    config = StoreConfig(flush_bytes=1_000, run_bytes=20_000)
    store = Store(spark, str(tmp_path), config)
    store.write_batch(batch(spark, numbered(3_000)))
    parts = store.manifest.level(0)
    assert len(parts) > 5 and {r.id for r in parts} == {0} and sum(r.n_rows for r in parts) == 3_000
    ordered = sorted(parts, key=lambda r: r.first_key)
    assert all(a.last_key < b.first_key for a, b in zip(ordered, ordered[1:])) and max(r.bytes for r in parts) < 2 * 20_000
    for i in range(2):  # one run of many parts is one run
        store.write_batch(batch(spark, numbered(30, first=5_000 + i)))
    assert {r.level for r in store.manifest.runs} == {0} and len(content(store)) == 3_031


def test_level_sizes_stay_within_their_limits(spark, tmp_path):
    rng = random.Random(9)
    config = StoreConfig(flush_bytes=40_000, run_bytes=40_000, level0_runs=2, level_base=2, level_unit=60_000)
    store = Store(spark, str(tmp_path), config)
    for _ in range(5):
        store.write_batch(batch(spark, [(i, bytearray(rng.randbytes(100)), None if rng.random() < 0.2 else bytearray(rng.randbytes(300)), False) for i in range(120)]))
    assert store.manifest.max_level() >= 1
    for level in range(1, store.manifest.max_level() + 1):
        assert sum(r.bytes for r in store.manifest.level(level)) <= config.level_limit(level)
    assert len({r.id for r in store.manifest.level(0)}) < config.level0_runs


def test_many_runs_leave_their_levels_in_few_merges(spark, tmp_path):
    rng, model = random.Random(4), {}
    config = StoreConfig(flush_bytes=1, run_bytes=1_000, level0_runs=1, level_base=2, level_unit=1_000)
    store = Store(spark, str(tmp_path), config)
    held = set()
    # Wide and narrow batches in turn: the narrow ones leave runs on the upper levels, which wide ones pass over.
    for step, (n, low, high) in enumerate([(400, 0, 800), (40, 100, 160), (20, 700, 760), (150, 0, 800), (10, 300, 900)]):
        rows = []
        for i, k in enumerate(rng.sample(range(low, high), n)):
            key, value = b"k%06d" % k, b"%d" % step * 40
            if rng.random() < 0.3:
                model.pop(key, None)
                rows.append((i, bytearray(key), None, True))
            else:
                model[key] = value
                rows.append((i, bytearray(key), bytearray(value), False))
        before = store.manifest.version
        store.write_batch(batch(spark, rows))
        m = store.manifest
        held |= {r.level for r in m.runs}
        assert m.version - before <= 1 + m.max_level()  # a flush and a merge for each level, where there are up to 30 runs
        assert content(store) == model and not m.level(0)
        for level in range(1, m.max_level() + 1):
            runs = m.level(level)
            assert all(a.last_key < b.first_key for a, b in zip(runs, runs[1:])) and sum(r.bytes for r in runs) <= config.level_limit(level)
    assert len(held) > 2 and content(Store(spark, str(tmp_path), config)) == model


def test_a_flush_ranks_the_log_once_and_keeps_nothing(spark, tmp_path, monkeypatch):
    asked, real = [], Store.memtable
    monkeypatch.setattr(Store, "memtable", lambda store: asked.append(real(store)) or asked[-1])
    store = Store(spark, str(tmp_path), SMALL)
    for n, flushed in ((5, False), (60, True)):
        asked.clear()
        store.write_batch(batch(spark, numbered(n)))
        assert bool(store.manifest.runs) == flushed and len(asked) == 1
        assert not asked[0].storageLevel.useMemory and not asked[0].storageLevel.useDisk


def test_files_are_moved_without_looking_up_classes(spark, tmp_path):
    files = Storage(spark, str(tmp_path))
    (tmp_path / "a").mkdir()
    files._jvm = None
    files.rename("a", "b/c")
    assert files.names("b") == ["c"]


def test_runs_carry_a_key_filter_that_outlives_the_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path), StoreConfig(flush_bytes=1_000))
    rng = random.Random(3)
    keys = [rng.randbytes(12) for _ in range(4_000)]
    store.write_batch(batch(spark, [(i, bytearray(k), bytearray(b"v"), False) for i, k in enumerate(keys)]))
    store = Store(spark, str(tmp_path), read_only=True)
    jvm = spark.sparkContext._jvm
    (run,) = store.manifest.runs
    (name,) = [n for n in store.files.names(run.path) if n.endswith(".parquet")]
    footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(spark.sparkContext._jsc.hadoopConfiguration(), store.files._p(f"{run.path}/{name}"))
    columns = footer.getBlocks().get(0).getColumns()
    filters = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in columns}
    assert filters["key"] > 0 and filters["value"] < 0
    # The scan of a get is given the key, so absent keys inside the run's range are not read.
    absent = [rng.randbytes(12) for _ in range(12)]
    read = 0
    for k in absent:
        rows = store.versions([run]).filter(F.col("key") == F.lit(bytearray(k)))
        plan = rows._jdf.queryExecution().executedPlan()
        rows.collect()
        metric = [s for s in _scans(plan) if "level=" in s.metadata().apply("Location") or "runs" in s.metadata().apply("Location")]
        read += sum(s.metrics().apply("numOutputRows").value() for s in metric)
    assert read <= 3 * 4_000  # most of the twelve; without the filter 48,000
    assert [store.get(k) for k in absent] == [None] * 12 and store.get(keys[7]) == b"v"
    asked = spark.createDataFrame([(bytearray(k),) for k in keys[:3] + absent[:2]], "key binary")
    assert sorted(r["found"] for r in store.multi_get(asked).collect()) == [False, False, True, True, True]
    many = spark.createDataFrame([(bytearray(k),) for k in keys[:50] + absent], "key binary")
    assert store.multi_get(many).filter("found").count() == 50 and store.multi_get(asked.limit(0)).isEmpty()


def _scans(plan):
    name = plan.getClass().getSimpleName()
    if name == "FileSourceScanExec":
        return [plan]
    if name == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    children = plan.children()
    found = [s for i in range(children.size()) for s in _scans(children.apply(i))]
    return found + (_scans(plan.plan()) if name.endswith("QueryStageExec") else [])


def test_an_upsert_is_one_aggregate(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "key string, value string, seq long")
    changes = spark.createDataFrame([("a", "3", 3), ("a", "4", 4), ("c", None, 1)], "key string, value string, seq long")
    got = merge.upsert(rows, changes)
    assert sorted(map(tuple, got.collect())) == [("a", "4", 4, False), ("b", "2", 2, False), ("c", None, 1, True)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_torn_tails(spark):
    ops = ["put", "commit", "put", "del", "commit", "put", "put", "commit", "put"]
    rows = spark.createDataFrame(list(enumerate(ops)), "seq long, op string")
    got = {r["cut"]: tuple(r)[1:] for r in log.torn_tails(rows, range(10)).collect()}
    for cut in range(10):
        last = max((i for i in range(min(cut, 9)) if ops[i] == "commit"), default=None)
        upto = -1 if last is None else last
        assert got[cut] == (last, sum(o == "commit" for o in ops[: upto + 1]), sum(o != "commit" for o in ops[: upto + 1]))


@pytest.mark.parametrize("most", [1, 5, 1024])
def test_range_joins_match_all_pairs(spark, monkeypatch, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(0, 4)))
    ranges = [tuple(sorted((word(), word()))) for _ in range(150)]
    rows = [(rng.randrange(3), i, a, z, 1, 1) for i, (a, z) in enumerate(ranges)]
    files = spark.createDataFrame(rows, "level long, id long, first_key string, last_key string, n_rows long, bytes long")
    real = manifest.bins
    monkeypatch.setattr(manifest, "bins", lambda f: real(f, most))
    got = sorted(map(tuple, manifest.overlaps(files).collect()))
    assert got == sorted((a[0], a[1], b[1]) for a in rows for b in rows if b[0] == a[0] + 1 and b[3] >= a[2] and b[2] <= a[3])
    asked = sorted({word() for _ in range(60)})
    keys = spark.createDataFrame([(k,) for k in asked + asked[:3]] + [(None,)], "key string")
    got = sorted(map(tuple, manifest.runs_for_keys(files, keys).collect()))
    assert got == sorted((k, r[0], r[1]) for k in asked for r in rows if r[2] <= k <= r[3])


def test_no_range_join_compares_all_pairs(spark):
    files = spark.createDataFrame([(1, 1, "a", "b", 1, 1)], "level long, id long, first_key string, last_key string, n_rows long, bytes long")
    for df in (manifest.overlaps(files), manifest.runs_for_keys(files, spark.createDataFrame([("a",)], "key string"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
