import pytest

from stratalog.queries import ORACLES, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, SF, QUERIES[name], ORACLES[name])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_flush_boundaries_match_a_fold(spark):
    from stratalog.queries import LIMIT_FLUSH, changelog

    rows = changelog(spark, SF).orderBy("seq").collect()
    state: dict[int, tuple[int, dict]] = {}
    want: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        shard = r["user_id"] % 8
        flush, held = state.get(shard, (0, {}))
        want.setdefault((shard, flush), []).append(r["seq"])
        held = held | {r["key"]: len(r["key"]) + (12 if r["is_tombstone"] else len(r["value"].encode()) + 20)}
        state[shard] = (flush + 1, {}) if sum(held.values()) >= LIMIT_FLUSH else (flush, held)
    got = {(r["shard"], r["flush"]): (r["first_seq"], r["last_seq"], r["changes"]) for r in QUERIES["flush_boundaries"](spark, SF).collect()}
    assert got == {k: (min(v), max(v), len(v)) for k, v in want.items()}


def test_rotation_follows_a_loop_over_the_log(spark):
    from stratalog.queries import actions

    rows = sorted(actions(spark, SF).collect(), key=lambda r: r["seq"])
    live: dict[int, dict[int, str]] = {}
    cursor: dict[int, str] = {}
    want = []
    for r in rows:
        at = live.setdefault(r["level"], {})
        if r["action"] == "add":
            at[r["id"]] = r["first_key"]
        elif r["action"] == "remove":
            at.pop(r["id"], None)
        elif r["action"] == "new_id" and at:
            order = sorted((k, i) for i, k in at.items())
            below = [j for j, (k, _) in enumerate(order) if r["level"] in cursor and k <= cursor[r["level"]]]
            taken = below[-1] if below else len(order) - 1 if r["level"] in cursor else 0
            cursor[r["level"]] = order[(taken + 1) % len(order)][0]
            want.append((r["seq"], r["level"], order[taken][1], cursor[r["level"]]))
    got = [(r["seq"], r["level"], r["id"], r["compact_key"]) for r in QUERIES["rotation_replay"](spark, SF).collect()]
    assert sorted(got) == want and len(want) > 50


def test_filter_of_inserted_keys_excludes_others(spark, monkeypatch):
    from stratalog import queries
    from stratalog.config import StoreConfig
    from stratalog.functions import bloom

    log = spark.range(60_000).selectExpr("concat('k', id) AS key", "id % 3 = 0 AS is_tombstone")
    monkeypatch.setattr(queries, "changelog", lambda spark, sf_dir: log)
    puts, *built = queries.inserted_keys_filter(spark, SF)
    got = bloom.probe(log, "key", *built).join(log, "key").groupBy("is_tombstone").agg({"maybe": "count_if"}).collect()
    passed = dict(map(tuple, got))
    assert puts.count() == passed[False] == 40_000 and passed[True] < 2 * StoreConfig().bloom_rate * 20_000
