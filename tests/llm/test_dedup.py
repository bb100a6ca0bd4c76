import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import exact_dedup, simhash

from .edge import ROWS, docs, empty

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep, open_ = (min(named) if named else None), True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and open_
            open_ = open_ and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c) % 3])
def test_exact_groups_on_edge_rows(spark, digest):
    got = exact_dedup.exact_groups(docs(spark), salts=2, digest=digest)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_exact([r[:2] for r in ROWS])


def test_exact_groups_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = exact_dedup.exact_groups(d)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_exact([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_keep_first_keeps_whole_rows(spark):
    d = docs(spark)
    got = exact_dedup.keep_first(d)
    assert got.columns == d.columns
    assert sorted(r["doc_id"] for r in got.filter("doc_id IS NOT NULL").collect()) == [1, 2, 4, 5, 7, 8, 9]


def test_exact_on_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).isEmpty() and exact_dedup.keep_first(empty(spark)).isEmpty()


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= radius)
            if low < label[i]:
                label[i], changed = low, True
    smallest = {}
    for (i, _), l in zip(rows, label):
        if i is not None:
            smallest[l] = min(smallest.get(l, i), i)
    return sorted(repr((i, f, smallest.get(l))) for (i, _), f, l in zip(rows, fps, label))


def result(df):
    return sorted(repr((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in df.collect())


def test_simhash_on_edge_rows(spark):
    assert result(simhash.simhash_classes(docs(spark))) == brute_components([r[:2] for r in ROWS])
    assert simhash.simhash_classes(empty(spark)).isEmpty()


@pytest.mark.parametrize("tile", [8, 4096])
def test_simhash_on_documents(spark, tile):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    assert result(simhash.simhash_classes(d, tile=tile)) == brute_components(rows)


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_join_what_all_pairs_join(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 8, 12).astype(np.uint64)) for _ in range(30)]))
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), tile=tile).collect()
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}

    def roots(pairs):
        up = list(range(len(fps)))

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(fps))]

    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert all((int(fps[at[e["a"]]]) ^ int(fps[at[e["b"]]])).bit_count() <= 2 for e in edges)
    assert roots((at[e["a"]], at[e["b"]]) for e in edges) == roots(near.tolist())


def test_long_chain_is_one_component(spark):
    from stratalog.llm.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 500), (600, 601), (601, 600), (None, 3)], "a long, b long")
    got = {r["v"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 601: 600}


def test_texts_that_share_an_id_keep_a_row_for_each_class(spark):
    texts = ["the quick brown fox jumps over the lazy dog near the river bank today", "numbers and letters stand in columns of a printed table on page nine"]
    rows = [(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (2, texts[1], "en", "a", 1), (2, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1)]
    got = simhash.keep_one_per_class(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((1, t) for t in texts)


def test_every_link_comes_from_a_compared_tile(spark):
    d = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("fp").distinct()
    d = d.unionByName(d.filter("fp % 5 = 0").select(F.expr("fp ^ 5L ^ shiftleft(1L, 40)").alias("fp"))).unionByName(d.filter("fp % 3 = 0").select(F.expr("fp ^ 3L").alias("fp"))).distinct()
    sc = spark.sparkContext
    tiles = (sc.accumulator(0), sc.accumulator(0))
    edges = simhash.links(d, tiles=tiles).collect()
    # Some nine buckets of about 900 rows, eight tiles each: 36 pairs a bucket, of which those of far population counts are skipped.
    assert edges and tiles[0].value > 50 and tiles[1].value > 20
    fps = np.array([r["fp"] for r in d.collect()]).view(np.uint64)
    a, b, compared, skipped = simhash.tile_links(fps, 2)
    n = -(-len(fps) // simhash.ROWS)
    assert compared + skipped == n * (n + 1) // 2 and skipped > 0
    near = {(min(x, y), max(x, y)) for x, y in np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2).tolist() if x != y}
    at = {int(f): i for i, f in enumerate(fps)}
    assert {tuple(sorted((at[int(x)], at[int(y)]))) for x, y in zip(a, b)} <= near
    touched = lambda pairs: {v for p in pairs for v in p}
    assert touched((at[e["a"] % 2**64], at[e["b"] % 2**64]) for e in edges) == touched(near) == touched((at[int(x)], at[int(y)]) for x, y in zip(a, b))


def test_rows_of_a_hot_key_find_their_values(spark):
    from stratalog.llm.common import attach

    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, "x" * 300).when(F.col("id") < 2900, F.col("id").cast("string")).alias("k"))
    table = rows.filter("id <> 2500").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("v")).filter("k IS NOT NULL")
    want = {r["id"]: r["v"] for r in rows.join(table, "k", "left").collect()}
    assert {r["id"]: r["v"] for r in attach(rows, table, "k", ["v"], "id").collect()} == want and want[2500] is None and want[2950] is None
