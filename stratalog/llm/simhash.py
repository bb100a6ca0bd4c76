"""SimHash near-duplicates: 64-bit fingerprints and an exact tiled search within a Hamming radius.

Equal fingerprints collapse first. What compares two of them, always, is the tiled comparison: fingerprints in order of
population count, cut into tiles, exclusive-or and bit counts of whole tile pairs in numpy, skipping tile pairs
whose counts differ beyond the radius. Comparing everything with everything would grow with the square of the corpus, so what
is compared together is dealt first: distinct fingerprints are cut into ``radius + 2`` blocks of bits, two that differ in at
most ``radius`` bits agree on two blocks at least, and every pair of blocks is hashed into one of as many buckets as keep a
bucket at TILE / 4 rows on average, whatever the size of the corpus. Each bucket is compared in tiles. One above TILE
rows (a popular block pair, a large family of near copies) is dealt as tile pairs to tasks of their own. Links are
thinned to a spanning forest per bucket before they leave the task; components are computed from them in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, scratch, text_or_empty, written
from .components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Rows that one task compares together at most, and rows of a tile within.
TILE, ROWS = 4096, 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PART = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of a UTF-8 text; 0 if it has no word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    shingles = words if k == 1 else [b" ".join(words)] if len(words) < k else list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), _PART):
        raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles[i : i + _PART]]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, k, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that join two trees."""
    up: dict[int, int] = {}
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        while (p := up.get(y, y)) != y:
            up[y] = y = up.get(p, p)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def tile_links(fp: np.ndarray, radius: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A spanning forest of the links among distinct fingerprints (unsigned), and how many tile pairs were compared and skipped."""
    pop = np.bitwise_count(fp)
    order = np.argsort(pop, kind="stable")
    fp, pop = fp[order], pop[order].astype(np.int64)
    first, last = pop[::rows], pop[np.minimum(np.arange(rows, len(fp) + rows, rows), len(fp)) - 1]
    left, right, compared = [], [], 0
    for i in range(len(first)):
        # Tiles ascend in population count: those from i on up to ``end`` are near enough.
        end = int(np.searchsorted(first, last[i] + radius, "right"))
        compared += end - i
        tile, others = fp[i * rows : (i + 1) * rows], fp[i * rows : end * rows]
        x, y = np.nonzero(np.bitwise_count(tile[:, None] ^ others[None, :]) <= radius)
        later = x < y
        left.append(tile[x[later]])
        right.append(others[y[later]])
    a, b = (np.concatenate(left), np.concatenate(right)) if left else (fp, fp)
    keep = _forest(a, b)
    return a[keep], b[keep], compared, len(first) * (len(first) + 1) // 2 - compared


def _compare(radius: int, tiles=None):
    """For mapInArrow over (g, fp) sorted by g: links of each run of g, carrying an unfinished run over.

    tiles: two accumulators for the numbers of tile pairs compared and skipped.
    """

    def links_of(groups: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), len(fp)]
        out = [tile_links(np.unique(fp[s:e]), radius) for s, e in zip(starts, starts[1:])]
        if tiles:
            tiles[0].add(sum(o[2] for o in out))
            tiles[1].add(sum(o[3] for o in out))
        a, b = (np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_g, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            g = np.r_[rest_g, batch.column(0).to_numpy(zero_copy_only=False)]
            f = np.r_[rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            cut = np.searchsorted(g, g[-1], "left") if len(g) else 0  # g ascends
            if cut:
                yield links_of(g[:cut], f[:cut])
            rest_g, rest_f = g[cut:], f[cut:]
        if len(rest_g):
            yield links_of(rest_g, rest_f)

    return run


def _block_keys(fp: Column, radius: int) -> Column:
    """All (table, key): which two blocks, and their bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*[
        F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), blocks[i], blocks[j]).alias("g"))
        for t, (i, j) in enumerate(combinations(range(n), 2))
    ])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, tiles=None) -> DataFrame:
    """distinct(fp) -> edges (a, b) of signed fingerprints whose components are those of all links.

    Which block pairs share a bucket is up to a hash: what is compared together without need costs time, and loses nothing.
    ``tiles`` may give two accumulators, for the tile pairs compared and skipped.
    """
    pairs = (radius + 2) * (radius + 1) // 2
    buckets = max(1, -(-distinct.count() * pairs * 4 // tile))
    rows = distinct.select("fp", F.explode(_block_keys(F.col("fp"), radius)).alias("k")).select(F.pmod(F.col("k.g"), F.lit(buckets)).alias("g"), "fp")
    pops = rows.groupBy("g", F.bit_count("fp").alias("pop")).agg(F.count(F.lit(1)).alias("n"))
    big = written(
        pops.groupBy("g").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("pops")).filter(F.col("total") > tile),
        "simhash-large",
    )
    schema = "a bigint, b bigint"
    if big.isEmpty():
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(radius, tiles), schema)
    light = rows.join(big, "g", "left_anti").select("g", "fp")
    out = light.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(radius, tiles), schema)
    # Tiles of a large group: population count p, and a hash into ceil(n / tile) parts.
    parts = lambda p: F.ceil(F.element_at("pops", p) / F.lit(tile)).cast("int")
    pop = F.bit_count("fp")
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), parts(pop)).cast("int")
    near = F.filter(F.map_keys("pops"), lambda p: F.abs(p - pop) <= radius)
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), parts(p) - 1), lambda s: F.struct(p.alias("p"), s.alias("s")))))
    tiled = rows.join(big, "g").withColumn("own", F.struct(pop.alias("p"), mine.alias("s"))).withColumn("other", F.explode(others))
    named = tiled.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    return out.unionByName(named.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(radius, tiles), schema))


def simhash_classes(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, fp, component_id.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach, itself included. Null and
    wordless texts have fingerprint 0 and link like others. Null ids never name a component unless it has no
    other. Repeated rows are repeated in the result. Empty in, empty out; other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        fps = written(fingerprints(docs, k), "simhash-fps")
        distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")), "simhash-distinct")
        roots = connected_components(written(links(distinct.select("fp"), radius, tile), "simhash-links"))
        named = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "first", "_n", F.coalesce("root", "fp").alias("root"))
        smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = written(named.join(smallest, "root").select("fp", "component_id", "_n"), "simhash-classes")
        kept += [fps, classes]
    # A fingerprint of very many rows (that of all empty texts, say) is no key that its rows are dealt by.
    return attach(fps, classes, "fp", ["component_id"], "doc_id")


def keep_one_per_class(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, all columns, per class: that of the smallest id, and of the smallest digest among texts that share it; rows without an id stay."""
    of, digest = fresh(docs, "_of", "_digest")
    named = docs.filter("doc_id IS NOT NULL").withColumn(digest, F.sha2(text_or_empty(), 256))
    classes = simhash_classes(named.select(F.struct("doc_id", digest).alias("doc_id"), "text"), radius)
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id.doc_id").alias(of), F.col(f"doc_id.{digest}").alias(digest)).distinct()
    match = (named["doc_id"] == kept[of]) & (named[digest] == kept[digest])
    rows = named.join(kept, match, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
    return rows.unionByName(docs.filter("doc_id IS NULL"))
