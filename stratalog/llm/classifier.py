"""Quality classifier: random Fourier features, ridge regression by partition sums, isotonic calibration.

Features are shares and logs of whole-text statistics, standardised and clipped. A fixed random map takes them to FEATURES
cosines whose products approximate a Gaussian kernel. Each task sums its rows' normal equations, the
sums are added up in Spark, and the driver solves one small system. Rows of another fold calibrate the raw
scores by pool-adjacent-violators over a fixed grid of bins. Every labelled row takes part, whatever their number:
what reaches the driver depends on FEATURES, SUMS and BINS only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions, written
from .textstats import shares, with_stats

FEATURES = 256
#: Tasks that sum normal equations at most, and groups that these sums are added in.
TASKS, SUMS = 256, 16
BINS = 4096
LOW, HIGH = -0.5, 1.5
RIDGE = 1e-3
CLIP = 3.0
THRESHOLD = 0.7


def fold(doc_id: Column) -> Column:
    """0 to 3: crc32 of the id as text, modulo 4. 2 is held out, 3 calibrates, 0 and 1 fit. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(2))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    grid: np.ndarray | None = None
    value: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.cos(z @ self.w + self.phase) * np.sqrt(2 / self.w.shape[1]), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta if len(x) else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.grid, self.value), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]]) if batch.num_rows else np.empty((0, batch.num_columns - first))


def pav(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to the values, by weight."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 7) -> Model:
    """stats has doc_id and the share columns; labels doc_id and quality (null: left out; no held-out row is used).

    Without any labelled row every score is 0.5; with rows of one fold only, those calibrate too.
    """
    with scratch(stats.sparkSession):
        return _fit(stats, labels, features, seed)


def _fit(stats: DataFrame, labels: DataFrame, features: int, seed: int) -> Model:
    names = list(shares())
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("double").alias("_y"))
    rows = written(stats.join(known, "doc_id").withColumn("_fold", fold(F.col("doc_id"))).filter("_fold <> 2").select("_fold", "_y", *names), "classifier-rows")
    first = rows.agg(*(F.avg(n).alias(n) for n in names), *(F.stddev_pop(n).alias(f"{n}_s") for n in names), F.sum((F.col("_fold") < 2).cast("long")).alias("_fit"), F.sum((F.col("_fold") == 3).cast("long")).alias("_cal")).first()
    d = len(names)
    rng = np.random.default_rng(seed)
    w, phase = rng.normal(size=(d, features)) / np.sqrt(d / 2), rng.uniform(0, 2 * np.pi, features)
    if not first["_fit"] and not first["_cal"]:
        return Model(np.zeros(d), np.ones(d), w, phase, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([first[n] for n in names])
    scale = np.array([first[f"{n}_s"] for n in names])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, phase, np.zeros(features + 1))
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z = model.features(_matrix(b, 1))
            total += z.T @ np.column_stack([z, b.column(0).to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    fitting = rows.filter("_fold < 2") if first["_fit"] else rows
    parts = fitting.select("_y", *names).repartition(min(TASKS, shuffle_partitions(stats.sparkSession))).mapInArrow(sums, "sums binary")
    added = parts.repartitionById(SUMS, F.spark_partition_id() % SUMS).mapInArrow(add, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in added).reshape(size, size + 1)
    n = total[-1, size - 1]
    model.beta = np.linalg.solve(total[:, :size] + RIDGE * n / features * np.eye(size), total[:, size])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip((model.raw(_matrix(b, 1)) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], ["bin", "y"])

    calibrating = rows.filter("_fold = 3") if first["_cal"] else rows
    held = calibrating.select("_y", *names).mapInArrow(bins, "bin bigint, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    model.grid = LOW + (held["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.value = pav((held["y"] / held["n"]).to_numpy(float), held["n"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of stats."""
    names = list(shares())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b, 1)))], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.select("doc_id", *names).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Null texts count as empty and get a score like any other. Repeated ids are scored row by row and count once per row
    in the fit. Empty tables give an empty result. Only the text enters a score.
    """
    stats = written(with_stats(docs).select("doc_id", *(c.cast("double").alias(n) for n, c in shares().items())), "classifier-stats")
    return score(stats, fit(stats, labels))
