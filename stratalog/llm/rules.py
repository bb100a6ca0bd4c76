"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on interpretable statistics. It grows on two thirds of the
labelled rows, adding the condition of the highest information gain (FOIL), and is pruned on the
remaining third, dropping final conditions while that raises its precision there (another third, if the rule falls short).
Covered rows leave, and the next rule is learned, until none reaches the required precision. The list becomes one ordered
Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import BASE, shares, with_stats

#: Labelled rows that the rules are fitted to: those of the smallest hashes, at most so many.
MAX_LABELLED = 20_000
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A rule must be right about this share of the rows left that it rejects. By Laplace's estimate, which doubts rules of
#: few rows, it must reach 0.9 over all rows left and 0.8 on the pruning rows.
PRECISION = 0.95
LAPLACE, LAPLACE_PRUNING = 0.9, 0.8
MIN_COVER = 8
_FOLD = 3
_CUTS = 512


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] > self.cut if self.above else features[self.feature] <= self.cut

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> Rule:
    """Adds the condition of the highest FOIL gain until only bad rows are covered."""
    rule: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(rule) < most and (~bad & live).any():
        p0, n0 = (bad & live).sum(), live.sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            v = x[live, j]
            order = np.argsort(v, kind="stable")
            v, b = v[order], np.r_[0, np.cumsum(bad[live][order])]
            at = np.searchsorted(v, cuts[j], "right")
            for above, p, n in ((False, b[at], at), (True, p0 - b[at], n0 - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, above, float(cuts[j][k])))
        if best[1] is None:
            break
        v, cut = x[live, names.index(best[1].feature)], best[1].cut
        margin = (float(v[v <= cut].max(initial=-np.inf)) + float(v[v > cut].min(initial=np.inf))) / 2
        rule.append(Condition(best[1].feature, best[1].above, margin if np.isfinite(margin) else cut))
        live &= rule[-1].holds(x, names)
    return tuple(rule)


def _laplace(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    hit = covers(rule, x, names)
    return ((bad & hit).sum() + 1) / (hit.sum() + 2)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The prefix of the highest value (right minus wrong, over covered) on the pruning rows; of equal ones the shortest."""

    def value(r: Rule) -> float:
        hit = covers(r, x, names)
        return ((bad & hit).sum() - (~bad & hit).sum()) / max(1, hit.sum())

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (value(r), -len(r)))


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = PRECISION, min_cover: int = MIN_COVER, most_rules: int = 24, most_conditions: int = 4) -> list[Rule]:
    """Ordered rules that reject. Rows must come in an order that does not depend on the labels: every third row prunes.

    Where the rule that a fold gives is not right often enough, the other folds prune in turn; the list ends when none gives one.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and (bad & left).sum() >= min_cover:
        found = (_next_rule(x, bad, names, left, np.arange(len(x)) % _FOLD == k, precision, min_cover, most_conditions) for k in reversed(range(_FOLD)))
        rule = next(filter(None, found), None)
        if rule is None:
            break
        rules.append(rule)
        left &= ~covers(rule, x, names)
    return rules


def _next_rule(x: np.ndarray, bad: np.ndarray, names: list[str], left: np.ndarray, fold: np.ndarray, precision: float, min_cover: int, most_conditions: int) -> Rule | None:
    """A rule grown on the rows left outside a fold and pruned on those in it, if it is right often enough."""
    grow, prune = left & ~fold, left & fold
    if not (bad & grow).any():
        return None
    cuts = []
    for v in x[grow].T:
        u = np.unique(v)
        mid = (u[1:] + u[:-1]) / 2
        cuts.append(mid if len(mid) <= _CUTS else np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, _CUTS)), np.quantile(v[bad[grow]], np.linspace(0, 1, _CUTS))])))
    rule = _grow(x[grow], bad[grow], names, [c if len(c) else np.zeros(1) for c in cuts], most_conditions)
    if not rule:
        return None
    rule = _prune(rule, x[prune], bad[prune], names)
    hit = covers(rule, x, names) & left
    cover, right = int(hit.sum()), int((hit & bad).sum())
    sure = cover >= min_cover and right >= precision * cover and (right + 1) / (cover + 2) >= LAPLACE and _laplace(rule, x[prune], bad[prune], names) >= LAPLACE_PRUNING
    return rule if sure else None


def as_column(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The number of the first rule that holds (from 1), or 0: an ordered CASE WHEN."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column(features)
        for c in rule[1:]:
            cond &= c.column(features)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, **params) -> list[Rule]:
    """Rules learned from at most ``limit`` labelled rows, those of the smallest hashes of their ids.

    Ids may be of any type. Null ids and null labels are left out; repeated ids count once per row. Without bad rows the list is
    empty.
    """
    label = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("_bad"))
    picked = label.orderBy(F.xxhash64("doc_id"), "doc_id", "_bad").limit(limit)
    few = F.broadcast(picked.select("doc_id").distinct())  # at most ``limit`` ids
    features = shares()
    stats = with_stats(docs.join(few, "doc_id", "left_semi").select("doc_id", "text"))
    names = list(features)
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))  # has nothing to do with the labels
    rows = stats.join(F.broadcast(picked), "doc_id").select(order.alias("_h"), "doc_id", "_bad", *(c.alias(n) for n, c in features.items())).toPandas()
    rows = rows.sort_values(["_h", "doc_id", "_bad", *names])
    return learn(rows[names].to_numpy(float), rows["_bad"].to_numpy(bool), names, **params)


def base_failed(min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (first that rejects, else 0), kept: one row per input row.

    A null text has no words and fails the base rules.
    """
    judged = with_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", as_column(rules, shares()))
    return judged.select("doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns, in one pass and without a join."""
    import pyarrow as pa

    from .textstats import SHAPES, base_stats

    names = BASE + SHAPES
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            rows = np.array([base_stats(t or "") for t in b.column(at).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*b.schema.names, *(f"_q_{n}" for n in names)])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"_q_{n} bigint" for n in names)])
    counted = docs.mapInArrow(run, fields)
    # The statistics' own names may clash with the table's (n_chars): judge over renamed columns.
    keys = [f"_k_{i}" for i in range(len(docs.columns))]
    renamed = counted.toDF(*keys, *names)
    good = renamed.withColumn("_rule", as_column(rules, shares())).filter(~base_failed() & (F.col("_rule") == 0))
    return good.select(*(F.col(k).alias(c) for k, c in zip(keys, docs.columns)))
