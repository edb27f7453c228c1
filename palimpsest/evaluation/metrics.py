"""Evaluation algebra: rates, intervals, agreement, and comparisons of runs."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: Column | str, q: float) -> Column:
    """Percentile by the rounded nearest rank, an aggregate: element round((n-1)*q) of the sorted values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.try_element_at(ordered, F.floor((F.size(ordered) - 1) * F.lit(q) + 0.5).cast("int") + 1)


def nearest_ranks(rows: DataFrame, key: list[str], value: str, qs: dict[str, float], nulls: bool = False) -> DataFrame:
    """The same for groups of any size: ranks by window, so no group is gathered in one value. With ``nulls`` these count
    too, behind all values."""
    w = Window.partitionBy(*key)
    kept = rows if nulls else rows.filter(F.col(value).isNotNull())
    ranked = kept.withColumn("nth", F.row_number().over(w.orderBy(F.asc_nulls_last(value))) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    place = lambda q: F.floor((F.col("n") - 1) * F.lit(q) + 0.5)
    return ranked.groupBy(*key).agg(*[F.max(F.when(F.col("nth") == place(q), F.col(value))).alias(name) for name, q in qs.items()])


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval, clamped to 0..1; null without trials."""
    n = trials.cast("double")
    p = successes / n
    centre, half = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(n > 0, clamp((centre - half) / scale)), F.when(n > 0, clamp((centre + half) / scale))


def confusion(pairs: DataFrame, a: str, b: str, key: list[str] | None = None) -> DataFrame:
    cell = lambda x, y, name: F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(name)
    return pairs.groupBy(*(key or [])).agg(cell(1, 1, "tp"), cell(1, 0, "fp"), cell(0, 1, "fn"), cell(0, 0, "tn"))


def kappa_of(table: DataFrame) -> DataFrame:
    """Adds ``agreement``, ``kappa`` and ``kappa_se`` to confusion counts (tp, fp, fn, tn)."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p11, p10, p01, p00 = (F.col(c) / n for c in ("tp", "fp", "fn", "tn"))
    row1, col1 = p11 + p10, p11 + p01
    row0, col0 = 1 - row1, 1 - col1
    observed, expected = p11 + p00, row1 * col1 + row0 * col0
    kappa = F.when(F.round(expected, 12) == 1, (F.round(observed, 12) == 1).cast("double")).otherwise((observed - expected) / (1 - expected))
    k = F.col("kappa")
    diagonal = p11 * F.pow(1 - (row1 + col1) * (1 - k), F.lit(2)) + p00 * F.pow(1 - (row0 + col0) * (1 - k), F.lit(2))
    off = F.pow(1 - k, F.lit(2)) * (p10 * F.pow(col1 + row0, F.lit(2)) + p01 * F.pow(col0 + row1, F.lit(2)))
    variance = (diagonal + off - F.pow(k - expected * (1 - k), F.lit(2))) / (n * F.pow(1 - expected, F.lit(2)))
    se = F.when(F.round(expected, 12) < 1, F.sqrt(F.greatest(F.lit(0.0), variance)))
    return table.withColumn("agreement", observed).withColumn("kappa", kappa).withColumn("kappa_se", se)


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test; ties carry no sign."""
    n = wins + losses
    return 1.0 if n == 0 else min(1.0, 2.0 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def paired_bootstrap(a: list[float], b: list[float], iterations: int = 20_000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float, float, float]:
    """(mean difference, low, high, two-sided level) by resampling pairs with the standard generator."""
    if not a or len(a) != len(b):
        raise ValueError("needs paired scores")
    gaps, n, draw = [x - y for x, y in zip(a, b, strict=True)], len(a), random.Random(seed).randrange
    means = sorted(sum(gaps[draw(n)] for _ in range(n)) / n for _ in range(iterations))
    mean = sum(gaps) / n
    beyond = sum(m <= 0 for m in means) if mean >= 0 else sum(m >= 0 for m in means)
    return mean, means[int(alpha / 2 * iterations)], means[min(iterations - 1, int((1 - alpha / 2) * iterations))], min(1.0, 2 * beyond / iterations)


def auroc(rows: DataFrame, score: str, label: str, key: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with half for ties; null if a class is empty. Ranks are of distinct scores, so ties cost nothing."""
    key = key or []
    levels = rows.groupBy(*key, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = levels.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    total = wins.groupBy(*key).agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*key, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auroc"))


def retrieval_quality(ranked: DataFrame, gold: DataFrame, k: int = 6, size: DataFrame | None = None) -> DataFrame:
    """Per query: recall, any and reciprocal rank at ``k``; queries without a hit count as zero.

    Where ``size(query_id, n_gold)`` is given, ``gold(query_id, id)`` need hold no more than what is ranked.
    """
    hits = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    if size is None:
        size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    joined = size.join(hits, "query_id", "left")
    found = F.coalesce("hits", F.lit(0))
    return joined.select("query_id", (found / F.col("n_gold")).alias("recall"), (found > 0).cast("int").alias("any_hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def pareto_frontier(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points that no cheaper or equally cheap one matches."""
    before = F.max(gain).over(Window.orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("before", before).filter(F.col("before").isNull() | (F.col(gain) > F.col("before"))).drop("before")


def log_budget_mean(points: DataFrame, cost: str, gain: str, low: float, high: float) -> DataFrame:
    """Mean best gain under a budget that is log-uniform in [low, high]."""
    front = pareto_frontier(points, cost, gain).withColumn("lo", F.least(F.lit(high), F.greatest(F.lit(low), F.col(cost))))
    after = F.coalesce(F.lead("lo").over(Window.orderBy(cost)), F.lit(high))
    part = F.col(gain) * F.log(after / F.col("lo"))
    return front.withColumn("part", part).agg((F.sum("part") / math.log(high / low)).alias("score"))


def ratchet(current: DataFrame, pins: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``metric, status, floor``: current values against pinned floors; a floor only rises.

    ``current(metric, value, quotable)``, ``pins(metric, pinned)``.
    """
    joined = current.join(pins, "metric", "full_outer")
    value, pinned, ok = F.col("value"), F.col("pinned"), F.coalesce("quotable", F.lit(False))
    status = (
        F.when(pinned.isNotNull() & (value.isNull() | ~ok), "unverifiable")
        .when(pinned.isNull() & ok, "new")
        .when(pinned.isNull(), "skipped")
        .when(value < pinned - tolerance, "regressed")
        .when(value > pinned + tolerance, "improved")
        .otherwise("held")
    )
    floor = F.when(status.isin("improved", "new"), value).otherwise(pinned)
    return joined.select("metric", status.alias("status"), floor.alias("floor"))


def by_category(rows: DataFrame, category: str, score: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
