"""Bootstrap of paired differences: every task draws how often its rows stand in each replicate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS, ALPHA = 20_000, 0.05
#: Replicates of one row that leaves a task.
_BLOCK = 1000


def paired_bootstrap(pairs: DataFrame, a: str, b: str, iterations: int = ITERATIONS, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """One row ``n, mean, low, high, p``: mean of ``a`` - ``b``, its percentile interval and two-sided level.

    In each replicate a row stands a Poisson number of times, seeded by its difference, so the result does not depend
    on how rows are dealt; m rows of one difference are drawn at once, as a Poisson number of mean m, and only distinct
    differences are shuffled. A task adds up its replicates, sums and weights, before they meet. Bounds are the
    replicates at the nearest rank below. Rows with a null or NaN on either side are no pairs. Without pairs all but n is null.
    """
    gap = F.col(a).cast("double") - F.col(b).cast("double")
    gaps = pairs.select(gap.alias("gap")).filter(F.col("gap").isNotNull() & ~F.isnan("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("m"))

    def draw(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weights = np.zeros(iterations), np.zeros(iterations)
        for frame in frames:
            for gap, m in zip(frame["gap"].to_numpy(float), frame["m"].to_numpy(float), strict=True):
                times = np.random.default_rng([seed, int(np.float64(gap + 0.0).view(np.uint64))]).poisson(m, iterations)
                sums += times * gap
                weights += times
        for at in range(0, iterations, _BLOCK):
            part = slice(at, at + _BLOCK)
            yield pd.DataFrame({"replicate": np.arange(iterations)[part], "s": sums[part], "w": weights[part]})

    replicates = gaps.mapInPandas(draw, "replicate long, s double, w double").groupBy("replicate").agg(F.round(F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0)), 12).alias("mean")).filter("mean IS NOT NULL")
    whole = gaps.agg(F.sum("m").alias("n"), F.round(F.sum(F.col("gap") * F.col("m")) / F.sum("m"), 12).alias("mean"))
    ordered = F.array_sort(F.collect_list("mean"))  # as many as there are iterations
    drawn = replicates.agg(ordered.alias("means"))
    at = lambda share: F.get("means", F.least(F.size("means") - 1, F.floor(F.lit(share) * F.size("means")).cast("int")))
    beyond = F.when(F.col("mean") >= 0, F.size(F.filter("means", lambda m: m <= 0))).otherwise(F.size(F.filter("means", lambda m: m >= 0)))
    level = F.when(F.col("n").isNotNull(), F.least(F.lit(1.0), 2 * beyond / F.size("means")))
    return whole.crossJoin(drawn).select(F.coalesce("n", F.lit(0)).alias("n"), "mean", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"), level.alias("p"))  # one row each
