"""Comparisons of runs: sweeps over widths and steps, second passes, rescoring, and votes over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.evaluation.metrics import nearest_ranks, wilson

#: What a wider setting must gain, cost at most, and fall back at most.
RECALL_MARGIN, LATENCY_FACTOR, MAX_DEGRADED = 0.02, 2.0, 0.02


def clusters(same_as: Column) -> Column:
    """The first member of each sample's cluster; ``same_as`` (from 0) points to an equal earlier sample or itself."""

    def step(done: Column, x: Column) -> Column:
        k = F.size(done)
        return F.array_append(done, F.when((x >= 0) & (x < k), F.get(done, x.cast("int"))).otherwise(k))

    return F.aggregate(same_as, F.array().cast("array<int>"), step)


def majority(same_as: Column) -> Column:
    """``struct<size, first>`` of the largest cluster; of equals the earliest."""
    of = clusters(same_as)
    sized = F.transform(F.array_distinct(of), lambda c: F.struct(F.size(F.filter(of, lambda x: x == c)).alias("size"), (-c).alias("back")))
    best = F.array_max(sized)
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), (-best["back"]).alias("first")))


def width_points(rows: DataFrame, cell: list[str]) -> DataFrame:
    """One row a cell of a sweep: ``rows(..., recall, pool_recall, whole, degraded, ms)`` of single questions."""
    mean = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("recall").alias("recall"),
        F.avg((F.col("recall") > 0).cast("double")).alias("any"),
        F.avg(F.col("whole").cast("double")).alias("all"),
        F.avg("pool_recall").alias("pool_recall"),
        F.avg(F.col("degraded").cast("double")).alias("select_degraded"),
    )
    times = nearest_ranks(rows, cell, "ms", {"p50_ms": 0.5, "p90_ms": 0.9})
    return mean.join(times, cell).withColumn("truncation_loss", F.col("pool_recall") - F.col("recall")).withColumn("retrieval_loss", 1 - F.col("pool_recall"))


def width_verdict(points: DataFrame, base: Column) -> DataFrame:
    """``points`` with ``verdict``: ``degraded``, ``base``, ``better`` or ``keep``, against the cell that ``base`` marks.

    Better is a cell that gains RECALL_MARGIN at under LATENCY_FACTOR times the median latency; without a base all
    others are kept.
    """
    first = F.broadcast(points.filter(base).agg(F.min_by(F.struct(F.col("recall").alias("base_recall"), F.col("p50_ms").alias("base_ms")), "p50_ms").alias("b")))  # one row, null without a base
    met = points.crossJoin(first).select("*", "b.*").drop("b")
    gains = (F.round(F.col("recall") - F.col("base_recall"), 9) >= RECALL_MARGIN) & (F.col("p50_ms") < F.col("base_ms") * LATENCY_FACTOR)
    verdict = F.when(F.col("select_degraded") > MAX_DEGRADED, "degraded").when(base, "base").when(gains, "better").otherwise("keep")
    return met.withColumn("verdict", verdict).drop("base_recall", "base_ms")


def step_points(traces: DataFrame, cell: list[str]) -> DataFrame:
    """One row a step bound, a null one too: ``traces(..., recall, steps, pool, barren, conflicts, ms)`` of single
    investigations; an ``ms`` that is null counts as the longest."""
    mean = traces.groupBy(*cell).agg(
        F.avg("recall").alias("recall"),
        F.avg((F.col("recall") > 0).cast("double")).alias("any"),
        F.avg("steps").alias("mean_steps"),
        F.avg("pool").alias("mean_pool"),
        F.coalesce(F.try_divide(F.sum("barren"), F.sum("steps")), F.lit(0.0)).alias("barren_fraction"),
        F.avg((F.col("conflicts") > 0).cast("double")).alias("conflict_fraction"),
    )
    times = nearest_ranks(traces, cell, "ms", {"p50_ms": 0.5, "p90_ms": 0.9}, nulls=True)
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in cell]
    return mean.alias("m").join(times.alias("t"), same).select("m.*", "p50_ms", "p90_ms")


def rescored(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` with ``judged`` and ``pending``: a verdict counts only for the very answer that was judged.

    ``rows(question_id, answer, ...)``, ``verdicts(question_id, answer, correct)``; of several for a pair all must hold.
    """
    told = verdicts.groupBy("question_id", "answer").agg(F.every("correct").alias("correct"))
    met = rows.join(told, ["question_id", "answer"], "left")
    return met.withColumn("judged", F.col("correct").cast("double")).withColumn("pending", F.col("correct").isNull()).drop("correct")


def shape_table(questions: DataFrame, fires: Column, stratum: str = "stratum") -> DataFrame:
    """How many questions of each stratum a shape fires on."""
    return questions.groupBy(stratum).agg(F.count_if(fires).alias("fires"), F.count(F.lit(1)).alias("of"))


def second_pass(base: DataFrame, arm: DataFrame) -> DataFrame:
    """``question_id, state``: what a second pass did to each row: ``untouched``, ``declined`` again, ``committed``,
    or a fault: ``changed`` without need, ``missing``, ``added``.

    ``base(question_id, response, declined)``, ``arm(question_id, response, declined)``.
    """
    b, a = base.alias("b"), arm.alias("a")
    met = b.join(a, F.col("b.question_id") == F.col("a.question_id"), "full")
    same = F.col("a.response").eqNullSafe(F.col("b.response"))
    state = (
        F.when(F.col("a.question_id").isNull(), "missing")
        .when(F.col("b.question_id").isNull(), "added")
        .when(~F.col("b.declined"), F.when(same, "untouched").otherwise("changed"))
        .when(F.col("a.declined"), F.when(same, "declined").otherwise("changed"))
        .otherwise("committed")
    )
    return met.select(F.coalesce("b.question_id", "a.question_id").alias("question_id"), state.alias("state"))


def gate_rates(texts: DataFrame, caught: Column, key: str = "cohort") -> DataFrame:
    """How many texts of each cohort a gate catches, with Wilson's interval: attacks should be, benign ones not."""
    counts = texts.groupBy(key).agg(F.count_if(caught).alias("caught"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("caught"), F.col("n"))
    return counts.withColumn("rate", F.col("caught") / F.col("n")).withColumn("low", low).withColumn("high", high)
