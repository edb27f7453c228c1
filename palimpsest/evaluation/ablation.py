"""Ablation arms over one store: each channel is ranked once, and its rows serve every arm that uses it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.evaluation.metrics import retrieval_quality
from palimpsest.operators.channels import DIGITS


@dataclass(frozen=True)
class Arm:
    """Channels to fuse with the constant ``rrf_k``; ``rerank`` orders the fused head by another score."""

    name: str
    channels: tuple[str, ...]
    rrf_k: float = 60.0
    rerank: bool = False


#: What is switched on in each arm.
ARMS = (
    Arm("dense_only", ("dense",)), Arm("bm25_only", ("lexical",)), Arm("hybrid_k60", ("dense", "lexical")), Arm("hybrid_k1", ("dense", "lexical"), 1.0),
    Arm("hybrid_rerank", ("dense", "lexical"), rerank=True), Arm("graph_k1", ("dense", "lexical", "graph"), 1.0), Arm("graph_rerank", ("dense", "lexical", "graph"), rerank=True),
)


def ablation(lists: DataFrame, arms: tuple[Arm, ...] = ARMS, depth: int = 50, limit: int = 20, rescored: DataFrame | None = None) -> DataFrame:
    """``arm, query_id, id, score, rank`` of ``lists(channel, query_id, id, rank)``, a channel's rows ranked once.

    Rows are tagged with the arms that use their channel, at most one row an arm; fusion is one aggregation over all arms.
    Arms whose channels are all absent give no rows. ``rescored(query_id, id, rescore)`` orders the first ``depth`` of arms
    that rerank; what it lacks comes last. Equal scores are ordered by id.
    """
    uses = [F.struct(F.lit(a.name).alias("arm"), F.lit(c).alias("channel"), F.lit(a.rrf_k).alias("k"), F.lit(a.rerank).alias("again")) for a in arms for c in a.channels]
    table = lists.sparkSession.range(1).select(F.inline(F.array(*uses)))
    tagged = lists.join(F.broadcast(table), "channel")  # arms by channels
    fused = tagged.groupBy("arm", "again", "query_id", "id").agg(F.round(F.sum(1 / (F.col("k") + F.col("rank"))), DIGITS).alias("score"))
    first = Window.partitionBy("arm", "query_id").orderBy(F.desc("score"), "id")
    head = fused.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= depth)
    if rescored is None:
        return head.filter(F.col("rank") <= limit).drop("again")
    again = head.join(rescored, ["query_id", "id"], "left")
    score = F.when(F.col("again"), F.col("rescore")).otherwise(F.col("score"))
    order = Window.partitionBy("arm", "query_id").orderBy(F.desc_nulls_last("score"), "id")
    ranked = again.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("arm", "query_id", "id", "score", "rank")


def arm_quality(ranked: DataFrame, gold: DataFrame, k: int = 6) -> DataFrame:
    """``arm, questions, recall, any_hit, mrr``: means over all queries with gold; one without a hit counts as zero."""
    arms = ranked.select("arm").distinct()
    asked = arms.crossJoin(gold.select("query_id", "id"))  # a handful of arms
    both = lambda rows: rows.withColumn("query_id", F.struct("arm", F.col("query_id"))).drop("arm")
    told = retrieval_quality(both(ranked), both(asked), k)
    mean: list[Column] = [F.avg(c).alias(c) for c in ("recall", "any_hit", "mrr")]
    return told.groupBy(F.col("query_id.arm").alias("arm")).agg(F.count(F.lit(1)).alias("questions"), *mean)
