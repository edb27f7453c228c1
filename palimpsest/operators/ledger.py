"""The ledger as an append-only change log, and the views derived from it.

Nothing is updated in place: a change is a row, the current state a view over the rows. So content and times
of creation cannot change, a retraction time is written once (the least wins), and the log is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("add", "update", "delete", "noop")


def current_records(deltas: DataFrame) -> DataFrame:
    """State after all changes of ``deltas(seq, at, op, id, target, t_valid, ...)``.

    Each add and update brings the record ``id``. The first update or delete that names a record as
    ``target`` ends it: an update when its replacement becomes valid, a delete at its own time.
    """
    born = deltas.filter(F.col("op").isin("add", "update"))
    ends = deltas.filter(F.col("op").isin("update", "delete")).select(F.col("target").alias("id"), "seq", F.when(F.col("op") == "update", F.col("t_valid")).otherwise(F.col("at")).alias("t_invalid"))
    first = ends.groupBy("id").agg(F.min_by("t_invalid", "seq").alias("t_invalid"))
    return born.drop("target", "op").join(first, "id", "left")


def supersession_links(deltas: DataFrame) -> DataFrame:
    """``src, dst, relation``: a replacement supersedes, and derives from, what it replaces."""
    updates = deltas.filter(F.col("op") == "update").select(F.col("id").alias("src"), F.col("target").alias("dst"))
    return updates.select("src", "dst", F.explode(F.array(F.lit("supersedes"), F.lit("derived_from"))).alias("relation"))


def validity_by_successor(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each fact of a key ends when the next begins; the last stays open."""
    from pyspark.sql import Window

    return facts.withColumn("t_invalid", F.lead("t_valid").over(Window.partitionBy(*key).orderBy(*order)))


def new_only(incoming: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not there yet, once each: writing twice changes nothing."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replace_incidence(incidence: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch is authoritative for each record that it names; repeated phrases keep the largest weight."""
    kept = incidence.join(batch.select("record_id").distinct(), "record_id", "left_anti")
    fresh = batch.groupBy("phrase", "record_id").agg(F.max("weight").alias("weight"))
    return kept.select("phrase", "record_id", "weight").unionByName(fresh)


def touch_counts(events: DataFrame) -> DataFrame:
    """How often, and when last, a record was met again."""
    return events.filter(F.col("kind") == "dedup").groupBy("record_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("at").alias("last_access"))


def valid_trajectories(states: DataFrame) -> DataFrame:
    """``trajectory, n_states, valid``: state indices must strictly increase in the order given."""
    from pyspark.sql import Window

    before = F.lag("state_index").over(Window.partitionBy("trajectory").orderBy("position"))
    return states.withColumn("ok", before.isNull() | (before < F.col("state_index"))).groupBy("trajectory").agg(F.count(F.lit(1)).alias("n_states"), F.every("ok").alias("valid"))


def may_access(user_agent: DataFrame, agent_namespace: DataFrame) -> DataFrame:
    """``user_id, namespace`` pairs that some agent of the user may read."""
    return user_agent.join(agent_namespace, "agent_id").select("user_id", "namespace").distinct()


def outcome_counts(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """How often each outcome of a write was reached: added, updated, deleted, left, quarantined, duplicates."""
    of = lambda op: F.count_if(F.col("op") == op).alias(op)
    return outcomes.groupBy(*key).agg(*[of(op) for op in (*OPS, "duplicate", "quarantine", "rejected")])
