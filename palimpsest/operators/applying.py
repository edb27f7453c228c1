"""Outcomes of a write applied in order: what a later one may do depends on which earlier ones were accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage

#: Operations that change the ledger, and those that only leave an event.
CHANGES = ("add", "update", "delete")
EVENTS = {"noop": "noop", "duplicate": "dedup", "quarantine": "quarantine", "rejected": "contradiction_rejected"}


def apply_in_order(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """``outcomes`` with ``accepted`` and ``event``, as if applied one after the other by ``seq`` to the ``known(id)`` ids.

    ``outcomes(seq, op, id, target, parents)`` have distinct seqs. An add or update writes ``id``, which must be new; an
    update, a delete and a duplicate need their ``target``, an add or update its ``parents``, from before. A null target
    where one is needed, and an unknown operation, are refused; null or empty parents need nothing. A refused change
    leaves the event ``consolidate_rejected`` and nothing else, so what builds on it is refused too; a repeated id is
    refused after the first that was accepted.

    Each round decides the outcomes whose ids are decided before them, wherever they stand in the order, so there are as
    many rounds as outcomes that build on one another, not as many as outcomes. A round meets the ids by their first
    accepted and first open writer, one row an id. The least open seq is always decidable.
    """
    none = F.array().cast(outcomes.schema["parents"].dataType)
    writes, aims = F.col("op").isin("add", "update"), F.col("op").isin("update", "delete", "duplicate")
    need = lambda i, must: F.struct(i.alias("id"), F.lit(must).alias("must"))
    nothing = F.array().cast("array<struct<id:%s,must:boolean>>" % dict(outcomes.dtypes)["id"])
    of_parents = F.transform(F.coalesce("parents", none), lambda p: need(p, True))
    wanted = ((writes, F.array(need(F.col("id"), False))), (aims, F.array(need(F.col("target"), True))), (writes, of_parents))
    needs = F.concat(*[F.when(c, n).otherwise(nothing) for c, n in wanted])
    legal = F.col("op").isin(*CHANGES, *EVENTS) & ~F.exists(needs, lambda n: n["id"].isNull())
    rows = outcomes.select("seq", F.when(writes, F.col("id")).alias("writes"), needs.alias("needs"), F.coalesce(legal, F.lit(False)).alias("legal"))
    before = known.select("id", F.lit(-(1 << 62)).alias("at")).distinct()
    decided = cut_lineage(rows.select("seq", "writes", F.when(~F.col("legal"), False).when(F.size("needs") == 0, True).alias("accepted")).filter("accepted IS NOT NULL"))
    open_ = cut_lineage(rows.filter((F.size("needs") > 0) & F.col("legal")).select("seq", "writes", "needs"))
    while not open_.isEmpty():
        there = before.unionByName(decided.filter("accepted AND writes IS NOT NULL").select(F.col("writes").alias("id"), F.col("seq").alias("at"))).groupBy("id").agg(F.min("at").alias("there"))
        coming = open_.filter("writes IS NOT NULL").groupBy(F.col("writes").alias("id")).agg(F.min("seq").alias("coming"))
        asked = open_.select("seq", "writes", F.explode("needs").alias("n")).select("seq", "writes", "n.id", "n.must")
        met = asked.join(there, "id", "left").join(coming, "id", "left")
        exists, pending = F.coalesce(F.col("there") < F.col("seq"), F.lit(False)), F.coalesce(F.col("coming") < F.col("seq"), F.lit(False))
        good = F.when(exists, F.col("must")).when(~pending, ~F.col("must"))  # null: not known yet
        judged = met.withColumn("good", good).groupBy("seq", "writes").agg(F.every(F.coalesce("good", F.lit(True))).alias("none_bad"), F.every(F.col("good").isNotNull()).alias("all_known"))
        fresh = cut_lineage(judged.filter("all_known OR NOT none_bad").select("seq", "writes", F.col("none_bad").alias("accepted")))
        decided = cut_lineage(decided.unionByName(fresh))
        open_ = cut_lineage(open_.join(fresh.select("seq"), "seq", "left_anti"))
    event = F.when(~F.col("accepted"), "consolidate_rejected")
    for op, kind in EVENTS.items():
        event = event.when(F.col("op") == op, kind)
    return outcomes.join(decided.select("seq", "accepted"), "seq").withColumn("event", event.otherwise(F.col("op")))
