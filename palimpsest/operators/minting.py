"""Pools of events and notes minted from trajectories, resumable and with their lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most records of a pool, and the kind that they have.
MOST = {"event": 6, "note": 2}
KIND = {"event": "semantic", "note": "procedural"}


@dataclass(frozen=True)
class Minted:
    """``records(id, trajectory, pool, kind, text)``, ``lineage(src, dst)``, ``completed(trajectory, pool)`` and
    ``refused(trajectory, pool)``, for want of anything to derive from."""

    records: DataFrame
    lineage: DataFrame
    completed: DataFrame
    refused: DataFrame


def mint(replies: DataFrame, records: DataFrame, completed: DataFrame, most: dict[str, int] = MOST) -> Minted:
    """What ``replies(trajectory, pool, reply)``, JSON arrays of texts, add to a store.

    A pool keeps the first so many texts that are not blank, trimmed. All of its records derive from every live record
    whose source, of ``records(id, source, live)``, is the trajectory's id and a colon and more: a row of lineage for each
    pair of a minted record and an ancestor. Without an ancestor nothing is minted, and the pool stays open. Pools in
    ``completed`` are left alone, so that a second run adds nothing; a reply that cannot be read, or holds no text,
    completes its pool with nothing. Ids follow from trajectory, pool and place, so that a run cut off half-way repeats
    itself. Unknown pools and null trajectories give nothing; of several replies for a pool the least counts.
    """
    known = F.create_map(*[x for p, n in most.items() for x in (F.lit(p), F.lit(n))])
    once = replies.filter(F.col("trajectory").isNotNull() & F.col("pool").isin(*most)).groupBy("trajectory", "pool").agg(F.min("reply").alias("reply"))
    open_ = once.join(completed.select("trajectory", "pool"), ["trajectory", "pool"], "left_anti")
    source = F.col("source")
    of = records.filter(F.col("live") & source.contains(":")).select(F.regexp_extract(source, "(?s)^(.*?):", 1).alias("trajectory"), F.col("id").alias("dst"))
    has = of.select("trajectory").distinct()
    ready, refused = open_.join(has, "trajectory", "left_semi"), open_.join(has, "trajectory", "left_anti")
    texts = F.filter(F.transform(F.from_json("reply", "array<string>"), lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))
    kept = ready.select("trajectory", "pool", F.posexplode(F.slice(texts, F.lit(1), F.try_element_at(known, F.col("pool")))).alias("n", "text"))
    kinds = F.create_map(*[x for p, k in KIND.items() for x in (F.lit(p), F.lit(k))])
    minted = kept.select(F.concat_ws("/", "trajectory", "pool", (F.col("n") + 1).cast("string")).alias("id"), "trajectory", "pool", F.try_element_at(kinds, F.col("pool")).alias("kind"), "text")
    lineage = minted.select(F.col("id").alias("src"), "trajectory").join(of, "trajectory").select("src", "dst")
    return Minted(minted, lineage, ready.select("trajectory", "pool"), refused.select("trajectory", "pool"))
