"""Drift between the ledger and what derives from it: a report, and the changes that mend it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lineage import dangling_links, drift, orphan_incidence


@dataclass(frozen=True)
class Repaired:
    """The index, links and incidence that agree with the ledger, and ``changes(id, action)`` of the index."""

    index: DataFrame
    links: DataFrame
    incidence: DataFrame
    changes: DataFrame


def report(ledger: DataFrame, index: DataFrame, links: DataFrame, incidence: DataFrame, columns: list[str]) -> DataFrame:
    """``kind, n``: how many rows of the index drift, by state, links that dangle and incidence rows without a record."""
    states = drift(ledger, index, columns).select(F.col("state").alias("kind"))
    more = dangling_links(links, ledger).select(F.lit("dangling_link").alias("kind")).unionByName(orphan_incidence(incidence, ledger).select(F.lit("orphan_incidence").alias("kind")))
    return states.unionByName(more).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def repaired(ledger: DataFrame, index: DataFrame, links: DataFrame, incidence: DataFrame, columns: list[str]) -> Repaired:
    """What the ledger says, in each of them: ``ledger(id, live, ...)``, ``index(id, ...)`` share ``columns``.

    Orphans and stale rows leave the index, missing and drifted ones come from the ledger, others stay as they are; an id that
    the index has twice is put in once if any of its rows drifts. Links need both ends, incidence its record. Repairing
    what is repaired changes nothing. A row of a dead record is no drift where the index lacks it.
    """
    action = F.when(F.col("state").isin("orphan", "stale"), "remove").when(F.col("state") == "missing", "add").otherwise("replace")
    changes = drift(ledger, index, columns).select("id", action.alias("action")).distinct()
    kept = index.select("id", *columns).join(changes.select("id"), "id", "left_anti")
    written = ledger.join(changes.filter("action <> 'remove'").select("id"), "id", "left_semi").select("id", *columns)
    ids = ledger.select("id")
    whole = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*links.columns)
    there = incidence.join(ids.withColumnRenamed("id", "record_id"), "record_id", "left_semi").select(*incidence.columns)
    return Repaired(kept.unionByName(written), whole, there, changes)
