"""Pools of probes, sub-queries and facts: unions where the first wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_subqueries(raw: DataFrame, most: int = 4) -> DataFrame:
    """``query_id, pos, text``: trimmed, not empty, not the question again, each once whatever its case, the first ``most``."""
    trimmed = raw.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("key", F.lower("text")).filter(F.col("key") != F.lower(F.trim("question")))
    once = trimmed.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("pos"))).filter("nth = 1")
    return once.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("at") <= most).select("query_id", F.col("at").alias("pos"), "text")


def probe_union(hits: DataFrame, most: int = 60) -> DataFrame:
    """``query_id, id``: of all probes' hits (step, pos) the first of each record, the first ``most``."""
    once = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("step", "pos"))).filter("nth = 1")
    return once.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "pos", "id"))).filter(F.col("at") <= most).select("query_id", "id", F.col("at").alias("pos"))


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Facts by trimmed lower-case text; the first wins."""
    key = F.lower(F.trim("text"))
    return facts.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", key).orderBy("pos"))).filter("nth = 1").drop("nth")


def reordered(pool: DataFrame, score: str = "score") -> DataFrame:
    """By score, NaN and null last, equals as they stood; gives ``at``."""
    order = F.coalesce(F.nanvl(F.col(score), F.lit(float("-inf"))), F.lit(float("-inf")))
    return pool.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "pos")))


def inherited_units(lineage: DataFrame, units: DataFrame) -> DataFrame:
    """Units of a record and of all it derives from: ``lineage(id, ancestor)``, ``units(id, unit)``."""
    through = lineage.join(units.withColumnRenamed("id", "ancestor"), "ancestor").select("id", "unit")
    return units.select("id", "unit").unionByName(through).distinct()


def incidence_phrases(entities: Column, found: Column, most: int = 32) -> Column:
    """Distinct phrases of a record in order, at most ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.concat(entities, found))), 1, most)


def stat_totals(stats: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All counters added up."""
    counters = [c for c, kind in stats.dtypes if kind in ("int", "bigint") and c not in (key or [])]
    return stats.groupBy(*(key or [])).agg(*[F.sum(c).alias(c) for c in counters])


def consolidation_op(tier: Column, best: Column, verdict: Column, duplicate: float = 0.95, relevant: float = 0.60) -> Column:
    """What becomes of a candidate: its trust first, then duplicates and relevance, then the judge's word."""
    return (
        F.when(tier == "quarantined", "quarantine")
        .when(best >= duplicate, "duplicate")
        .when(best.isNull() | (best < relevant), "add")
        .when(verdict.isNull() | ~verdict.isin("add", "update", "delete", "noop", "contradicts_verified"), "quarantine")
        .when(verdict == "contradicts_verified", "rejected")
        .otherwise(verdict)
    )


def routed(units: DataFrame) -> DataFrame:
    """Typed units by their route; what is to be ignored, or has no text, goes."""
    route = F.when(F.col("type").isin("profile", "event", "record"), F.col("type")).otherwise("ignore")
    return units.withColumn("route", route).filter((F.col("route") != "ignore") & (F.trim("text") != ""))


def quarantined(records: DataFrame, ids: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(records with the named ones quarantined, their review rows)."""
    marked = records.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    hit = F.col("hit").isNotNull()
    staged = marked.filter(hit).select("id", F.to_json(F.struct(*[c for c in records.columns])).alias("record"), F.lit(reason).alias("reason"))
    return marked.withColumn("trust_tier", F.when(hit, "quarantined").otherwise(F.col("trust_tier"))).select(*records.columns), staged


def unfinished_units(units: DataFrame, events: DataFrame) -> DataFrame:
    """Units without a completion event."""
    done = events.filter(F.col("kind") == "unit_complete").select(F.col("detail").alias("unit")).distinct()
    return units.join(done, "unit", "left_anti")
