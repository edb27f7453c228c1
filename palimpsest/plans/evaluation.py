"""Evaluation algebra over labels, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation import metrics
from palimpsest.plans.common import register, table


@register("A1_by_category", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_score FROM events GROUP BY event_type")
def by_category(spark, sf):
    return metrics.by_category(table(spark, sf, "events"), "event_type", "value").withColumn("mean_score", F.round("mean_score", 6))


@register("A2_stratified_means", "SELECT round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS answerable, round(coalesce(avg(value) FILTER (event_type = 'nothing'), 0), 6) AS abstention FROM events")
def stratified(spark, sf):
    mean = lambda kind: F.round(F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0)), 6)
    return table(spark, sf, "events").agg(mean("click").alias("answerable"), mean("nothing").alias("abstention"))


@register("A3_percentiles", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, max(value) FILTER (nth = floor((n - 1) * 0.5 + 0.5)) AS p50, max(value) FILTER (nth = floor((n - 1) * 0.9 + 0.5)) AS p90 FROM r GROUP BY user_id""")
def percentiles(spark, sf):
    return metrics.nearest_ranks(table(spark, sf, "events"), ["user_id"], "value", {"p50": 0.5, "p90": 0.9})


_CELLS = "c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)"


@register("E7_confusion", f"WITH {_CELLS} SELECT * FROM c")
def confusion(spark, sf):
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")


@register("E5_kappa", f"""WITH {_CELLS}, p AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c), q AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) / n) * ((tp + fn) / n) + (1 - (tp + fp) / n) * (1 - (tp + fn) / n) AS pe FROM p)
SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM q""")
def kappa(spark, sf):
    found = metrics.kappa_of(metrics.confusion(table(spark, sf, "labels"), "quality", "toxic"))
    return found.select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@register("E6_kappa_se")
def kappa_se(spark, sf):
    """Held against the written-out formula in the tests."""
    return metrics.kappa_of(metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")).select(F.round("kappa_se", 9).alias("kappa_se"))


@register("A8_contingency", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def contingency(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("E4_wilson", """
WITH g AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (quality = 1) AS s FROM labels JOIN documents USING (doc_id) GROUP BY source), p AS (SELECT *, s / n AS p FROM g)
SELECT source, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def wilson(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rates = rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("s"), F.count(F.lit(1)).alias("n"))
    low, high = metrics.wilson(F.col("s"), F.col("n"))
    return rates.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("E9_auroc", """
WITH l AS (SELECT n_chars AS s, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM labels JOIN documents USING (doc_id) GROUP BY n_chars),
w AS (SELECT *, pos * (coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS wins FROM l)
SELECT round(sum(wins) / (sum(pos) * sum(neg)), 6) AS auroc FROM w""")
def auroc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auroc(rows, "n_chars", "toxic").select(F.round("auroc", 6).alias("auroc"))



@register("W15_pareto", "WITH p AS (SELECT user_id % 40 AS arm, round(avg(value), 6) AS gain, 1 + (user_id % 40) * 1.5 AS cost FROM events GROUP BY 1, 3), b AS (SELECT *, max(gain) OVER (ORDER BY cost, gain DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT arm, gain FROM b WHERE before IS NULL OR gain > before")
def pareto(spark, sf):
    points = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("arm")).agg(F.round(F.avg("value"), 6).alias("gain")).withColumn("cost", 1 + F.col("arm") * 1.5)
    return metrics.pareto_frontier(points, "cost", "gain").select("arm", "gain")


@register("E10_log_budget", """
WITH p AS (SELECT round(avg(value), 6) AS gain, 1 + (user_id % 40) * 1.5 AS cost FROM events GROUP BY user_id % 40, 2), b AS (SELECT *, max(gain) OVER (ORDER BY cost, gain DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
f AS (SELECT gain, cost, least(60.0, greatest(1.0, cost)) AS lo FROM b WHERE before IS NULL OR gain > before), s AS (SELECT gain * ln(coalesce(lead(lo) OVER (ORDER BY cost), 60.0) / lo) AS part FROM f)
SELECT round(sum(part) / ln(60.0), 6) AS score FROM s""")
def log_budget(spark, sf):
    points = table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("arm")).agg(F.round(F.avg("value"), 6).alias("gain")).withColumn("cost", 1 + F.col("arm") * 1.5)
    return metrics.log_budget_mean(points, "cost", "gain", 1.0, 60.0).select(F.round("score", 6).alias("score"))


@register("E22_ratchet", """
WITH c AS (SELECT p_partkey AS metric, p_size::DOUBLE AS value, p_partkey % 9 <> 0 AS quotable FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS metric, (p_size + p_partkey % 3 - 1)::DOUBLE AS pinned FROM part WHERE p_partkey % 4 <> 0),
j AS (SELECT coalesce(c.metric, n.metric) AS metric, value, pinned, coalesce(quotable, false) AS ok FROM c FULL JOIN n ON c.metric = n.metric),
s AS (SELECT *, CASE WHEN pinned IS NOT NULL AND (value IS NULL OR NOT ok) THEN 'unverifiable' WHEN pinned IS NULL AND ok THEN 'new' WHEN pinned IS NULL THEN 'skipped' WHEN value < pinned THEN 'regressed' WHEN value > pinned THEN 'improved' ELSE 'held' END AS status FROM j)
SELECT metric, status, CASE WHEN status IN ('improved', 'new') THEN value ELSE pinned END AS floor FROM s""")
def ratchet(spark, sf):
    part = table(spark, sf, "part")
    current = part.filter("p_partkey % 5 <> 0").selectExpr("p_partkey AS metric", "cast(p_size AS double) AS value", "p_partkey % 9 <> 0 AS quotable")
    pins = part.filter("p_partkey % 4 <> 0").selectExpr("p_partkey AS metric", "cast(p_size + p_partkey % 3 - 1 AS double) AS pinned")
    return metrics.ratchet(current, pins)


@register("A16_store_fingerprint", "WITH k AS (SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS fingerprint FROM k")
def fingerprint(spark, sf):
    counts = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    part = F.concat("kind", F.lit("="), F.col("n").cast("string"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list(part)), ",").alias("fingerprint"))
