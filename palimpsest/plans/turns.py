"""Turns, replies and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import replies
from palimpsest.operators import compose, lineage, predicates, segment, trajectories, turns
from palimpsest.plans.common import RECORDS_SQL, T0, records, register, table


@register("P7_shown_heads", "SELECT doc_id, left(text, 8000) AS rerank, left(text, 400) AS selector, left(text, 2000) AS evidence, left(text, 1200) AS ask FROM documents")
def heads(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[replies.shown(F.col("text"), to).alias(to) for to in replies.SHOWN])


@register("P5_evidence_label", f"""
SELECT id, '[' || strftime(make_timestamp(t_valid * 1000000), '%Y-%m-%d') || '] ' || CASE WHEN trust_tier = 'untrusted' THEN '[untrusted source] ' ELSE '' END || text AS label FROM ({RECORDS_SQL})""")
def labels(spark, sf):
    day = F.to_date(F.timestamp_seconds("t_valid"))
    rows = records(spark, sf, "id", "text", "kind", "trust_tier", "t_valid")
    return rows.select("id", replies.evidence_label(F.col("text"), F.col("kind"), F.col("trust_tier"), day, resolve=False).alias("label"))


@register("P5_resolved_label")
def resolved_labels(spark, sf):
    day = F.to_date(F.timestamp_seconds("t_valid"))
    said = F.concat(F.lit("I met them "), F.element_at(F.array(*map(F.lit, ("yesterday", "two weeks ago", "last month"))), (F.col("id") % 3 + 1).cast("int")), F.lit("."))
    rows = records(spark, sf, "id", "kind", "trust_tier", "t_valid")
    return rows.select("id", replies.evidence_label(said, F.col("kind"), F.col("trust_tier"), day).alias("label"))


@register("J5_tenant_incidence", "SELECT l_partkey AS phrase, l_orderkey AS record_id, l_quantity AS weight FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def tenant_incidence(spark, sf):
    incidence = table(spark, sf, "lineitem").selectExpr("l_partkey AS phrase", "l_orderkey AS record_id", "l_quantity AS weight")
    return lineage.incidence_of(incidence, table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS tenant"), "F")


@register("J7_anchored_states", "SELECT 't' || c.conv_id AS trajectory, d.doc_id AS record_id, d.source AS tenant, c.turn AS state_index FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 2")
def anchored(spark, sf):
    states = table(spark, sf, "conversations").selectExpr("concat('t', conv_id) AS trajectory", "turn AS state_index")
    headers = table(spark, sf, "conversations").selectExpr("concat('t', conv_id) AS trajectory", "conv_id * 2 AS record_id").distinct()
    anchors = table(spark, sf, "documents").selectExpr("doc_id AS record_id", "source AS tenant")
    return trajectories.anchored(headers, anchors, states).select("trajectory", "record_id", "tenant", "state_index")


@register("S8_index_scan", f"SELECT id, namespace, kind, trust_tier FROM ({RECORDS_SQL}) WHERE namespace = 'en'")
def scan(spark, sf):
    return predicates.index_scan(records(spark, sf, "id", "namespace", "kind", "trust_tier"), "en")


@register("S11_trajectory_export")
def exported(spark, sf):
    rows = table(spark, sf, "conversations")
    headers = rows.selectExpr("concat('t', conv_id) AS id", "'find' AS goal", "'success' AS outcome", "'http://x/' AS start_url").distinct()
    states = rows.selectExpr("concat('t', conv_id) AS trajectory", "turn AS state_index", "turn AS step", "'http://x/' AS url", "CASE WHEN turn % 3 <> 2 THEN role END AS action", "cast(null AS string) AS thought", "text AS page")
    return trajectories.exported(headers, states)


@register("K2_rerank_depth", "SELECT p_partkey, greatest(24, p_size * greatest(p_partkey % 4, 1)) AS depth FROM part")
def rerank_depth(spark, sf):
    return table(spark, sf, "part").select("p_partkey", replies.rerank_depth(F.lit(24).cast("long"), F.col("p_size").cast("long"), (F.col("p_partkey") % 4)).alias("depth"))


@register("K6_chronological", "SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS place FROM orders")
def chronological(spark, sf):
    kept = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t_valid"), F.struct("o_totalprice", "o_orderkey").alias("rank"))
    return compose.chronological(kept).select("query_id", "id", "place")


@register("U10_event_records", f"SELECT doc_id, (make_timestamp(({T0} + doc_id % 20000 * 86400) * 1000000)::DATE - 1)::VARCHAR AS day, 'Ann met Bob [' || strftime(make_timestamp(({T0} + doc_id % 20000 * 86400) * 1000000)::DATE - 1, '%Y-%m-%d') || ' — \"yesterday\", said ' || strftime(make_timestamp(({T0} + doc_id % 20000 * 86400) * 1000000), '%Y-%m-%d') || ']' || chr(10) || 'also: B' AS text FROM documents")
def event_records(spark, sf):
    said = F.to_date(F.timestamp_seconds(F.lit(T0) + F.col("doc_id") % 20000 * 86400))
    record = replies.event_record(F.lit("Ann"), F.lit(" met "), F.lit("Bob"), F.lit(" yesterday "), said, F.array(F.lit(" B "), F.lit(" ")))
    return table(spark, sf, "documents").select("doc_id", record.alias("r")).select("doc_id", F.col("r.t_valid").cast("string").alias("day"), "r.text")


_BARE = "list_filter(list_transform(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}'']+'), lambda w: regexp_replace(regexp_replace(w, '^''+|''+$', '', 'g'), '''s$', '')), lambda w: w <> '')"


@register("A19_grounding", f"""
WITH p AS (SELECT c.conv_id, c.turn, {_BARE.format('b.text')} AS g, list_transform({_BARE.format('c.text')}, lambda w: lower(w)) AS s FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40),
k AS (SELECT conv_id, turn, s, list_transform(list_filter(g, lambda w: length(w) >= 2 AND regexp_matches(w, '^[\\p{{Lu}}0-9]')), lambda w: lower(w)) AS c FROM p)
SELECT conv_id, turn, len(list_filter(c, lambda w: list_contains(s, w))) AS matched, len(c) AS total FROM k""")
def grounding(spark, sf):
    gist = table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("gist"))
    rows = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") % 40).join(gist, "k")
    return rows.select("conv_id", "turn", replies.grounding(F.col("gist"), F.col("text")).alias("g")).select("conv_id", "turn", "g.matched", "g.total")


@register("W4_spaced_boundaries")
def spaced(spark, sf):
    depths = segment.depths(segment.adjacent_similarity(table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector")), "label", "vec_id").drop("vector"), "label", "vec_id")
    found = segment.boundary_candidates(depths, "label", "vec_id")
    from pyspark.sql import Window

    gaps = depths.withColumn("gap", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).select("label", "vec_id", "gap")
    sizes = gaps.groupBy("label").agg((F.count(F.lit(1)) + 1).alias("n_key"))
    return turns.spaced_boundaries(found.join(gaps, ["label", "vec_id"]).join(sizes, "label"), "label", "gap", "depth", "n_key", 5)


@register("R11_turn_windows")
def turn_windows(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id % 10 AS query_id", "conv_id AS owner", "CASE WHEN conv_id % 4 <> 0 THEN cast(turn AS int) END AS turn", "(conv_id * 7 + turn * 13) % 101 / 101D AS score")
    return turns.select_turns(rows.dropDuplicates(["query_id", "owner", "turn"]), 6, 18)


@register("R15_round_view", """
WITH e AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, greatest(length('user: ' || text) // 4, len(list_filter(regexp_split_to_array('user: ' || text, '\\s+'), lambda w: w <> ''))) AS tokens FROM conversations),
v AS (SELECT id FROM e WHERE turn % 3 <> 0), p AS (SELECT *, lag(id) OVER w AS pid, lag(turn) OVER w AS seat, lag(role) OVER w AS prole, lag(text) OVER w AS ptext, lag(tokens) OVER w AS ptokens FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
o AS (SELECT 1 AS query_id, id, pid, ptext, CASE WHEN pid IS NULL THEN 'no_predecessor' WHEN seat + 1 <> turn THEN 'not_adjacent' WHEN prole <> 'user' THEN 'predecessor_not_user' WHEN pid IN (SELECT id FROM v) THEN 'predecessor_in_evidence' WHEN ptokens > 256 THEN 'prompt_over_cap' ELSE 'fired' END AS outcome
  FROM p WHERE role = 'assistant' AND id IN (SELECT id FROM v))
SELECT query_id, id, outcome, CASE WHEN outcome = 'fired' THEN pid END AS predecessor, CASE WHEN outcome = 'fired' THEN 'user: ' || ptext END AS prompt FROM o""")
def round_view(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("index"), F.concat("role", F.lit(": "), "text").alias("text"))
    return turns.round_view(rows.filter("index % 3 <> 0").select(F.lit(1).alias("query_id"), "id"), rows)


@register("R14_user_words", """
WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text, greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS tokens FROM conversations WHERE role = 'user' AND conv_id % 3 = 0)
SELECT conv_id % 5 AS query_id, id, text, tokens, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn, id) AS rank FROM t""")
def user_words(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("index"), "role", "text")
    evidence = rows.filter("session % 3 = 0").select((F.col("session") % 5).alias("query_id"), "session")
    return turns.user_words(evidence, rows)


@register("R9_selected", """
WITH p AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
w AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'call_failed' WHEN 1 THEN 'model_declined' ELSE CASE WHEN size > 1 THEN 'none' ELSE 'model_declined' END END AS degraded FROM p)
SELECT query_id, id, degraded, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN degraded = 'none' AND n = 3 THEN -2 WHEN degraded = 'none' AND n = 1 THEN -1 ELSE n END) AS place FROM w""")
def selected(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1
    pool = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id")).withColumn("n", nth)
    keep = F.when(F.col("query_id") % 3 == 1, F.array(F.lit(-1), F.lit(99_999_999))).when(F.col("query_id") % 3 == 2, F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(-7)))
    return turns.selected(pool, keep, 2).select("query_id", "id", "degraded", "place")
