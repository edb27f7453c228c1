"""Pools, trajectories, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation import audit
from palimpsest.operators import pools, trajectories
from palimpsest.plans.common import register, table

_FOUND = "f AS (SELECT user_id % 5 AS category, event_id % 4 AS n_gold, event_id % 3 AS n_found, round(value, 6) AS score FROM events)"


@register("A7_coverage", f"WITH {_FOUND} SELECT category, CASE WHEN n_found >= n_gold THEN 'all' WHEN n_found > 0 THEN 'partial' ELSE 'none' END AS bucket, count(*) AS n, round(avg(score), 5) AS mean_score FROM f WHERE n_gold > 0 GROUP BY 1, 2")
def coverage(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id % 5 AS category", "event_id % 4 AS n_gold", "event_id % 3 AS n_found", "round(value, 6) AS score")
    return audit.coverage(rows).withColumn("mean_score", F.round("mean_score", 5))


_CELLS = """r AS (SELECT doc_id % 7 = 0 AS abstention, CASE WHEN doc_id % 11 <> 0 THEN quality = 1 END AS sufficient, toxic = 0 AS correct FROM labels),
c AS (SELECT count(*) AS questions, count(*) FILTER (NOT abstention AND sufficient AND correct) AS suff_right, count(*) FILTER (NOT abstention AND sufficient AND NOT correct) AS suff_wrong,
  count(*) FILTER (NOT abstention AND NOT sufficient AND correct) AS insuff_right, count(*) FILTER (NOT abstention AND NOT sufficient AND NOT correct) AS insuff_wrong, count(*) FILTER (abstention AND correct) AS abstention_right FROM r)"""


def _harness(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id % 7 = 0 AS abstention", "CASE WHEN doc_id % 11 <> 0 THEN quality = 1 END AS sufficient", "toxic = 0 AS correct")


@register("A8_evidence_table", f"WITH {_CELLS} SELECT * FROM c")
def evidence_table(spark, sf):
    return audit.evidence_table(_harness(spark, sf))


@register("E16_ceilings", f"""WITH {_CELLS}, p AS (SELECT *, coalesce(suff_right / nullif(suff_right + suff_wrong, 0), 0) AS ps, coalesce(insuff_right / nullif(insuff_right + insuff_wrong, 0), 0) AS pi, suff_right + insuff_right + abstention_right AS base FROM c)
SELECT round(base / questions, 6) AS measured, round((base + suff_wrong) / questions, 6) AS reader_fix, round((base + ps * insuff_wrong) / questions, 6) AS retrieval_fix, round((base + insuff_wrong) / questions, 6) AS retrieval_perfect, round(ps - pi, 6) AS discrimination FROM p""")
def ceilings(spark, sf):
    found = audit.ceilings(audit.evidence_table(_harness(spark, sf)))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@register("A9_proxy_agreement", "SELECT count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 1)) AS agree, count(*) FILTER (quality = 1 AND toxic <> 1) AS only_proxy, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_judge FROM labels")
def proxy(spark, sf):
    return audit.proxy_agreement(table(spark, sf, "labels").selectExpr("quality = 1 AS p", "toxic = 1 AS j"), "p", "j")


@register("A10_weighted_mean", "SELECT o_orderstatus AS status, round(sum(o_totalprice * (o_orderkey % 9 + 1)) / sum(o_orderkey % 9 + 1), 4) AS mean FROM orders GROUP BY 1")
def weighted(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderstatus AS status", "o_totalprice AS v", "o_orderkey % 9 + 1 AS w")
    return audit.weighted_mean(rows, "v", "w", ["status"]).withColumn("mean", F.round("mean", 4))


@register("A11_replicate_mean", "SELECT p_brand AS metric, round(avg(p_retailprice), 2) AS mean, count(*) AS n_seeds, count(DISTINCT p_size % 2) = 1 AS consistent FROM part GROUP BY p_brand")
def replicates(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_brand AS metric", "p_retailprice AS value", "p_size % 2 AS n")
    return audit.replicate_mean(rows).withColumn("mean", F.round("mean", 2))


@register("A12_stat_totals", "SELECT role, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def totals(spark, sf):
    stats = table(spark, sf, "conversations").select("role", F.lit(1).alias("turns"), F.char_length("text").alias("chars"))
    return pools.stat_totals(stats, ["role"])


@register("E8_fleiss_kappa", """
WITH r AS (SELECT doc_id AS item, quality AS label FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, doc_id % 2 FROM labels), c AS (SELECT item, label, count(*) AS c FROM r GROUP BY ALL),
i AS (SELECT item, sum(c * c) AS sq, sum(c) AS n FROM c GROUP BY item), o AS (SELECT avg((sq - n) / (n * (n - 1))) AS p_bar, sum(n) AS total FROM i), s AS (SELECT sum(t * t) AS sq FROM (SELECT label, sum(c) AS t FROM c GROUP BY label))
SELECT round((p_bar - s.sq / (total * total)) / (1 - s.sq / (total * total)), 6) AS kappa FROM o, s""")
def fleiss(spark, sf):
    labels = table(spark, sf, "labels")
    ratings = labels.select(F.col("doc_id").alias("item"), F.explode(F.array(F.col("quality").cast("long"), F.col("toxic").cast("long"), F.col("doc_id") % 2)).alias("label"))
    return audit.fleiss_kappa(ratings, "item", "label").withColumn("kappa", F.round("kappa", 6))


@register("E3_strata", """
WITH p AS (SELECT event_id AS question_id, user_id % 4 AS category, event_id % 6 = 0 AS abstention, (event_id % 5) / 4.0 AS a, (event_id % 3) / 2.0 AS b FROM events),
s AS (SELECT 'overall' AS stratum, a - b AS d FROM p UNION ALL SELECT CASE WHEN abstention THEN 'abstention' ELSE 'answerable' END, a - b FROM p UNION ALL SELECT 'category:' || category, a - b FROM p)
SELECT stratum, count(*) AS n, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, round(avg(d), 6) AS mean_difference FROM s GROUP BY stratum""")
def strata(spark, sf):
    pairs = table(spark, sf, "events").selectExpr("event_id AS question_id", "user_id % 4 AS category", "event_id % 6 = 0 AS abstention", "(event_id % 5) / 4D AS a", "(event_id % 3) / 2D AS b")
    return audit.strata(pairs).withColumn("mean_difference", F.round("mean_difference", 6))


@register("J11_paired_runs", "WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 4 <> 0) SELECT doc_id, CASE WHEN toxic IS NULL THEN 'dropped' WHEN quality = toxic THEN 'same' ELSE 'differs' END AS outcome FROM a LEFT JOIN b USING (doc_id)")
def paired(spark, sf):
    labels = table(spark, sf, "labels")
    a, b = labels.filter("doc_id % 3 <> 0").select("doc_id", "quality"), labels.filter("doc_id % 4 <> 0").select("doc_id", "toxic")
    outcome = F.when(F.col("toxic").isNull(), "dropped").when(F.col("quality") == F.col("toxic"), "same").otherwise("differs")
    return a.join(b, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


_REG = "r AS (SELECT p_partkey AS metric, p_retailprice AS value, p_size AS n, p_partkey % 13 <> 0 AS citeable, CASE WHEN p_partkey % 17 = 0 THEN 'x' END AS defect, p_partkey % 2 = 0 AS population_comparable, p_partkey % 3 AS judge_class, p_partkey % 5 AS backbone_class, CASE WHEN p_partkey % 7 = 0 THEN 10 END AS nominal_n FROM part)"
_OURS = "o AS (SELECT p_partkey AS metric, p_retailprice + p_partkey % 4 - 1 AS value, CASE WHEN p_partkey % 19 = 0 THEN 0 ELSE p_size END AS n, p_partkey % 23 = 0 AS incomplete, p_partkey % 29 = 0 AS unrecorded, CASE WHEN p_partkey % 31 = 0 THEN 9 ELSE p_partkey % 3 END AS judge_class, CASE WHEN p_partkey % 37 = 0 THEN 9 ELSE p_partkey % 5 END AS backbone_class, p_partkey % 6 = 0 AS arm FROM part WHERE p_partkey % 11 <> 0)"


@register("E20_standing", f"""WITH {_REG}, {_OURS}, v AS (SELECT r.metric, CASE WHEN NOT citeable THEN 'source' WHEN defect IS NOT NULL THEN 'protocol' WHEN o.metric IS NULL THEN 'missing' WHEN incomplete THEN 'incomplete' WHEN unrecorded THEN 'stale'
  WHEN population_comparable AND o.n <> r.n THEN 'subset' WHEN nominal_n IS NOT NULL AND o.n <> nominal_n THEN 'incomplete' WHEN o.judge_class <> r.judge_class THEN 'judge' WHEN o.backbone_class <> r.backbone_class THEN 'backbone' ELSE 'comparable' END AS verdict,
  o.value - r.value AS gap, arm FROM r LEFT JOIN o ON r.metric = o.metric) SELECT metric, verdict, round(gap, 4) AS gap, coalesce(verdict = 'comparable' AND round(gap, 4) > 0 AND NOT arm, false) AS claim FROM v""")
def standing(spark, sf):
    part = table(spark, sf, "part")
    read = lambda text: text.split("(SELECT ")[1].rsplit(" FROM part", 1)[0]
    registry = part.selectExpr(*_columns(read(_REG)))
    ours = part.filter("p_partkey % 11 <> 0").selectExpr(*_columns(read(_OURS)))
    return audit.standing(registry, ours).withColumn("gap", F.round("gap", 4))


def _columns(select: str) -> list[str]:
    """The expressions of a flat select list."""
    return [c.strip() for c in select.split(", ")]


@register("E21_matched_minimum", "SELECT c_mktsegment AS corpus, min(c_acctbal) AS matched FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 25")
def matched(spark, sf):
    readings = table(spark, sf, "customer").selectExpr("c_mktsegment AS corpus", "c_nationkey AS grader", "c_acctbal AS value")
    return audit.matched_minimum(readings, 25)


@register("K8_best_artifact", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority, o_totalprice DESC, o_orderkey) = 1")
def best(spark, sf):
    order = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return audit.best_artifact(table(spark, sf, "orders"), "o_custkey", order).select("o_custkey", "o_orderkey")


@register("E23_reach", "WITH s AS (SELECT DISTINCT l_partkey AS unit FROM lineitem WHERE l_quantity > 25) SELECT l_orderkey AS question_id, count(*) AS n_gold, count(unit) AS n_stored, count(*) = count(unit) AS reached FROM lineitem LEFT JOIN s ON l_partkey = unit GROUP BY 1")
def reach(spark, sf):
    items = table(spark, sf, "lineitem")
    return audit.reached(items.selectExpr("l_orderkey AS question_id", "l_partkey AS unit"), items.filter("l_quantity > 25").selectExpr("l_partkey AS unit"))


@register("D4_clean_subqueries", """
WITH r AS (SELECT conv_id AS query_id, turn AS pos, text AS text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations),
t AS (SELECT query_id, pos, trim(text) AS text FROM r WHERE trim(text) <> '' AND lower(trim(text)) <> lower(trim(question))), o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos, text FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 4""")
def subqueries(spark, sf):
    from pyspark.sql import Window

    raw = table(spark, sf, "conversations").selectExpr("conv_id AS query_id", "turn AS pos", "text")
    return pools.clean_subqueries(raw.withColumn("question", F.first("text").over(Window.partitionBy("query_id").orderBy("pos"))))


@register("D5_probe_union", """
WITH h AS (SELECT user_id AS query_id, event_id % 40 AS id, event_id % 3 AS step, event_id AS pos FROM events), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY step, pos) = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY step, pos, id) AS pos FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step, pos, id) <= 10""")
def probes(spark, sf):
    return pools.probe_union(table(spark, sf, "events").selectExpr("user_id AS query_id", "event_id % 40 AS id", "event_id % 3 AS step", "event_id AS pos"), 10)


@register("D6_distinct_facts", "SELECT conv_id AS query_id, turn AS pos, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) = 1")
def facts(spark, sf):
    return pools.distinct_facts(table(spark, sf, "conversations").selectExpr("conv_id AS query_id", "turn AS pos", "text"))


@register("K9_reordered", """
WITH p AS (SELECT user_id AS query_id, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS score FROM events)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, pos) AS at FROM p""".replace(" AS at FROM", ' AS "at" FROM'))
def reordered(spark, sf):
    pool = table(spark, sf, "events").selectExpr("user_id AS query_id", "event_id AS pos", "CASE WHEN event_id % 7 = 0 THEN double('NaN') ELSE round(value, 2) END AS score")
    return pools.reordered(pool).select("query_id", "pos", "at")


@register("D12_inherited_units", """
WITH l AS (SELECT o_custkey AS id, o_orderkey AS ancestor FROM orders), u AS (SELECT l_orderkey AS id, l_partkey AS unit FROM lineitem)
SELECT id, unit FROM u UNION SELECT l.id, unit FROM l JOIN u ON l.ancestor = u.id""")
def inherited(spark, sf):
    derived = table(spark, sf, "orders").selectExpr("o_custkey AS id", "o_orderkey AS ancestor")
    return pools.inherited_units(derived, table(spark, sf, "lineitem").selectExpr("l_orderkey AS id", "l_partkey AS unit"))


@register("U4_consolidation", """
WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'quarantined' ELSE 'asserted' END AS tier, CASE WHEN event_id % 8 <> 0 THEN (event_id % 100) / 100.0 END AS best, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'update' WHEN 2 THEN 'contradicts_verified' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'noop' ELSE 'add' END AS verdict FROM events)
SELECT event_id, CASE WHEN tier = 'quarantined' THEN 'quarantine' WHEN best >= 0.95 THEN 'duplicate' WHEN best IS NULL OR best < 0.6 THEN 'add' WHEN verdict IS NULL OR verdict = 'nonsense' THEN 'quarantine' WHEN verdict = 'contradicts_verified' THEN 'rejected' ELSE verdict END AS op FROM c""")
def consolidation(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 9 = 0 THEN 'quarantined' ELSE 'asserted' END AS tier", "CASE WHEN event_id % 8 <> 0 THEN (event_id % 100) / 100D END AS best",
        "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'update' WHEN 2 THEN 'contradicts_verified' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'noop' ELSE 'add' END AS verdict",
    )
    return rows.select("event_id", pools.consolidation_op(F.col("tier"), F.col("best"), F.col("verdict")).alias("op"))


_ROUTE = "CASE event_id % 5 WHEN 0 THEN 'profile' WHEN 1 THEN 'event' WHEN 2 THEN 'record' WHEN 3 THEN 'ignore' ELSE 'other' END"


@register("U9_routed_units", f"SELECT event_id, {_ROUTE} AS route FROM events WHERE event_id % 5 < 3")
def routed(spark, sf):
    return pools.routed(table(spark, sf, "events").selectExpr("event_id", f"{_ROUTE} AS type", "props AS text")).select("event_id", "route")


@register("U12_quarantine", "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'quarantined' ELSE 'asserted' END AS trust_tier FROM documents")
def quarantine(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id AS id", "'asserted' AS trust_tier")
    return pools.quarantined(docs, docs.filter("id % 10 = 3"), "review")[0]


@register("U17_unfinished_units", "SELECT DISTINCT user_id AS unit FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0)")
def unfinished(spark, sf):
    events = table(spark, sf, "events")
    log = events.selectExpr("CASE WHEN event_id % 50 = 0 THEN 'unit_complete' ELSE 'x' END AS kind", "user_id AS detail")
    return pools.unfinished_units(events.selectExpr("user_id AS unit").distinct(), log)


def _states(spark, sf):
    return table(spark, sf, "conversations").selectExpr("concat('t', conv_id) AS trajectory", "turn AS state_index", "concat('http://x/', turn) AS url", "CASE WHEN turn % 3 <> 2 THEN concat(role, ' acts') END AS action", "text AS page")


@register("C31_grep", r"""
WITH l AS (SELECT 't' || conv_id AS trajectory, turn AS state_index, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE contains(lower(text), 'thing'))
SELECT trajectory, state_index, line_no, left(line, 240) AS line FROM l WHERE contains(lower(line), 'thing') ORDER BY trajectory, state_index, line_no LIMIT 40""")
def grep(spark, sf):
    return trajectories.grep(_states(spark, sf), "THING", most_states=1_000_000)


@register("C31_summary", """
WITH a AS (SELECT 't' || conv_id AS trajectory, turn, role, sum((turn % 3 <> 2)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT trajectory, max(turn) AS last_state, string_agg(n || '. ' || role || ' acts -> state ' || turn || ' (http://x/' || turn || ')', chr(10) ORDER BY turn) FILTER (turn % 3 <> 2) AS actions FROM a GROUP BY trajectory""")
def summary(spark, sf):
    return trajectories.summary(_states(spark, sf))


@register("J13_domain_pairs", "SELECT a.s_suppkey AS web, b.s_suppkey AS enterprise FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey % 2 = 0 AND b.s_suppkey % 2 = 1")
def domain_pairs(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    web, other = s.filter("s_suppkey % 2 = 0").withColumnRenamed("s_suppkey", "web"), s.filter("s_suppkey % 2 = 1").withColumnRenamed("s_suppkey", "enterprise")
    return web.join(other, "s_nationkey").select("web", "enterprise")


@register("J16_lineage_related", "WITH o AS (SELECT o_custkey AS id, list(o_orderkey) AS derived_from FROM orders GROUP BY 1) SELECT id, o_orderkey AS other FROM o JOIN orders ON list_contains(derived_from, o_orderkey)")
def related(spark, sf):
    """Either way of ``derived_from``, as an equi-join on the unfolded list."""
    derived = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("derived_from"))
    return derived.select("id", F.explode("derived_from").alias("other")).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("other")), "other").select("id", "other")
