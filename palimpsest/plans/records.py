"""Scans, filters and projections over records."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.text import approx_tokens, preview
from palimpsest.operators import ledger, predicates
from palimpsest.plans.common import ADMISSIBLE_SQL, NOW, RECORDS_SQL, T0, records, register, table

_R = f"WITH r AS ({RECORDS_SQL})"


@register("F1_admissible", f"{_R} SELECT id, namespace, trust_tier FROM r WHERE {ADMISSIBLE_SQL}")
def admissible(spark, sf):
    return records(spark, sf).filter(predicates.admissible(F.lit(NOW))).select("id", "namespace", "trust_tier")


@register("F2_scope_newest", f"{_R} SELECT id, kind, t_ingested FROM r WHERE tenant = 'src1' AND kind IN ('semantic', 'event', 'episodic') AND {ADMISSIBLE_SQL} ORDER BY t_ingested DESC, id LIMIT 20")
def scope_newest(spark, sf):
    scope = predicates.in_scope("src1", kinds=("semantic", "event", "episodic"))
    return predicates.newest(records(spark, sf).filter(scope & predicates.admissible(F.lit(NOW))).select("id", "kind", "t_ingested"), 20)


@register("F4_meta_filter", "SELECT event_id FROM events WHERE event_type = 'click' AND try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 10 AND try_cast(json_extract_string(props, '$.k') AS BIGINT) < 60")
def meta_filter(spark, sf):
    return table(spark, sf, "events").filter((F.col("event_type") == "click") & predicates.meta_range("k", gte=10, lt=60, meta="props")).select("event_id")


@register("F4_meta_equals", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def meta_equals(spark, sf):
    return table(spark, sf, "events").filter(predicates.meta_equals("k", 7, "props")).select("event_id")


@register("F6_kind_in", f"{_R} SELECT id, kind FROM r WHERE kind IN ('profile', 'gist')")
def kind_in(spark, sf):
    return records(spark, sf, "id", "kind").filter(F.col("kind").isin("profile", "gist"))


@register("F7_namespace_counts", f"{_R} SELECT namespace, count(*) AS n FROM r WHERE {ADMISSIBLE_SQL} GROUP BY namespace")
def namespace_counts(spark, sf):
    return predicates.namespace_counts(records(spark, sf).filter(predicates.admissible(F.lit(NOW))))


@register("F8_source_prefix", f"{_R} SELECT id, prov_source FROM r WHERE starts_with(prov_source, 'src1:') AND {ADMISSIBLE_SQL}")
def source_prefix(spark, sf):
    return records(spark, sf).filter(predicates.admissible(F.lit(NOW)) & F.col("prov_source").startswith("src1:")).select("id", "prov_source")


@register("F9_state_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog.') OR contains(lower(html), 'track(7)') ORDER BY page_id LIMIT 100")
def state_search(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.filter(F.contains(F.lower("url"), F.lit("blog.")) | F.contains(F.lower("html"), F.lit("track(7)"))).select("page_id", "url").orderBy("page_id").limit(100)


@register("F10_state_range", "SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3")
def state_range(spark, sf):
    return table(spark, sf, "conversations").filter(F.col("turn").between(1, 3)).select("conv_id", "turn", "role")


@register("F11_missing_provenance", f"{_R} SELECT id FROM r WHERE prov_source IS NULL")
def missing_provenance(spark, sf):
    return predicates.missing_provenance(records(spark, sf, "id", "prov_source")).select("id")


@register("F12_visible_kind_days", f"{_R} SELECT id, t_valid FROM r WHERE kind = 'event' AND {ADMISSIBLE_SQL} AND t_valid BETWEEN {T0 + 5 * 86400} AND {T0 + 9 * 86400}")
def visible_kind_days(spark, sf):
    days = F.col("t_valid").between(T0 + 5 * 86400, T0 + 9 * 86400)
    return records(spark, sf).filter(predicates.admissible(F.lit(NOW)) & (F.col("kind") == "event") & days).select("id", "t_valid")


@register("P2_preview", "SELECT doc_id, left(text, 180) AS preview FROM documents")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@register("P3_index_payload", f"{_R} SELECT id, tenant, namespace, kind, t_valid, coalesce(t_invalid, 0) AS t_invalid, trust_tier FROM r")
def index_payload(spark, sf):
    return predicates.index_payload(records(spark, sf))


@register("P4_episode_rendering", r"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS rendered FROM conversations GROUP BY conv_id")
def rendering(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(lines, "\n").alias("rendered"))


@register("S7_keyset_page", "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf):
    return table(spark, sf, "documents").filter("doc_id > 100").select("doc_id", "lang").orderBy("doc_id").limit(50)


@register("S14_cache_conflicts", "SELECT sha256(event_type) AS key, count(DISTINCT user_id) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def cache_conflicts(spark, sf):
    keyed = table(spark, sf, "events").select(F.sha2("event_type", 256).alias("key"), "user_id")
    return keyed.groupBy("key").agg(F.countDistinct("user_id").alias("n_values")).filter("n_values > 1")


@register("S17_caption_folding", "SELECT event_id, CASE WHEN trim(event_type) <> '' THEN props || ' [shared an image: ' || event_type || ']' ELSE props END AS turn_text FROM events")
def caption_folding(spark, sf):
    caption = F.concat(F.col("props"), F.lit(" [shared an image: "), F.col("event_type"), F.lit("]"))
    return table(spark, sf, "events").select("event_id", F.when(F.trim("event_type") != "", caption).otherwise(F.col("props")).alias("turn_text"))


@register("U2_current_records", """
WITH d AS (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS "at",
    CASE WHEN event_id % 4 < 2 THEN 'add' WHEN event_id % 4 = 2 THEN 'update' ELSE 'delete' END AS op,
    CASE WHEN event_id % 4 < 3 THEN event_id END AS id, CASE WHEN event_id % 4 >= 2 THEN event_id - (event_id % 4) - 4 * (event_id % 3) END AS target,
    floor(epoch(ts))::BIGINT + 60 AS t_valid FROM events),
e AS (SELECT target AS id, seq, CASE WHEN op = 'update' THEN t_valid ELSE "at" END AS t_invalid FROM d WHERE op IN ('update', 'delete')),
f AS (SELECT id, arg_min(t_invalid, seq) AS t_invalid FROM e GROUP BY id)
SELECT d.id, d.seq, d.t_valid, f.t_invalid FROM d LEFT JOIN f ON d.id = f.id WHERE d.op IN ('add', 'update')""")
def current_records(spark, sf):
    deltas = table(spark, sf, "events").selectExpr(
        "event_id AS seq", "unix_timestamp(ts) AS at",
        "CASE WHEN event_id % 4 < 2 THEN 'add' WHEN event_id % 4 = 2 THEN 'update' ELSE 'delete' END AS op",
        "CASE WHEN event_id % 4 < 3 THEN event_id END AS id",
        "CASE WHEN event_id % 4 >= 2 THEN event_id - (event_id % 4) - 4 * (event_id % 3) END AS target",
        "unix_timestamp(ts) + 60 AS t_valid",
    )
    return ledger.current_records(deltas).select("id", "seq", "t_valid", "t_invalid")


@register("W12_validity_by_successor", "SELECT o_orderkey, o_custkey, o_orderdate AS t_valid, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t_invalid FROM orders")
def validity(spark, sf):
    facts = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("t_valid"))
    return ledger.validity_by_successor(facts, ["o_custkey"], ["t_valid", "o_orderkey"])


@register("U6_touch_counts", "SELECT user_id AS record_id, count(*) AS access_count, max(ts) AS last_access FROM events WHERE event_type = 'click' GROUP BY user_id")
def touch_counts(spark, sf):
    log = table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "dedup").alias("kind"), F.col("user_id").alias("record_id"), F.col("ts").alias("at"))
    return ledger.touch_counts(log)


@register("U14_acl_access", """
WITH ua AS (SELECT DISTINCT o_custkey AS user_id, o_custkey % 50 AS agent_id FROM orders), an AS (SELECT DISTINCT s_suppkey % 50 AS agent_id, s_nationkey AS namespace FROM supplier)
SELECT DISTINCT user_id, namespace FROM ua JOIN an USING (agent_id)""")
def acl_access(spark, sf):
    ua = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 50).alias("agent_id")).distinct()
    an = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("agent_id"), F.col("s_nationkey").alias("namespace")).distinct()
    return ledger.may_access(ua, an)


@register("U15_trajectory_validity", """
WITH s AS (SELECT conv_id AS trajectory, turn, CASE WHEN conv_id % 9 = 0 AND turn = 2 THEN 0 ELSE turn END AS state_index FROM conversations),
o AS (SELECT *, lag(state_index) OVER (PARTITION BY trajectory ORDER BY turn) AS b FROM s)
SELECT trajectory, count(*) AS n_states, bool_and(b IS NULL OR b < state_index) AS valid FROM o GROUP BY trajectory""")
def trajectory_validity(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id AS trajectory", "turn AS position", "CASE WHEN conv_id % 9 = 0 AND turn = 2 THEN 0 ELSE turn END AS state_index")
    return ledger.valid_trajectories(s)


@register("A18_record_costs", """
WITH t AS (SELECT lang, greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS tokens FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tokens) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS n FROM t)
SELECT lang, round(avg(tokens), 6) AS mean_tokens, max(tokens) FILTER (nth = floor((n - 1) * 0.5 + 0.5)) AS p50, max(tokens) FILTER (nth = floor((n - 1) * 0.9 + 0.5)) AS p90,
  max(tokens) FILTER (nth = floor((n - 1) * 0.99 + 0.5)) AS p99, max(tokens) AS most FROM r GROUP BY lang""")
def record_costs(spark, sf):
    from palimpsest.evaluation.metrics import nearest_ranks

    cost = table(spark, sf, "documents").select("lang", approx_tokens(F.col("text")).alias("tokens"))
    shape = cost.groupBy("lang").agg(F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.max("tokens").alias("most"))
    return nearest_ranks(cost, ["lang"], "tokens", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).join(shape, "lang")
