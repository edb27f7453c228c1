"""Word helpers, incidence, side blocks and a probe of the judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation import arms
from palimpsest.functions import replies, text
from palimpsest.operators import ledger, pools, turns
from palimpsest.operators.side_blocks import EVENTS, PROFILE, side_block, user_block
from palimpsest.plans.common import RECORDS_SQL, register, records, table
from palimpsest.plans.said import _CUT, _PAIRS_SQL, _pairs
from palimpsest.plans.scalars import _NORM

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w <> '')"
_SINGULAR = "list_transform({0}, lambda w: CASE WHEN ends_with(w, 'es') AND length(w) >= 5 THEN left(w, -2) WHEN ends_with(w, 's') AND length(w) >= 4 THEN left(w, -1) ELSE w END)"


@register("C7_gold_recall", f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, {_NORM.format('text')} AS e, {_NORM.format('gold')} AS g FROM pr)
SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 1 ELSE coalesce(list_sum(list_transform(list_distinct(list_intersect(e, g)), lambda w: least(len(list_filter(e, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) / len(g) END, 6) AS recall FROM n""")
def gold_recall(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(text.gold_token_recall(F.col("text"), F.col("gold")), 6).alias("recall"))


@register("C15_content_words", f"SELECT conv_id, turn, array_to_string({_SINGULAR.format('list_sort(list_distinct(list_filter(' + _WORDS.format('text') + ', lambda w: length(w) >= 4)))')}, ' ') AS words FROM conversations")
def content(spark, sf):
    singular = F.transform(text.content_words(F.col("text")), text.singular)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(singular, " ").alias("words"))


@register("C16_stated", f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, {_SINGULAR.format(_WORDS.format('left(gold, 12)'))} AS need, {_SINGULAR.format(_WORDS.format('text'))} AS have FROM pr)
SELECT conv_id, turn, len(list_filter(need, lambda w: NOT list_contains(have, w))) = 0 AS stated FROM n""")
def stated(spark, sf):
    """Whether the first words of the item are words of the turn, up to plural."""
    return _pairs(spark, sf).select("conv_id", "turn", text.states(F.left("gold", F.lit(12)), F.col("text")).alias("stated"))


@register("A14_incidence_phrases", f"WITH p AS (SELECT conv_id, turn, list_concat(string_split(text, '.'), {_WORDS.format('text')}) AS ps FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(ps))[:32], '|') AS phrases FROM p")
def incidence_phrases(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(pools.incidence_phrases(F.split("text", "\\."), text.words(F.col("text"))), "|").alias("phrases"))


@register("D11_replaced_incidence", """
WITH old AS (SELECT l_partkey AS phrase, l_orderkey AS record_id, l_quantity AS weight FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT l_suppkey AS phrase, l_orderkey AS record_id, l_extendedprice AS weight FROM lineitem WHERE l_discount > 0.05)
SELECT * FROM old WHERE record_id NOT IN (SELECT record_id FROM new) UNION ALL SELECT phrase, record_id, max(weight) FROM new GROUP BY phrase, record_id""")
def replaced(spark, sf):
    items = table(spark, sf, "lineitem")
    old = items.filter("l_linenumber <= 2").selectExpr("l_partkey AS phrase", "l_orderkey AS record_id", "l_quantity AS weight")
    new = items.filter("l_discount > 0.05").selectExpr("l_suppkey AS phrase", "l_orderkey AS record_id", "l_extendedprice AS weight")
    return ledger.replace_incidence(old, new)


@register("E24_judge_probe", f"""WITH {_PAIRS_SQL}, c AS (SELECT role AS cohort, length(text) % 5 = 0 OR contains(lower(text), 'ing') AS caught FROM pr),
g AS (SELECT cohort, count(*) FILTER (caught) AS caught, count(*) AS n FROM c GROUP BY cohort), p AS (SELECT *, caught / n AS p, 1 + 1.96 * 1.96 / n AS s, 1.96 * sqrt((caught / n * (1 - caught / n) + 1.96 * 1.96 / (4 * n)) / n) AS h FROM g)
SELECT cohort, caught, n, round(p, 6) AS rate, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - h) / s), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n) + h) / s), 6) AS high FROM p""")
def judge_probe(spark, sf):
    """How many turns, none of them an attack, a judge's replies would quarantine; what cannot be read does."""
    json = F.to_json(F.struct(F.contains(F.lower("text"), F.lit("ing")).alias("injection"), F.col("text").alias("reason")))
    rows = _pairs(spark, sf).select(F.col("role").alias("cohort"), replies.verdict_tier(_CUT(json), F.lit("asserted")).alias("tier"))
    return arms.gate_rates(rows, F.col("tier") == "quarantined").select("cohort", "caught", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


_SIDE = f"""
WITH RECURSIVE b AS (SELECT * FROM (VALUES ('events', 'semantic', '{EVENTS.header}', 3), ('profile', 'profile', '{PROFILE.header}', 8)) AS t(block, kind, header, m)),
r AS (SELECT id, tenant AS scope, kind, text, (make_timestamp(t_valid * 1000000))::DATE AS day FROM ({RECORDS_SQL})),
q AS (SELECT item_id AS query_id, text AS question, (SELECT list_sort(list(DISTINCT scope)) FROM r)[1 + item_id % (SELECT count(DISTINCT scope) FROM r)] AS scope, DATE '2024-01-01' + (length(text) % 30)::INT AS lo FROM benchmark WHERE length(text) % 4 <> 0),
h AS (SELECT scope, kind FROM r GROUP BY ALL HAVING count(*) <= 2000),
s AS (SELECT block, m, query_id, id, r.text, round(1.0::DOUBLE / (1 + abs(length(r.text) - length(question))), 9) AS score, greatest(length(r.text) // 4, len(list_filter(regexp_split_to_array(r.text, '\\s+'), lambda w: w <> ''))) AS tokens
  FROM q JOIN r USING (scope) JOIN b ON b.kind = r.kind JOIN h ON h.scope = r.scope AND h.kind = r.kind WHERE block = 'profile' OR day BETWEEN lo AND lo + 9),
k AS (SELECT *, row_number() OVER (PARTITION BY block, query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= m),
f AS (SELECT block, query_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS kept, NULL::BIGINT AS id, NULL::VARCHAR AS text, 0::BIGINT AS tokens FROM (SELECT DISTINCT block, query_id FROM k) UNION ALL
  SELECT k.block, k.query_id, k.rank, CASE WHEN f.kept = 0 OR f.used + k.tokens <= 512 THEN f.used + k.tokens ELSE f.used END, f.kept + (f.kept = 0 OR f.used + k.tokens <= 512)::INT, CASE WHEN f.kept = 0 OR f.used + k.tokens <= 512 THEN k.id END, k.text, k.tokens
  FROM f JOIN k ON k.block = f.block AND k.query_id = f.query_id AND k.rank = f.rank + 1)
SELECT block, query_id, kept AS slot, id, text AS value, tokens FROM f WHERE id IS NOT NULL
UNION ALL SELECT DISTINCT f.block, query_id, 0, NULL::BIGINT, header, greatest(length(header) // 4, len(string_split(header, ' '))) FROM f JOIN b USING (block)"""


@register("R13_side_blocks", _SIDE)
def side_blocks(spark, sf):
    """Both blocks of each item that opens them: events of ten days from one that its length gives, and profiles."""
    rows = records(spark, sf, "id", "tenant", "kind", "text", "t_valid").select("id", F.col("tenant").alias("scope"), "kind", "text", F.to_date(F.timestamp_seconds("t_valid")).alias("day"))
    scopes = rows.select("scope").distinct().agg(F.array_sort(F.collect_list("scope")).alias("all"))  # tenants of the store
    items = table(spark, sf, "benchmark").crossJoin(F.broadcast(scopes))
    lo = F.date_add(F.to_date(F.lit("2024-01-01")), (F.char_length("text") % 30).cast("int"))
    asked = items.select(F.col("item_id").alias("query_id"), F.get("all", (F.col("item_id") % F.size("all")).cast("int")).alias("scope"), "text", (F.char_length("text") % 4 != 0).alias("open"), lo.alias("lo"), F.date_add(lo, 9).alias("hi"))
    near = lambda question, text: 1 / (1 + F.abs(F.char_length(text) - F.char_length(question)))
    events = side_block(asked, rows, EVENTS, near)
    profile = side_block(asked.withColumns({"lo": F.lit(None).cast("date"), "hi": F.lit(None).cast("date")}), rows, PROFILE, near)
    return events.select(F.lit("events").alias("block"), "*").unionByName(profile.select(F.lit("profile").alias("block"), "*"))


@register("R14_user_block", """
WITH RECURSIVE t AS (SELECT conv_id % 5 AS query_id, conv_id * 1000 + turn AS id, conv_id, turn, greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS tokens FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conv_id, turn, id) AS rank FROM t),
f AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, 0 AS kept, NULL::BIGINT AS id, 0::BIGINT AS tokens FROM (SELECT DISTINCT query_id FROM k) UNION ALL
  SELECT k.query_id, k.rank, CASE WHEN f.kept = 0 OR f.used + k.tokens <= 1024 THEN f.used + k.tokens ELSE f.used END, f.kept + (f.kept = 0 OR f.used + k.tokens <= 1024)::INT, CASE WHEN f.kept = 0 OR f.used + k.tokens <= 1024 THEN k.id END, k.tokens FROM f JOIN k ON k.query_id = f.query_id AND k.rank = f.rank + 1)
SELECT query_id, id, tokens, kept AS position, max(used) OVER (PARTITION BY query_id) AS total_tokens FROM f QUALIFY id IS NOT NULL""".replace("max(used) OVER (PARTITION BY query_id) AS total_tokens FROM f QUALIFY id IS NOT NULL", "total_tokens FROM f JOIN (SELECT query_id, max(used) AS total_tokens FROM f GROUP BY query_id) USING (query_id) WHERE id IS NOT NULL"))
def user_words_block(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("index"), "role", "text")
    evidence = rows.filter("session % 3 = 0").select((F.col("session") % 5).alias("query_id"), "session")
    return user_block(turns.user_words(evidence, rows))
