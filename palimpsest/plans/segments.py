"""Turn streams: episodes, windows, boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import segment, turns
from palimpsest.plans.common import register, table

_TOKENS = "greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))"


@register("W1_episodes_by_cap", f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, {_TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, tokens AS used, 0 AS episode FROM t WHERE k = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.k, CASE WHEN used + tokens > 128 THEN tokens ELSE used + tokens END, episode + CASE WHEN used + tokens > 128 THEN 1 ELSE 0 END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, turn, episode, CASE WHEN lead(episode) OVER w IS NULL THEN 'end_of_unit' WHEN lead(episode) OVER w <> episode THEN 'token_cap' END AS ended_by FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def by_cap(spark, sf):
    return segment.episodes(table(spark, sf, "conversations"), "conv_id", "turn", token_cap=128).select("conv_id", "turn", "episode", "ended_by")


_FOLDED = """, f AS (SELECT unit, pos, k, tokens AS used, 0::BIGINT AS episode, 'first' AS why FROM t WHERE k = 1 UNION ALL
  SELECT unit, pos, k, CASE WHEN reason IS NULL THEN used + tokens ELSE tokens END, episode + (reason IS NOT NULL)::INT, reason FROM (
    SELECT t.unit, t.pos, t.k, t.tokens, f.used, f.episode, CASE WHEN t.gap THEN 'time_gap' WHEN t.topic THEN 'topic_shift' WHEN f.used + t.tokens > {cap} THEN 'token_cap' END AS reason
    FROM f JOIN t ON t.unit = f.unit AND t.k = f.k + 1))
SELECT unit, pos, episode, CASE WHEN lead(k) OVER w IS NULL THEN 'end_of_unit' WHEN lead(episode) OVER w <> episode THEN lead(why) OVER w END AS ended_by FROM f WINDOW w AS (PARTITION BY unit ORDER BY k)"""


@register("W1_episodes_by_gap", """
WITH RECURSIVE t AS (SELECT user_id % 7 AS unit, event_id AS pos, length(event_type) * 9 AS tokens, false AS topic, row_number() OVER w AS k,
  coalesce(floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT > 3600, false) AS gap FROM events WINDOW w AS (PARTITION BY user_id % 7 ORDER BY event_id))""" + _FOLDED.format(cap=512))
def by_gap(spark, sf):
    """Users' events in seven streams, spread over tasks: gaps of an hour, and a cap on what an episode holds."""
    rows = table(spark, sf, "events").selectExpr("user_id % 7 AS unit", "event_id AS pos", "ts", "repeat('wo ', length(event_type) * 9) AS text")
    return segment.episodes(rows, "unit", "pos", at="ts", fold_turns=0).select("unit", "pos", "episode", "ended_by")


_LETTERS = "aeiounrst"


def _stream(spark, sf):
    """All conversations in four long streams of turns, with counts of letters as their vectors."""
    count = [f"cast(length(text) - length(replace(text, '{c}', '')) as double)" for c in _LETTERS]
    return table(spark, sf, "conversations").selectExpr("conv_id % 4 AS unit", "conv_id * 100 + turn AS pos", "text", f"array({', '.join(count)}) AS vector")


_ACKS = ", ".join(f"'{a}'" for a in turns.ACKNOWLEDGEMENTS)
_TOPICS = f"""
WITH RECURSIVE s AS (SELECT conv_id % 4 AS unit, conv_id * 100 + turn AS pos, text, {_TOKENS} AS tokens, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w <> '') AS ws FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY pos) AS k, list_distinct(list_filter(ws, lambda w: length(w) >= 3)) AS content FROM s
  WHERE len(ws) >= 4 AND NOT (len(ws) <= 8 AND (array_to_string(ws, ' ') IN ({_ACKS}) OR len(list_filter([{_ACKS}], lambda c: starts_with(array_to_string(ws, ' '), c || ' '))) > 0))),
kf AS (SELECT unit, k, pos, content AS held, true AS key FROM a WHERE k = 1 UNION ALL
  SELECT unit, k, pos, CASE WHEN again THEN held ELSE content END, NOT again FROM (SELECT a.unit, a.k, a.pos, a.content, kf.held, len(a.content) > 0 AND len(list_intersect(a.content, kf.held)) / len(a.content) >= 0.8 AS again FROM kf JOIN a ON a.unit = kf.unit AND a.k = kf.k + 1)),
u AS (SELECT kf.unit, kf.pos, row_number() OVER (PARTITION BY kf.unit ORDER BY kf.pos) - 1 AS nth, [{', '.join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in _LETTERS)}] AS v FROM kf JOIN s USING (unit, pos) WHERE key),
n AS (SELECT unit, count(*) AS n_key FROM u GROUP BY unit HAVING count(*) >= 6),
g AS (SELECT unit, nth AS gap, round(coalesce(list_cosine_similarity(v, lead(v) OVER (PARTITION BY unit ORDER BY nth)), 0), 9) AS sim, n_key FROM u JOIN n USING (unit) QUALIFY lead(nth) OVER (PARTITION BY unit ORDER BY nth) IS NOT NULL),
e AS (SELECT unit, gap, n_key, CASE WHEN count(sim) OVER l = 2 AND count(sim) OVER r = 2 THEN round(avg(sim) OVER l + avg(sim) OVER r - 2 * sim, 6) END AS depth FROM g
  WINDOW l AS (PARTITION BY unit ORDER BY gap ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY unit ORDER BY gap ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
c AS (SELECT unit, gap FROM (SELECT unit, gap, n_key FROM e WHERE depth IS NOT NULL WINDOW w AS (PARTITION BY unit ORDER BY gap), v AS (PARTITION BY unit) QUALIFY depth > coalesce(lag(depth) OVER w, -1e9) AND depth > coalesce(lead(depth) OVER w, -1e9)
  AND round(depth, 6) >= round(avg(depth) OVER v - 0.5 * stddev_pop(depth) OVER v, 6) AND max(depth) OVER v > min(depth) OVER v) WHERE gap >= 1 AND n_key - gap >= 3),
o AS (SELECT u.unit, u.pos FROM c JOIN u ON u.unit = c.unit AND u.nth = c.gap + 1)
"""


@register("W6_spread_keys", _TOPICS.replace("s AS (SELECT conv_id", "s AS MATERIALIZED (SELECT conv_id", 1) + "SELECT s.unit, s.pos, coalesce(key, false) AS key FROM s LEFT JOIN kf ON kf.unit = s.unit AND kf.pos = s.pos")
def spread_keys(spark, sf):
    return turns.key_utterances(_stream(spark, sf), "unit", "pos", fold_turns=0).select("unit", "pos", "key")


@register("W6_key_utterances", _TOPICS.replace("conv_id % 4 AS unit, conv_id * 100 + turn AS pos", "conv_id AS unit, turn AS pos", 1) + "SELECT s.unit AS conv_id, s.pos AS turn, coalesce(key, false) AS key FROM s LEFT JOIN kf ON kf.unit = s.unit AND kf.pos = s.pos")
def key_utterances(spark, sf):
    return turns.key_utterances(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", "key")


@register("W1_episodes_by_topic", _TOPICS + ", t AS (SELECT s.unit, s.pos, tokens, false AS gap, o.pos IS NOT NULL AS topic, row_number() OVER (PARTITION BY s.unit ORDER BY s.pos) AS k FROM s LEFT JOIN o ON o.unit = s.unit AND o.pos = s.pos)" + _FOLDED.format(cap=128))
def by_topic(spark, sf):
    """Key utterances, depths between them and boundaries give topics; topics and the cap give episodes."""
    rows = _stream(spark, sf)
    topics = turns.topic_starts(rows, "unit", "pos", fold_turns=0).withColumn("topic", F.lit(True))
    flagged = rows.drop("vector").join(topics, ["unit", "pos"], "left")
    return segment.episodes(flagged, "unit", "pos", token_cap=128, topic="topic", fold_turns=0).select("unit", "pos", "episode", "ended_by")


@register("W2_windows", """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, k::INT AS window, (k * 20)::INT AS lo, least(n, k * 20 + 25) AS hi FROM (SELECT user_id, n, unnest(range(0, greatest(0, ceil((n - 25) / 20.0))::BIGINT + 1)) AS k FROM n)""")
def windows(spark, sf):
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return segment.windows(table(spark, sf, "events").withColumn("position", position.cast("long")), "user_id", "position")


_SIM = """v AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
s AS (SELECT label, vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], nxt::DOUBLE[]), 0), 9) AS similarity FROM v WHERE nxt IS NOT NULL)"""


def _similar(spark, sf):
    return segment.adjacent_similarity(table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("vector")), "label", "vec_id").drop("vector")


@register("W5_adjacent_similarity", f"WITH {_SIM} SELECT label, vec_id, round(similarity, 6) AS similarity FROM s")
def adjacent(spark, sf):
    return _similar(spark, sf).withColumn("similarity", F.round("similarity", 6))


@register("W3_depths", f"""WITH {_SIM}
SELECT label, vec_id, CASE WHEN count(similarity) OVER l = 2 AND count(similarity) OVER r = 2 THEN round(round(avg(similarity) OVER l + avg(similarity) OVER r - 2 * similarity, 6), 4) END AS depth FROM s
WINDOW l AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def depths(spark, sf):
    return segment.depths(_similar(spark, sf), "label", "vec_id").select("label", "vec_id", F.round("depth", 4).alias("depth"))


@register("W4_boundary_candidates", f"""WITH {_SIM},
d AS (SELECT label, vec_id, CASE WHEN count(similarity) OVER l = 2 AND count(similarity) OVER r = 2 THEN round(avg(similarity) OVER l + avg(similarity) OVER r - 2 * similarity, 6) END AS depth FROM s
  WINDOW l AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT label, vec_id, depth FROM d WHERE depth IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY vec_id), v AS (PARTITION BY label)
QUALIFY depth > coalesce(lag(depth) OVER w, -1e9) AND depth > coalesce(lead(depth) OVER w, -1e9) AND round(depth, 6) >= round(avg(depth) OVER v - 0.5 * stddev_pop(depth) OVER v, 6)""")
def boundaries(spark, sf):
    return segment.boundary_candidates(segment.depths(_similar(spark, sf), "label", "vec_id"), "label", "vec_id").select("label", "vec_id", "depth")


@register("W7_merged_windows", """
WITH c AS (SELECT conv_id, greatest(0, turn - 1) AS lo, turn + 1 AS hi FROM conversations WHERE turn % 4 = 0 OR turn % 7 = 1),
b AS (SELECT *, max(hi) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT conv_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY conv_id, island""")
def merged(spark, sf):
    return segment.merged_windows(table(spark, sf, "conversations").filter("turn % 4 = 0 OR turn % 7 = 1"), "conv_id", "turn", 1)


@register("J14_previous_user_turn", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_turn FROM conversations""")
def previous_user_turn(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return segment.previous_of(turns, "conv_id", "turn", F.col("role") == "user", ["turn"])


@register("W11_accumulator", """
WITH c AS (SELECT user_id, event_id, (event_id * 7) % 50 AS amount, sum((event_id * 7) % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)
SELECT user_id, event_id, floor(total / 150)::BIGINT AS passed, floor(total / 150) > floor((total - amount) / 150) AS fires FROM c""")
def accumulator(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_id", "(event_id * 7) % 50 AS amount")
    return segment.accumulator_fires(rows, "user_id", "event_id", "amount", 150).select("user_id", "event_id", "passed", "fires")


@register("A15_first_wins", "SELECT role, text, min((conv_id * 1000 + turn)) AS first_at FROM conversations GROUP BY ALL")
def first_wins(spark, sf):
    """Distinct facts by their key; the earliest (window, position) wins."""
    rows = table(spark, sf, "conversations").select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return rows.groupBy("role", "text").agg(F.min("at").alias("first_at"))
