"""Investigation of all benchmark questions in supersteps, and the gates over what it finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import channels
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.investigate import HEDGE, STATEMENT, Investigation, answerability_gate, digested, insufficiency_gate, investigate, premise_checked
from palimpsest.plans.common import register
from palimpsest.plans.ranking import _LIVE, _TERMS, _live, _questions
from palimpsest.sources.connectors import ReadingLlm, complete_column

STEPS, STEP_K = 3, 6


def _found(spark, sf, live) -> Investigation:
    probe = lambda queries: channels.lexical(queries, live, STEP_K)
    model = lambda rows, prompt, reply: complete_column(rows, ReadingLlm(), prompt, reply)
    return investigate(_questions(spark, sf), live, probe, model, STEPS, STEP_K)


def _step_sql(s: int) -> str:
    """One superstep: probe by BM25, add to the pool, stop or reflect."""
    last = s == STEPS
    judged = f"""CASE WHEN fresh = 0 AND {s} > 1 THEN 'no new evidence' {"ELSE 'step budget'" if last else "WHEN enough AND NOT alike THEN 'sufficient' WHEN trim(coalesce(nxt, '')) = '' OR list_contains(asked2, nxt) THEN 'no new query'"} END"""
    reflected = "fresh = 0 AND %d > 1" % s if not last else "TRUE"
    return f""",
q{s} AS (SELECT query_id, term, count(*) AS q FROM (SELECT query_id, unnest({_TERMS.format('search')}) AS term FROM s{s - 1} WHERE stopped IS NULL) GROUP BY ALL),
x{s} AS (SELECT query_id, id, round(sum(q * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) * ln((n - df + 0.5) / (df + 0.5) + 1)), 9) AS score FROM p JOIN d USING (term) JOIN q{s} USING (term), z GROUP BY query_id, id),
h{s} AS (SELECT * FROM x{s} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {STEP_K}),
n{s} AS MATERIALIZED (SELECT query_id, id, score FROM h{s} ANTI JOIN pool{s - 1} USING (query_id, id)),
pool{s} AS MATERIALIZED (SELECT * FROM pool{s - 1} UNION ALL SELECT * FROM n{s}),
m{s} AS (SELECT query_id, list(text ORDER BY score DESC, id)[:{2 * STEP_K}] AS ms FROM pool{s} JOIN r USING (id) GROUP BY query_id),
f{s} AS (SELECT query_id, count(*) AS fresh FROM n{s} GROUP BY query_id),
j{s} AS (SELECT s.* EXCLUDE (asked), coalesce(fresh, 0) AS fresh, list_append(asked, search) AS asked2, coalesce(len(list_filter(ms, lambda t: contains(t, question))) > 0, false) AS enough,
  coalesce(len(ms) > 1 AND left(ms[1], 20) = left(ms[2], 20) AND ms[1] <> ms[2], false) AS alike, right(ms[1], 80) AS nxt FROM s{s - 1} s LEFT JOIN f{s} USING (query_id) LEFT JOIN m{s} USING (query_id) WHERE stopped IS NULL),
s{s} AS MATERIALIZED (SELECT query_id, question, coalesce(nxt, search) AS search, asked2 AS asked, {s} AS steps, {judged} AS stopped, barren + (fresh = 0)::INT AS barren, conflicts + CASE WHEN {reflected} THEN 0 ELSE alike::INT END AS conflicts, n + fresh AS n
  FROM j{s} UNION ALL SELECT query_id, question, search, asked, steps, stopped, barren, conflicts, n FROM s{s - 1} WHERE stopped IS NOT NULL)"""


_INVESTIGATED = (
    _LIVE
    + f"""w AS (SELECT id, {_TERMS.format('text')} AS ws FROM r),
p AS MATERIALIZED (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM w) GROUP BY ALL),
z AS (SELECT count(*) AS n, avg(len(ws)) AS mean_length FROM w),
d AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term),
pool0 AS (SELECT 0::BIGINT AS query_id, 0::BIGINT AS id, 0::DOUBLE AS score WHERE false),
s0 AS (SELECT item_id AS query_id, text AS question, text AS search, []::VARCHAR[] AS asked, 0 AS steps, NULL::VARCHAR AS stopped, 0 AS barren, 0 AS conflicts, 0::BIGINT AS n FROM benchmark)"""
    + "".join(_step_sql(s) for s in range(1, STEPS + 1))
)


@register("R17_investigate", _INVESTIGATED + f"""
SELECT query_id, steps, stopped AS stopped_because, barren AS barren_steps, conflicts AS conflicts_seen, n::INT AS pool, array_to_string(asked, ' | ') AS asked, ids
FROM s{STEPS} LEFT JOIN (SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY score DESC, id) AS ids FROM pool{STEPS} GROUP BY query_id) USING (query_id)""")
def investigated(spark, sf):
    """A row a question: what it asked, how long, why it stopped, and the records it found, best first."""
    found = _found(spark, sf, _live(spark, sf))
    ids = found.pool.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("ids"))
    return found.trace.drop("question").withColumn("asked", F.array_join("asked", " | ")).join(ids, "query_id", "left")


def _evidence(found: Investigation, live):
    head = found.pool.filter("rank <= 6").join(live, "id")
    return head.select("query_id", F.col("rank").cast("int").alias("slot"), "id", F.lit("record").alias("source"), F.left("text", F.lit(200)).alias("value"))


def _replies(evidence, questions):
    """What a plain reader says of each set, as the JSON that a model would send."""
    sets = evidence.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"]).alias("ms")).join(questions.withColumnRenamed("text", "question"), "query_id")
    head, first = F.left("question", F.lit(40)), F.get("ms", F.lit(0))
    holds = F.exists("ms", lambda m: F.contains(m, F.col("question")))
    verdict = F.when(holds, "supported").when(F.size("ms") < 6, "ambiguous").otherwise("unsupported")
    missing = F.when(F.char_length("question") % 2 == 0, head).otherwise("")
    entries = F.transform("ms", lambda m, k: F.struct(k.cast("int").alias("memory"), F.when(F.char_length(m) % 2 == 0, F.left(m, F.lit(30))).otherwise("").alias("fact")))
    status = F.when(F.char_length(first) % 3 == 0, "contradicted").otherwise("absent")
    claims = F.array(F.struct(head.alias("claim"), status.alias("status"), F.lit(0).alias("evidence_index")), F.struct(head.alias("claim"), F.lit("contradicted").alias("status"), F.lit(9).alias("evidence_index")))
    json = {"verdict": F.struct(verdict.alias("verdict"), missing.alias("missing")), "digest": F.struct(entries.alias("entries")), "claims": F.struct(claims.alias("presuppositions"))}
    return sets.select("query_id", "ms", *[F.to_json(v).alias(k) for k, v in json.items()])


_SETS = f""",
e AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS slot, id, left(text, 200) AS value FROM pool{STEPS} JOIN r USING (id) QUALIFY slot <= 6),
g AS (SELECT query_id, list(value ORDER BY slot) AS ms, max(slot) AS last FROM e GROUP BY query_id),
b AS (SELECT g.*, text AS question, len(list_filter(ms, lambda m: contains(m, text))) > 0 AS holds FROM g JOIN benchmark ON item_id = query_id),
v AS (SELECT *, CASE WHEN holds THEN 'supported' WHEN len(ms) < 6 OR length(question) % 2 = 1 OR trim(left(question, 40)) = '' THEN 'ambiguous' ELSE 'unsupported' END AS support FROM b)
"""


@register("R18_answerability", _INVESTIGATED + _SETS + f"""
SELECT query_id, slot::INT AS slot, id, 'record' AS source, value FROM e JOIN v USING (query_id) WHERE support <> 'unsupported'
UNION ALL SELECT query_id, (last + 1)::INT, NULL, 'palimpsest://ambiguous', '{HEDGE}' FROM v WHERE support = 'ambiguous'
UNION ALL SELECT query_id, 1, NULL, 'palimpsest://insufficient', '{STATEMENT}' FROM v WHERE support = 'unsupported'""")
def answerability(spark, sf):
    live = _live(spark, sf)
    evidence = cut_lineage(_evidence(_found(spark, sf, live), live))
    return answerability_gate(evidence, _replies(evidence, _questions(spark, sf)).select("query_id", F.col("verdict").alias("reply")))


@register("R18_insufficiency", _INVESTIGATED + _SETS + f""",
t AS (SELECT query_id, stopped, nullif(trim(left(question, 40 * (length(question) % 2)::INT)), '') AS told FROM s{STEPS})
SELECT query_id, slot::INT AS slot, id, 'record' AS source, value FROM e JOIN t USING (query_id) WHERE stopped = 'sufficient'
UNION ALL SELECT query_id, 1, NULL, CASE WHEN told IS NULL THEN 'palimpsest://insufficient' ELSE 'palimpsest://premise' END, coalesce(told, '{STATEMENT}') FROM t WHERE stopped <> 'sufficient'""")
def insufficiency(spark, sf):
    """The analysis of a premise is the head of every other question; elsewhere the bare statement stays."""
    live = _live(spark, sf)
    found = _found(spark, sf, live)
    analyses = found.trace.select("query_id", F.trim(F.left("question", F.lit(40) * (F.char_length("question") % 2))).alias("reply"))
    return insufficiency_gate(_evidence(found, live), found.trace, analyses)


@register("R18_notes", _INVESTIGATED + _SETS + """,
d1 AS (SELECT query_id, last, list_transform(list_filter(range(1, len(ms) + 1), lambda k: length(ms[k]) % 2 = 0 AND trim(left(ms[k], 30)) <> ''), lambda k: '[' || (k - 1) || '] ' || trim(left(ms[k], 30))) AS facts FROM b),
d2 AS (SELECT query_id, last, facts FROM d1 WHERE len(facts) >= 2),
c AS (SELECT b.query_id, b.last + (d2.query_id IS NOT NULL)::INT AS last, '[premise] the question assumes "' || trim(left(question, 40)) || '", but memory [0] says otherwise: ' || rtrim(ms[1], ' ') AS value
  FROM b LEFT JOIN d2 USING (query_id) WHERE length(ms[1]) % 3 = 0 AND trim(left(question, 40)) <> '')
SELECT query_id, slot::INT AS slot, id, 'record' AS source, value FROM e
UNION ALL SELECT query_id, (last + 1)::INT, NULL, 'notes', '[notes] ' || array_to_string(facts, '; ') FROM d2
UNION ALL SELECT query_id, (last + 1)::INT, NULL, 'premise', value FROM c""")
def notes(spark, sf):
    """A digest behind each set, and behind that the claims which its memories contradict."""
    live = _live(spark, sf)
    evidence = cut_lineage(_evidence(_found(spark, sf, live), live))
    told = cut_lineage(_replies(evidence, _questions(spark, sf)))
    return premise_checked(digested(evidence, told.select("query_id", F.col("digest").alias("reply"))), told.select("query_id", F.col("claims").alias("reply")))
