"""Replies, statements, verdicts and runs that are read from the given tables' texts and from retrieval over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.evaluation import arms, audit
from palimpsest.functions import replies, text
from palimpsest.functions.shapes import AGGREGATION_CUES, INTERVAL_CUES
from palimpsest.functions.text import ABSTENTION_STARTS, ABSTENTIONS
from palimpsest.functions.trust import OVERRIDE_CUES, assess_trust
from palimpsest.operators import ledger
from palimpsest.operators.applying import apply_in_order
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.plans.applied import _APPLIED, _outcomes
from palimpsest.plans.common import register, table
from palimpsest.plans.investigation import _INVESTIGATED, STEPS, _found
from palimpsest.plans.ranking import _BM25_CTE, _LIVE, _live
from palimpsest.plans.scalars import _NORM
from palimpsest.plans.trials import _gold, _lists

#: How a reply opens, by the length of what it goes on with: declines, and words that only look like one.
_LEADS = ("", "I don't know; ", "No information: ", "Unknown ", "I know, ", "I cannot determine that. ", "There is no information on it. ")
_LEAD = "CASE length({0}) % 7 " + " ".join("WHEN %d THEN '%s'" % (k, lead.replace("'", "''")) for k, lead in enumerate(_LEADS)) + " END"
_REPLY = f"concat({_LEAD.format('c.text')}, c.text)"
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_DECLINES = "(array_to_string({0}, ' ') IN (" + _QUOTED(ABSTENTIONS) + ") OR len(list_filter([" + _QUOTED(ABSTENTION_STARTS) + "], lambda s: starts_with(array_to_string({0}, ' '), s))) > 0)"
_PAIRS_SQL = f"pr AS (SELECT c.conv_id, c.turn, c.role, c.text, b.text AS gold, {_REPLY} AS reply FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40)"


def _pairs(spark, sf):
    """Each turn as a reply to the benchmark item that its conversation's number gives."""
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("gold"))
    rows = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") % 40).join(gold, "k").alias("c")
    return rows.select("conv_id", "turn", "role", "text", "gold", F.expr(_REPLY).alias("reply"))


@register("C5_abstentions", f"WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, {_NORM.format('reply')} AS w FROM pr) SELECT conv_id, turn, {_DECLINES.format('w')} AS declined FROM n")
def abstentions(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", text.is_abstention(F.col("reply")).alias("declined"))


@register("C6_score_one", f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, length(text) % 3 = 0 AS adversarial, {_NORM.format('reply')} AS p, {_NORM.format('gold')} AS g FROM pr),
s AS (SELECT *, {_DECLINES.format('p')} AS declined, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS same FROM n)
SELECT conv_id, turn, round(CASE WHEN adversarial THEN declined::INT WHEN declined THEN 0 WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INT ELSE 2.0 * same / (len(p) + len(g)) END, 6) AS score,
  CASE WHEN adversarial THEN declined::INT WHEN declined THEN 0 ELSE (p = g)::INT END::DOUBLE AS exact FROM s""")
def score_one(spark, sf):
    got = replies.score_one(F.col("reply"), F.col("gold"), F.char_length("text") % 3 == 0)
    return _pairs(spark, sf).select("conv_id", "turn", got.alias("s")).select("conv_id", "turn", F.round("s.score", 6).alias("score"), F.col("s.exact").alias("exact"))


#: A reply that is cut off cannot be read.
_CUT = lambda json: F.when(F.char_length("text") % 5 == 0, F.left(json, F.lit(9))).otherwise(json)
_MISMATCH = "CASE length(text) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'detail unstated' WHEN 2 THEN 'other person' ELSE gold END"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@register("C26_accepted", f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, text, reply, gold, {_NORM.format('reply')} AS w FROM pr),
a AS (SELECT *, {_DECLINES.format('w')} AS declined, length(text) % 5 <> 0 AS readable FROM n)
SELECT conv_id, turn, CASE WHEN readable AND length(text) % 2 = 0 AND NOT declined AND {_TRIM.format('reply')} <> '' THEN ' ' || reply END AS by_commit,
  CASE WHEN readable AND {_MISMATCH} IN ('none', 'detail unstated') AND NOT declined THEN nullif({_TRIM.format('reply')}, '') END AS typed FROM a""")
def accepted(spark, sf):
    """A reader's second pass over its own reply, as JSON; a fifth of the replies are cut off."""
    json = F.to_json(F.struct(F.concat(F.lit(" "), F.col("reply")).alias("answer"), (F.char_length("text") % 2 != 0).alias("evidence_absent"), F.expr(_MISMATCH).alias("mismatch")))
    rows = _pairs(spark, sf).withColumn("json", _CUT(json))
    return rows.select("conv_id", "turn", replies.accepted_commit(F.col("json")).alias("by_commit"), replies.accepted_typed(F.col("json")).alias("typed"))


@register("U7_adjudicated", f"WITH {_PAIRS_SQL} SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 OR contains(lower(text), 'ing') THEN 'quarantined' ELSE role END AS tier FROM pr")
def adjudicated(spark, sf):
    """A judge that takes every progressive for an injection, and gives its text as the reason."""
    json = F.to_json(F.struct(F.contains(F.lower("text"), F.lit("ing")).alias("injection"), F.col("text").alias("reason")))
    return _pairs(spark, sf).select("conv_id", "turn", replies.verdict_tier(_CUT(json), F.col("role")).alias("tier"))


@register("U8_valid_candidates", """
WITH f AS (SELECT conv_id, turn, generate_subscripts(fs, 1) AS pos, unnest(fs) AS fact FROM (SELECT conv_id, turn, string_split(text, '.') AS fs FROM conversations WHERE length(text) % 5 <> 0)),
k AS (SELECT conv_id, turn, pos, trim(fact) AS text, list_sort(list_distinct(list_filter(list_transform(string_split(fact, ','), lambda e: trim(e)), lambda e: e <> ''))) AS es FROM f WHERE trim(fact) <> '')
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, turn)::INT AS n, text, array_to_string(es, '|') AS entities FROM k""")
def candidates(spark, sf):
    """Sentences as extracted facts and their clauses as entities."""
    facts = F.transform(F.split("text", "\\."), lambda s: F.struct(s.alias("text"), F.split(s, ",").alias("entities")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", replies.valid_candidates(_CUT(F.to_json(F.struct(facts.alias("facts"))))).alias("c"))
    return rows.select("conv_id", "turn", F.size("c").alias("n"), F.explode("c").alias("f")).select("conv_id", "turn", "n", "f.text", F.array_join("f.entities", "|").alias("entities"))


@register("E27_grader_replies", f"""WITH {_PAIRS_SQL}, g AS (SELECT conv_id, turn, text, CASE length(text) % 3 WHEN 0 THEN ' correct' WHEN 1 THEN 'wrong' ELSE gold END AS label, CASE length(gold) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS score, length(text) % 5 <> 0 AS readable FROM pr)
SELECT conv_id, turn, CASE WHEN readable THEN (upper(trim(label)) = 'CORRECT')::INT END AS by_label, CASE WHEN readable AND score IN (0.0, 1.0) THEN score::INT END AS by_score, contains(lower(text), 'yes')::INT AS by_yes FROM g""")
def graded(spark, sf):
    """A grader that labels and scores by lengths, in a fence where the turn is the user's."""
    label = F.expr("CASE length(text) % 3 WHEN 0 THEN ' correct' WHEN 1 THEN 'wrong' ELSE gold END")
    score = F.expr("CASE length(gold) % 3 WHEN 0 THEN 1D WHEN 1 THEN 0D ELSE 0.5D END")
    json = F.to_json(F.struct(label.alias("label"), score.alias("score")))
    fenced = F.when(F.col("role") == "user", F.concat(F.lit("So:\n```json\n"), json, F.lit("\n```"))).otherwise(json)
    rows = _pairs(spark, sf).withColumn("json", F.when(F.char_length("text") % 5 == 0, F.left(json, F.lit(9))).otherwise(fenced))
    return rows.select("conv_id", "turn", audit.graded(F.col("json"), "label").alias("by_label"), audit.graded(F.col("json"), "score").alias("by_score"), audit.graded(F.col("text"), "yes").alias("by_yes"))


_NAME = "CASE role WHEN 'user' THEN 'Nat' ELSE 'Jon' END"
_SPEAKS = lambda t, n: f"regexp_matches({t}, '(^|[^A-Za-z0-9]){n}($|[^A-Za-z0-9])')"
_NEGATES = "len(list_filter(regexp_split_to_array(replace(lower({0}), '’', ''''), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w IN ('not', 'never', 'no') OR ends_with(w, 'n''t')))"


@register("C27_dialogue", f"""WITH {_PAIRS_SQL}, d AS (SELECT conv_id, turn, {_NAME} || CASE WHEN length(text) % 3 = 0 THEN ' never' WHEN length(text) % 3 = 1 THEN ' and Jonathan' ELSE '' END || ' said: ' || text AS statement, 'Did ' || CASE WHEN length(gold) % 2 = 0 THEN 'Nat' ELSE 'Jon''s brother' END || ' say: ' || gold AS question FROM pr)
SELECT conv_id, turn, CASE WHEN {_NEGATES.format('statement')} > {_NEGATES.format('question')} THEN 'negates the question' WHEN {_SPEAKS('statement', 'Jon')} AND NOT {_SPEAKS('question', 'Jon')} THEN 'names Jon, whom the question does not' WHEN {_SPEAKS('statement', 'Nat')} AND NOT {_SPEAKS('question', 'Nat')} THEN 'names Nat, whom the question does not' END AS why,
  CASE WHEN {_SPEAKS('statement', 'Jon')} AND NOT {_SPEAKS('statement', 'Nat')} THEN regexp_replace(statement, '(^|[^A-Za-z0-9])Jon($|[^A-Za-z0-9])', '\\1Nat\\2', 'g') WHEN {_SPEAKS('statement', 'Nat')} AND NOT {_SPEAKS('statement', 'Jon')} THEN regexp_replace(statement, '(^|[^A-Za-z0-9])Nat($|[^A-Za-z0-9])', '\\1Jon\\2', 'g') END AS swapped FROM d""")
def dialogue(spark, sf):
    """Each turn as a statement by its speaker, against a question about the item."""
    lead = F.expr(_NAME + " || CASE WHEN length(text) % 3 = 0 THEN ' never' WHEN length(text) % 3 = 1 THEN ' and Jonathan' ELSE '' END || ' said: '")
    asked = F.expr("'Did ' || CASE WHEN length(gold) % 2 = 0 THEN 'Nat' ELSE 'Jon''s brother' END || ' say: ' || gold")
    memory = F.concat(F.lit("[2024] Jon: "), F.regexp_replace("text", "\r?\n", " "), F.lit("\n[2024] Nat: "), F.regexp_replace("gold", "\r?\n", " "))
    rows = _pairs(spark, sf).withColumns({"statement": F.concat(lead, F.col("text")), "question": asked, "speakers": replies.dialogue_speakers(F.array(memory, F.lit("no turn")))})
    return rows.select("conv_id", "turn", replies.disputes(F.col("statement"), F.col("question"), F.col("speakers")).alias("why"), replies.speaker_swap(F.col("statement"), F.col("speakers")).alias("swapped"))


_CUED = lambda cues: f"len(list_filter([{_QUOTED(cues)}], lambda c: contains(lower(q), c))) > 0"


@register("K7_question_depth", f"""
WITH q AS (SELECT conv_id, turn, CASE length(text) % 4 WHEN 0 THEN 'How many times did I say ' WHEN 1 THEN 'What are all the ' WHEN 2 THEN 'In total, what was ' ELSE '' END || text AS q FROM conversations),
a AS (SELECT conv_id, turn, {_CUED(AGGREGATION_CUES)} AND NOT ({_CUED(INTERVAL_CUES)}) AS sums FROM q)
SELECT conv_id, turn, CASE WHEN sums THEN 18 ELSE 6 END AS k, CASE WHEN sums THEN 8192 ELSE 2048 END AS tokens FROM a""")
def question_depth(spark, sf):
    asked = F.expr("concat(CASE length(text) % 4 WHEN 0 THEN 'How many times did I say ' WHEN 1 THEN 'What are all the ' WHEN 2 THEN 'In total, what was ' ELSE '' END, text)")
    depth = audit.depth_for(asked, 6, 2048, {"aggregation": (18, 8192)})
    return table(spark, sf, "conversations").select("conv_id", "turn", depth["k"].alias("k"), depth["tokens"].alias("tokens"))


@register("U5_outcome_counts", _APPLIED + """, o2 AS (SELECT user_id, CASE WHEN accepted THEN op ELSE 'rejected' END AS op FROM f WHERE seq IS NOT NULL)
SELECT user_id, count(*) FILTER (op = 'add') AS "add", count(*) FILTER (op = 'update') AS "update", count(*) FILTER (op = 'delete') AS "delete", count(*) FILTER (op = 'noop') AS noop, count(*) FILTER (op = 'duplicate') AS duplicate, count(*) FILTER (op = 'quarantine') AS quarantine, count(*) FILTER (op = 'rejected') AS rejected FROM o2 GROUP BY user_id""")
def outcome_counts(spark, sf):
    """Counters of the outcomes as they were applied: a refused one counts as rejected."""
    outcomes = _outcomes(spark, sf)
    done = apply_in_order(outcomes, outcomes.select("id").limit(0))
    return ledger.outcome_counts(done.withColumn("op", F.when(F.col("accepted"), F.col("op")).otherwise("rejected")), ["user_id"])


_CUES_SQL = _QUOTED(OVERRIDE_CUES)
_POISONED = "concat(left(text, cast(floor(length(text) / 2) as int)), CASE WHEN length(text) % 3 = 0 THEN '' ELSE CASE length(text) % 5 " + " ".join(f"WHEN {k} THEN ' {c} '" for k, c in enumerate(OVERRIDE_CUES[:5])) + " END END, substr(text, cast(floor(length(text) / 2) as int) + 1))"


@register("E18_gate_rates", f"""
WITH c AS (SELECT role AS cohort, len(list_filter([{_CUES_SQL}], lambda c: contains(lower(CASE WHEN role = 'user' THEN {_POISONED} ELSE text END), c))) > 0 AS caught FROM conversations),
g AS (SELECT cohort, count(*) FILTER (caught) AS caught, count(*) AS n FROM c GROUP BY cohort), p AS (SELECT *, caught / n AS p, 1 + 1.96 * 1.96 / n AS s, 1.96 * sqrt((caught / n * (1 - caught / n) + 1.96 * 1.96 / (4 * n)) / n) AS h FROM g)
SELECT cohort, caught, n, round(p, 6) AS rate, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - h) / s), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n) + h) / s), 6) AS high FROM p""")
def gate_rates(spark, sf):
    """Users' turns with an order put into the middle of most, against the assistants' turns as they are."""
    rows = table(spark, sf, "conversations").selectExpr("role AS cohort", f"CASE WHEN role = 'user' THEN {_POISONED} ELSE text END AS text")
    rates = arms.gate_rates(rows, assess_trust(F.col("text"), F.lit("asserted"))["tier"] == "quarantined")
    return rates.select("cohort", "caught", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


def _ms(q: float, name: str) -> str:
    return f"list_sort(list(ms))[(floor((count(*) - 1) * {q} + 0.5))::INT + 1] AS {name}"


_WIDTHS = (2, 6, 20)
_RUNS_SQL = _LIVE + _BM25_CTE + f""",
gold AS (SELECT item_id AS query_id, id FROM benchmark b JOIN r ON length(b.text) > 0 AND contains(r.text, left(b.text, 40))),
n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
wl AS (SELECT query_id, id, rank FROM lr WHERE rank <= 50),
cl AS (SELECT n.query_id, n.n, k.k AS cell, count(*) FILTER (wl.rank <= k.k) AS hits, count(wl.rank) AS pool, (SELECT coalesce(sum(length(r.text)), 0) FROM wl x JOIN r USING (id) WHERE x.query_id = n.query_id AND x.rank <= k.k)::BIGINT AS ms
  FROM n CROSS JOIN (VALUES {', '.join(f'({k})' for k in _WIDTHS)}) AS k(k) JOIN gold USING (query_id) LEFT JOIN wl ON wl.query_id = n.query_id AND wl.id = gold.id GROUP BY n.query_id, n.n, k.k),
pl AS (SELECT cell, count(*) AS n, avg(hits / cl.n) AS recall, avg((hits > 0)::INT) AS any_hit, avg((hits = cl.n)::INT) AS whole, avg(pool / cl.n) AS pool, 0.0 AS select_degraded, {_ms(0.5, 'p50_ms')}, {_ms(0.9, 'p90_ms')} FROM cl GROUP BY cell)
"""


def _runs(spark, sf):
    """Each item's BM25 list at three widths; what a width costs is the characters it reads."""
    live, gold = _live(spark, sf), _gold(spark, sf)
    lists = _lists(spark, sf).filter("channel = 'lexical'").drop("channel")
    cells = F.explode(F.array(*map(F.lit, _WIDTHS))).alias("cell")
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select("*", cells)
    met = gold.withColumn("gold", F.lit(1)).join(lists, ["query_id", "id"]).select("query_id", "rank", cells)
    hits = met.groupBy("query_id", "cell").agg(F.count_if(F.col("rank") <= F.col("cell")).alias("hits"), F.count(F.lit(1)).alias("pool"))
    read = lists.join(live.select("id", F.char_length("text").alias("chars")), "id").select("query_id", "rank", "chars", cells).filter(F.col("rank") <= F.col("cell")).groupBy("query_id", "cell").agg(F.sum("chars").alias("ms"))
    rows = size.join(hits, ["query_id", "cell"], "left").join(read, ["query_id", "cell"], "left").fillna(0, ["hits", "pool", "ms"])
    share = lambda c: F.col(c) / F.col("n")
    return rows.select("cell", share("hits").alias("recall"), share("pool").alias("pool_recall"), (F.col("hits") == F.col("n")).alias("whole"), F.lit(False).alias("degraded"), "ms")


@register("E12_width_points", _RUNS_SQL + 'SELECT cell, n, round(recall, 6) AS recall, round(any_hit, 6) AS "any", round(whole, 6) AS "all", round(pool, 6) AS pool_recall, round(select_degraded, 6) AS select_degraded, p50_ms, p90_ms, round(pool - recall, 6) AS truncation_loss, round(1 - pool, 6) AS retrieval_loss FROM pl')
def width_points(spark, sf):
    points = arms.width_points(_runs(spark, sf), ["cell"])
    return points.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in points.dtypes])


@register("E12_width_verdict", _RUNS_SQL + ", b AS (SELECT recall AS r0, p50_ms AS m0 FROM pl WHERE cell = 2) SELECT cell, CASE WHEN select_degraded > 0.02 THEN 'degraded' WHEN cell = 2 THEN 'base' WHEN round(recall - r0, 9) >= 0.02 AND p50_ms < m0 * 2.0 THEN 'better' ELSE 'keep' END AS verdict FROM pl, b")
def width_verdict(spark, sf):
    return arms.width_verdict(arms.width_points(_runs(spark, sf), ["cell"]), F.col("cell") == 2).select("cell", "verdict")


@register("E13_step_points", _INVESTIGATED + f""",
gold AS (SELECT item_id AS query_id, id FROM benchmark b JOIN r ON length(b.text) > 0 AND contains(r.text, left(b.text, 40))),
h AS (SELECT query_id, count(*) AS n, count(p.id) AS hits FROM gold LEFT JOIN pool{STEPS} p USING (query_id, id) GROUP BY query_id),
t AS (SELECT s.query_id % 2 AS max_steps, coalesce(hits / h.n, 0) AS recall, steps, s.n AS pool, barren, conflicts, length(array_to_string(asked, '')) AS ms FROM s{STEPS} s LEFT JOIN h USING (query_id))
SELECT max_steps, round(avg(recall), 6) AS recall, round(avg((recall > 0)::INT), 6) AS "any", round(avg(steps), 6) AS mean_steps, round(avg(pool), 6) AS mean_pool, round(sum(barren) / sum(steps), 6) AS barren_fraction, round(avg((conflicts > 0)::INT), 6) AS conflict_fraction, {_ms(0.5, 'p50_ms')}, {_ms(0.9, 'p90_ms')} FROM t GROUP BY 1""".replace("count(p.id) AS hits", "count(p.score) AS hits"))
def step_points(spark, sf):
    """Investigations of even and of odd items; what one costs is the characters that it searched for, unknown without a search."""
    live = _live(spark, sf)
    found, gold = _found(spark, sf, live), _gold(spark, sf, live)
    hits = gold.join(found.pool.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    rows = found.trace.join(hits, "query_id", "left").select(
        (F.col("query_id") % 2).alias("max_steps"), F.coalesce("recall", F.lit(0.0)).alias("recall"), "steps", "pool",
        F.col("barren_steps").alias("barren"), F.col("conflicts_seen").alias("conflicts"), F.when(F.exists("asked", lambda q: q.isNotNull()), F.char_length(F.array_join("asked", "")).cast("long")).alias("ms"),
    )
    points = arms.step_points(cut_lineage(rows), ["max_steps"])
    return points.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in points.dtypes])


@register("E17_rescored", f"""WITH {_PAIRS_SQL}, a AS (SELECT conv_id * 100 + turn AS question_id, CASE WHEN turn % 3 = 0 THEN reply ELSE text END AS answer FROM pr),
v AS (SELECT conv_id * 100 + turn AS question_id, text AS answer, bool_and(contains(text, ',')) AS correct FROM pr WHERE role = 'user' GROUP BY ALL)
SELECT question_id, answer, correct::INT::DOUBLE AS judged, correct IS NULL AS pending FROM a LEFT JOIN v USING (question_id, answer)""")
def rescored(spark, sf):
    """Answers of which some were changed since users' turns were judged; a verdict is for the very words."""
    pairs = _pairs(spark, sf).withColumn("question_id", F.col("conv_id") * 100 + F.col("turn"))
    rows = pairs.select("question_id", F.when(F.col("turn") % 3 == 0, F.col("reply")).otherwise(F.col("text")).alias("answer"))
    judged = pairs.filter("role = 'user'").select("question_id", F.col("text").alias("answer"), F.contains("text", F.lit(",")).alias("correct"))
    return arms.rescored(rows, judged.unionByName(judged))  # judged twice, told once


@register("E28_second_pass", f"""WITH {_PAIRS_SQL}, b AS (SELECT conv_id * 100 + turn AS question_id, reply, {_NORM.format('reply')} AS w, text FROM pr WHERE turn % 5 <> 4),
a AS (SELECT conv_id * 100 + turn AS question_id, CASE WHEN length(gold) % 2 = 0 THEN reply ELSE text END AS reply2 FROM pr WHERE turn % 7 <> 5),
d AS (SELECT coalesce(b.question_id, a.question_id) AS question_id, b.question_id AS bq, a.question_id AS aq, reply IS NOT DISTINCT FROM reply2 AS same, {_DECLINES.format('w')} AS bd, {_NORM.format("coalesce(reply2, '')")} AS w2 FROM b FULL JOIN a ON a.question_id = b.question_id)
SELECT question_id, CASE WHEN aq IS NULL THEN 'missing' WHEN bq IS NULL THEN 'added' WHEN NOT bd THEN CASE WHEN same THEN 'untouched' ELSE 'changed' END WHEN {_DECLINES.format('w2')} THEN CASE WHEN same THEN 'declined' ELSE 'changed' END ELSE 'committed' END AS state FROM d""")
def second_pass(spark, sf):
    """A second pass that drops the opening of its reply for every other item; some rows are in one run only."""
    pairs = _pairs(spark, sf).withColumn("question_id", F.col("conv_id") * 100 + F.col("turn"))
    run = lambda rows, c: rows.select("question_id", c.alias("response")).withColumn("declined", text.is_abstention(F.col("response")))
    again = F.when(F.char_length("gold") % 2 == 0, F.col("reply")).otherwise(F.col("text"))
    return arms.second_pass(run(pairs.filter("turn % 5 <> 4"), F.col("reply")), run(pairs.filter("turn % 7 <> 5"), again))


@register("A17_majority", """
WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, left(lower(text), 1) AS c FROM conversations),
z AS (SELECT conv_id, min(i) AS first, count(*) AS size FROM s GROUP BY conv_id, c)
SELECT conv_id, size::INT AS size, first::INT AS first FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, first) = 1""")
def majority(spark, sf):
    """Turns of a conversation as samples; those that begin with the same letter are one answer."""
    letter = F.left(F.lower("text"), F.lit(1))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf, "conversations").select("conv_id", "turn", letter.alias("c"), nth.alias("i"))
    before = F.max("i").over(Window.partitionBy("conv_id", "c").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    linked = rows.withColumn("same", F.coalesce(before, F.col("i")))
    samples = linked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "same"))).alias("r"))
    return samples.select("conv_id", arms.majority(F.col("r.same")).alias("m")).select("conv_id", "m.size", "m.first")
