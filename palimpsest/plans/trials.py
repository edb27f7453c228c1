"""Arms, planted attacks and resampled differences over retrieval of the benchmark's own passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation.ablation import ARMS, ablation, arm_quality
from palimpsest.evaluation.attacks import attack_success, planted_scores
from palimpsest.evaluation.metrics import retrieval_quality
from palimpsest.evaluation.resampling import paired_bootstrap
from palimpsest.functions.text import approx_tokens
from palimpsest.functions.trust import assess_trust
from palimpsest.operators import channels, compose, inverted
from palimpsest.operators.containment import contained
from palimpsest.plans.common import RECORDS_SQL, records, register, table
from palimpsest.plans.ranking import _BM25_CTE, _LIVE, _live, _questions, _vector_queries, _vectors

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTS = ", ".join(f"cast(length(text) - length(replace(text, '{c}', '')) as double)" for c in _LETTERS)


def _lists(spark, sf):
    """Two channels of each benchmark item: BM25, and cosine of the counts of letters; the first 50 of either."""
    live, questions = _live(spark, sf), _questions(spark, sf)
    vector = lambda rows, key: rows.selectExpr(key, f"array({_COUNTS}) AS vector")
    lexical = channels.lexical(questions, live, 50).select(F.lit("lexical").alias("channel"), "query_id", "id", "rank")
    dense = channels.dense(vector(questions, "query_id"), vector(live, "id"), 50).select(F.lit("dense").alias("channel"), "query_id", "id", "rank")
    return lexical.unionByName(dense)


def _gold(spark, sf, live=None):
    """Records that hold the head of an item word for word; ``live`` are the admissible ones, if they are at hand."""
    needles = _questions(spark, sf).select(F.col("query_id").alias("needle"), F.left("text", F.lit(40)).alias("text"))
    return contained(needles, _live(spark, sf) if live is None else live, fold=lambda t: t).select(F.col("needle").alias("query_id"), "id")


def _ranked(spark, sf):
    live, questions = _live(spark, sf), _questions(spark, sf)
    lists = _lists(spark, sf)
    apart = F.abs(F.char_length("text") - F.char_length("question"))
    heads = lists.select("query_id", "id").distinct().join(live, "id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    return ablation(lists, ARMS, rescored=heads.select("query_id", "id", F.round(1 / (1 + apart), 9).alias("rescore")))


_FUSED_SQL = f""",
dv AS (SELECT id, [{_COUNTS}] AS v FROM r), qv AS (SELECT item_id AS query_id, [{_COUNTS}] AS v FROM benchmark),
den AS (SELECT query_id, id, CASE WHEN isnan(c) THEN 0 ELSE round(c, 9) END AS score FROM (SELECT query_id, id, list_cosine_similarity(qv.v, dv.v) AS c FROM dv, qv)),
dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM den),
l AS (SELECT 'dense' AS channel, query_id, id, rank FROM dr WHERE rank <= 50 UNION ALL SELECT 'lexical', query_id, id, rank FROM lr WHERE rank <= 50)"""
_ARMS_SQL = _LIVE + _BM25_CTE + _FUSED_SQL + """,
a AS (SELECT * FROM (VALUES ('dense_only', 'dense', 60.0, false), ('bm25_only', 'lexical', 60.0, false), ('hybrid_k60', 'dense', 60.0, false), ('hybrid_k60', 'lexical', 60.0, false), ('hybrid_k1', 'dense', 1.0, false), ('hybrid_k1', 'lexical', 1.0, false),
  ('hybrid_rerank', 'dense', 60.0, true), ('hybrid_rerank', 'lexical', 60.0, true), ('graph_k1', 'dense', 1.0, false), ('graph_k1', 'lexical', 1.0, false), ('graph_rerank', 'dense', 60.0, true), ('graph_rerank', 'lexical', 60.0, true)) AS t(arm, channel, k, again)),
u AS (SELECT arm, again, query_id, id, round(sum(1.0::DOUBLE / (k::DOUBLE + rank)), 9) AS score FROM l JOIN a USING (channel) GROUP BY ALL),
h AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, id) <= 50),
t AS (SELECT arm, query_id, h.id, row_number() OVER (PARTITION BY arm, query_id ORDER BY CASE WHEN again THEN round(1.0::DOUBLE / (1 + abs(length(r.text) - length(b.text))), 9) ELSE score END DESC, h.id) AS rank FROM h JOIN r USING (id) JOIN benchmark b ON b.item_id = query_id),
gold AS (SELECT item_id AS query_id, id FROM benchmark b JOIN r ON length(b.text) > 0 AND contains(r.text, left(b.text, 40))),
n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
k AS (SELECT arm, query_id, count(*) AS hits, min(rank) AS first FROM t JOIN gold USING (query_id, id) WHERE rank <= 6 GROUP BY ALL),
qa AS (SELECT m.arm, n.query_id, coalesce(hits, 0) / n AS recall, (coalesce(hits, 0) > 0)::INT AS any_hit, coalesce(1.0 / first, 0) AS mrr FROM n CROSS JOIN (SELECT DISTINCT arm FROM a) m LEFT JOIN k ON k.arm = m.arm AND k.query_id = n.query_id)
"""


@register("E11_ablation", _ARMS_SQL + "SELECT arm, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(any_hit), 6) AS any_hit, round(avg(mrr), 6) AS mrr FROM qa GROUP BY arm")
def arms(spark, sf):
    told = arm_quality(_ranked(spark, sf), _gold(spark, sf))
    return told.select("arm", "questions", *[F.round(c, 6).alias(c) for c in ("recall", "any_hit", "mrr")])


@register("R6_hybrid_rrf", _LIVE + _BM25_CTE + _FUSED_SQL + """
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (1 + rank)), 9) AS score FROM l GROUP BY ALL)) WHERE rank <= 20""")
def hybrid(spark, sf):
    """BM25 and cosine of each benchmark item, fused."""
    return channels.rrf(_lists(spark, sf).drop("channel"), 1.0, 20)


@register("R12_composed", "WITH RECURSIVE " + (_LIVE + _BM25_CTE + _FUSED_SQL)[len("WITH "):] + f""",
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (1 + rank)), 9) AS score FROM l GROUP BY ALL) QUALIFY rank <= 50),
m AS (SELECT query_id, x.id, rank, z.text, z.kind, z.trust_tier, z.t_valid, greatest(length(z.text) // 4, len(list_filter(regexp_split_to_array(z.text, '\\s+'), lambda w: w <> ''))) AS tokens FROM x JOIN ({RECORDS_SQL}) z USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, z.text ORDER BY rank) = 1),
c AS (SELECT *, sum((trust_tier = 'untrusted')::INT) OVER (PARTITION BY query_id ORDER BY rank) AS nu FROM m), e AS (SELECT * FROM c WHERE trust_tier <> 'untrusted' OR nu <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT (kind = 'profile' AND nk <= 1), rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS nk FROM e)),
f AS (SELECT query_id, 0::BIGINT AS pos, 0::BIGINT AS used, 0 AS kept, NULL::BIGINT AS id, 0 AS lost, false AS bound FROM (SELECT DISTINCT query_id FROM k)
  UNION ALL SELECT k.query_id, k.pos, CASE WHEN f.kept < 6 AND (f.kept = 0 OR f.used + k.tokens <= 1024) THEN f.used + k.tokens ELSE f.used END, CASE WHEN f.kept < 6 AND (f.kept = 0 OR f.used + k.tokens <= 1024) THEN f.kept + 1 ELSE f.kept END,
    CASE WHEN f.kept < 6 AND (f.kept = 0 OR f.used + k.tokens <= 1024) THEN k.id END, f.lost + (f.kept < 6 AND f.kept > 0 AND f.used + k.tokens > 1024)::INT, f.bound OR f.kept >= 6 FROM f JOIN k ON k.query_id = f.query_id AND k.pos = f.pos + 1),
g AS (SELECT f.query_id, f.id, f.kept AS position, k.tokens, k.trust_tier FROM f JOIN k ON k.query_id = f.query_id AND k.pos = f.pos WHERE f.id IS NOT NULL),
o AS (SELECT query_id, max(used) AS total_tokens, max(lost) AS lost, bool_or(bound) AS bound FROM f GROUP BY query_id)
SELECT g.query_id, g.id, (CASE WHEN position % 2 = 1 THEN (position + 1) / 2 ELSE count(*) OVER w + 1 - position / 2 END)::INT AS slot, tokens, total_tokens, lost AS dropped_for_tokens, bound AS k_bound,
  CASE WHEN bool_or(trust_tier = 'untrusted') OVER w THEN 'untrusted' WHEN bool_or(trust_tier = 'asserted') OVER w THEN 'asserted' ELSE 'verified' END AS trust FROM g JOIN o USING (query_id) WINDOW w AS (PARTITION BY g.query_id)""")
def whole_set(spark, sf):
    """The main read as a whole: two channels fused, equal texts once, ceiling, quota, budget, order and trust."""
    head = channels.rrf(_lists(spark, sf).drop("channel"), 1.0, 50)
    known = records(spark, sf, "id", "text", "kind", "trust_tier", "t_valid")
    rows = head.join(known, "id").withColumn("tokens", approx_tokens(F.col("text")))
    return compose.composed(rows, 6, 1024, untrusted=2, quota=("profile", 1))


@register("E1_bootstrap")
def bootstrap(spark, sf):
    """The fused arm against the dense one by reciprocal rank of each item: drawn, so held to the closed form in the tests."""
    ranked, gold = _ranked(spark, sf), _gold(spark, sf)
    of = lambda arm: retrieval_quality(ranked.filter(F.col("arm") == arm), gold).select("query_id", F.col("mrr").alias(arm))
    return paired_bootstrap(of("hybrid_k1").join(of("dense_only"), "query_id"), "hybrid_k1", "dense_only")


def _planted(spark, sf):
    """First turns of conversations as attacks on the item that their number gives, which they quote."""
    n = table(spark, sf, "benchmark").count()
    turns = table(spark, sf, "conversations").filter("turn = 0").withColumn("query_id", F.col("conv_id") % n)
    items = _questions(spark, sf).select("query_id", F.left("text", F.lit(60)).alias("quoted"))
    return turns.join(items, "query_id").select(F.col("conv_id").alias("attack_id"), "query_id", F.concat("quoted", F.lit(" "), "text").alias("text"), F.left("text", F.lit(24)).alias("marker"))


@register("E18_attack_success", _LIVE + _BM25_CTE + """,
c AS (SELECT conv_id AS attack_id, item_id AS query_id, left(b.text, 60) || ' ' || c.text AS text, left(c.text, 24) AS marker FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark) WHERE turn = 0),
aw AS (SELECT attack_id, query_id, ws, len(ws) AS length FROM (SELECT *, """ + "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '')" + """ AS ws FROM c)),
ap AS (SELECT attack_id, query_id, length, term, count(*) AS tf FROM (SELECT attack_id, query_id, length, unnest(ws) AS term FROM aw) GROUP BY ALL),
sc AS (SELECT attack_id, query_id, round(sum(q * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) * ln((n - df + 0.5) / (df + 0.5) + 1)), 9) AS score FROM ap JOIN d USING (term) JOIN q USING (query_id, term), s GROUP BY ALL),
atk AS (SELECT c.*, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY c.query_id ORDER BY c.attack_id) AS form, contains(lower(c.text), 'from now on') OR contains(lower(c.text), 'as an ai') OR contains(lower(c.text), 'system prompt') OR contains(lower(c.text), 'you must always') OR contains(lower(c.text), 'you should always') OR contains(lower(c.text), 'your new instructions') OR contains(c.text, 'sk-') AS caught FROM c LEFT JOIN sc USING (attack_id, query_id)),
hd AS (SELECT lr.query_id, lr.id, lr.score, lr.rank, r.text FROM lr JOIN r USING (id) WHERE rank <= 10),
pl AS (SELECT atk.*, (SELECT count(*) FROM hd WHERE hd.query_id = atk.query_id AND hd.score >= atk.score) + 1 AS place FROM atk),
kk AS (SELECT pl.*, t.k, NOT caught AND pl.score > 0 AND place <= t.k AS seen FROM pl, (VALUES (1), (3), (6)) AS t(k)),
ev AS (SELECT kk.attack_id, kk.k, arg_max(x.text, (length(x.text), -x.rank)) AS answer FROM kk JOIN (SELECT attack_id, text, place AS rank FROM pl UNION ALL SELECT pl.attack_id, hd.text, hd.rank + (hd.rank >= pl.place)::INT FROM pl JOIN hd USING (query_id)) x ON x.attack_id = kk.attack_id AND x.rank <= kk.k WHERE seen GROUP BY ALL),
oc AS (SELECT form, kk.k, count(*) AS attempted, count(*) FILTER (caught) AS quarantined, count(*) FILTER (seen) AS injected, count(*) FILTER (seen AND contains(lower(answer), lower(marker))) AS succeeded FROM kk LEFT JOIN ev ON ev.attack_id = kk.attack_id AND ev.k = kk.k GROUP BY form, kk.k),
pp AS (SELECT *, succeeded / attempted AS p, 1 + 1.96 * 1.96 / attempted AS s, 1.96 * sqrt((succeeded / attempted * (1 - succeeded / attempted) + 1.96 * 1.96 / (4 * attempted)) / attempted) AS h FROM oc)
SELECT form, k, attempted, quarantined, injected, succeeded, round(greatest(0, (p + 1.96 * 1.96 / (2 * attempted) - h) / s), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * attempted) + h) / s), 6) AS high FROM pp""")
def attacks(spark, sf):
    """What gets in at 1, 3 and 6, and what a reader who believes the longest memory repeats."""
    live, questions = _live(spark, sf), _questions(spark, sf)
    planted = _planted(spark, sf)
    scored = planted.join(planted_scores(questions, planted, live), ["attack_id", "query_id"])
    heads = channels.lexical(questions, live, 10).join(live, "id").select("query_id", "id", "score", "rank", "text")
    longest = lambda texts: F.get(F.filter(texts, lambda t: F.char_length(t) == F.array_max(F.transform(texts, F.char_length))), F.lit(0))
    caught = assess_trust(F.col("text"), F.lit("asserted"))["tier"] != "asserted"
    told = attack_success(heads, scored, caught, (1, 3, 6), longest)
    return told.select("form", "k", "attempted", "quarantined", "injected", "succeeded", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("R1_inverted")
def probed(spark, sf):
    """Ten nearest of the stated vectors by inverted lists, as many as a recall of 0.9 takes (measured by R1_dense's search on some)."""
    index, queries = inverted.build_lists(_vectors(spark, sf)), _vector_queries(spark, sf)
    return inverted.search(queries, index, 10, inverted.probes_for(queries, index, 10)).withColumn("score", F.round("score", 6))
