"""Containment of gold texts in evidence, by seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation.sweep import recall_sweep
from palimpsest.functions import text
from palimpsest.operators import channels
from palimpsest.operators.containment import contained
from palimpsest.plans.common import register, table
from palimpsest.plans.ranking import _BM25_CTE, _LIVE, _live, _questions


@register("C9_is_found", """
SELECT item_id, bool_or(length(b.text) > 30 AND contains(regexp_replace(d.text, '^\\[\\d{4}-\\d{2}-\\d{2}\\] ?', ''), left(b.text, 80))) AS found FROM benchmark b, documents d GROUP BY item_id""")
def is_found(spark, sf):
    """Whether the head of each long enough gold text stands in any document."""
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle"), "text")
    heads = gold.filter(F.char_length("text") > 30).withColumn("text", F.left("text", F.lit(80)))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.strip_stamp(F.col("text")).alias("text"))
    met = contained(heads, docs, fold=lambda t: t).select(F.col("needle").alias("item_id")).distinct().withColumn("met", F.lit(True))
    return gold.select(F.col("needle").alias("item_id")).join(met, "item_id", "left").select("item_id", F.coalesce("met", F.lit(False)).alias("found"))


@register("J10_contained", """
SELECT b.item_id, d.doc_id, u.unit FROM (SELECT item_id, unnest(range(3)) AS unit, text FROM benchmark) u JOIN benchmark b USING (item_id) JOIN documents d
  ON length(trim(substr(u.text, 1 + u.unit * 40, 40))) > 0 AND contains(d.text, trim(substr(u.text, 1 + u.unit * 40, 40)))""")
def units(spark, sf):
    """Gold units of each benchmark item, and every document that holds one word for word."""
    items = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("unit"))
    needles = items.select(F.struct("item_id", "unit").alias("needle"), F.trim(F.substring(F.col("text"), 1 + F.col("unit") * 40, F.lit(40))).alias("text"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return contained(needles, docs).select("needle.item_id", F.col("id").alias("doc_id"), F.col("needle.unit").cast("long").alias("unit"))


_SWEPT = """,
g AS (SELECT item_id AS query_id, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '[,;.]'))), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM benchmark),
e AS (SELECT query_id, rank, regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS text FROM lr JOIN r USING (id) WHERE rank <= 10),
k AS (SELECT query_id, k, string_agg(text, ' ' ORDER BY rank) AS seen FROM e, (VALUES (1), (3), (6), (10)) AS t(k) WHERE rank <= k GROUP BY query_id, k),
f AS (SELECT query_id, t.k, bool_and(coalesce(contains(regexp_replace(seen, ' +', ' ', 'g'), phrase), false)) AS hit FROM g JOIN (VALUES (1), (3), (6), (10)) AS t(k) ON true LEFT JOIN k USING (query_id, k) WHERE phrase <> '' GROUP BY query_id, t.k)
"""


@register("E26_recall_sweep", _LIVE + _BM25_CTE + _SWEPT.replace("LEFT JOIN k USING (query_id, k)", "LEFT JOIN k ON k.query_id = g.query_id AND k.k = t.k").replace("SELECT query_id, t.k, bool_and", "SELECT g.query_id, t.k, bool_and").replace("GROUP BY query_id, t.k", "GROUP BY g.query_id, t.k") + """
SELECT k, count(*) AS questions, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 6) AS recall FROM f GROUP BY k""")
def sweep(spark, sf):
    """Recall of all clauses of a benchmark item in its first k records by BM25."""
    live, questions = _live(spark, sf), _questions(spark, sf)
    golds = questions.select("query_id", F.explode(F.split("text", "[,;.]")).alias("phrase"))
    ranked = channels.lexical(questions, live, 10).join(live, "id").select("query_id", "rank", "text")
    return recall_sweep(golds, ranked, (1, 3, 6, 10))
