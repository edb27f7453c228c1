"""Minted pools, repaired indexes, and citations by stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import repairs
from palimpsest.operators.citations import premise_finding, uncited_terms
from palimpsest.operators.minting import mint
from palimpsest.plans.common import register, table


def _minted(spark, sf):
    """Conversations as trajectories: sentences of all their turns as events, of the first as notes; some cut off."""
    turns = table(spark, sf, "conversations")
    lines = turns.groupBy(F.concat(F.lit("c"), "conv_id").alias("trajectory")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))  # of one conversation
    whole = F.array_join(F.transform("t", lambda x: x["text"]), ".")
    said = F.when(F.char_length(whole) % 5 == 0, F.lit("cut off")).otherwise(F.to_json(F.split(whole, "\\.")))
    events = lines.select("trajectory", F.lit("event").alias("pool"), said.alias("reply"))
    notes = lines.select("trajectory", F.lit("note").alias("pool"), F.to_json(F.split(F.get("t", F.lit(0))["text"], ",")).alias("reply"))
    records = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("source"), (F.char_length("text") % 3 == 0).alias("live"))
    replies, none = events.unionByName(notes), spark.createDataFrame([], "trajectory string, pool string")
    first = mint(replies.filter("pool = 'event'"), records, none)
    second = mint(replies, records, first.completed)  # goes on where the first run ended
    return first, second


_MINTED = """
WITH l AS (SELECT 'c' || conv_id AS trajectory, string_agg(text, '.' ORDER BY turn) AS whole, arg_min(text, turn) AS head FROM conversations GROUP BY conv_id),
r AS (SELECT trajectory, 'event' AS pool, 6 AS most, CASE WHEN length(whole) % 5 = 0 THEN [] ELSE string_split(whole, '.') END AS ts FROM l UNION ALL SELECT trajectory, 'note', 2, string_split(head, ',') FROM l),
a AS (SELECT 'c' || conv_id AS trajectory, conv_id * 100 + turn AS dst FROM conversations WHERE length(text) % 3 = 0),
k AS (SELECT trajectory, pool, list_filter(list_transform(ts, lambda t: trim(t)), lambda t: t <> '')[:most] AS ts FROM r WHERE trajectory IN (SELECT trajectory FROM a)),
m AS (SELECT trajectory || '/' || pool || '/' || i AS id, trajectory, pool, CASE pool WHEN 'event' THEN 'semantic' ELSE 'procedural' END AS kind, ts[i] AS text FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM k))
"""


@register("S19_minted", _MINTED + "SELECT id, trajectory, pool, kind, text FROM m")
def minted(spark, sf):
    first, second = _minted(spark, sf)
    return first.records.unionByName(second.records)


@register("S19_lineage", _MINTED + "SELECT m.id AS src, a.dst FROM m JOIN a USING (trajectory)")
def minted_lineage(spark, sf):
    first, second = _minted(spark, sf)
    return first.lineage.unionByName(second.lineage)


def _stores(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ledger = orders.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus <> 'P' AS live", "o_totalprice AS price", "o_orderpriority AS kind")
    index = orders.filter("o_custkey % 4 <> 0").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price", "o_orderpriority AS kind")
    links = items.selectExpr("l_orderkey AS src", "l_partkey AS dst", "l_returnflag AS relation")
    incidence = items.selectExpr("l_suppkey AS phrase", "l_orderkey AS record_id", "l_quantity AS weight")
    return ledger, index, links, incidence, ["price", "kind"]


_LEDGER = "led AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS live, o_totalprice AS price, o_orderpriority AS kind FROM orders WHERE o_orderkey % 3 <> 0), idx AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS kind FROM orders WHERE o_custkey % 4 <> 0)"


@register("U13_report", f"""WITH {_LEDGER}, d AS (SELECT CASE WHEN led.id IS NULL THEN 'orphan' WHEN idx.id IS NULL AND live THEN 'missing' WHEN idx.id IS NOT NULL AND NOT live THEN 'stale' WHEN idx.id IS NOT NULL AND (led.price IS DISTINCT FROM idx.price OR led.kind IS DISTINCT FROM idx.kind) THEN 'drifted' END AS kind FROM led FULL JOIN idx ON led.id = idx.id),
k AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM led) OR l_partkey NOT IN (SELECT id FROM led))
SELECT kind, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'dangling_link', count(*) FROM k HAVING count(*) > 0 UNION ALL SELECT 'orphan_incidence', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM led) HAVING count(*) > 0""")
def drift_report(spark, sf):
    return repairs.report(*_stores(spark, sf))


@register("U13_repaired", f"""WITH {_LEDGER}, c AS (SELECT coalesce(led.id, idx.id) AS id, CASE WHEN led.id IS NULL OR NOT live THEN 'remove' WHEN idx.id IS NULL THEN 'add' WHEN led.price IS DISTINCT FROM idx.price OR led.kind IS DISTINCT FROM idx.kind THEN 'replace' END AS action FROM led FULL JOIN idx ON led.id = idx.id WHERE idx.id IS NOT NULL OR live)
SELECT led.id, price, kind, action FROM led LEFT JOIN c USING (id) WHERE live""")
def repaired(spark, sf):
    """The mended index, with what was done to each of its rows; mending it again must do nothing."""
    ledger, index, links, incidence, columns = _stores(spark, sf)
    once = repairs.repaired(ledger, index, links, incidence, columns)
    twice = repairs.repaired(ledger, once.index, once.links, once.incidence, columns)
    done = once.changes.unionByName(twice.changes.withColumn("action", F.lit("changed again")))
    return twice.index.join(done, "id", "left").select("id", "price", "kind", "action")


@register("C18_uncited_terms")
def uncited(spark, sf):
    """What the first turn of a conversation names and its later turns do not; stems are held to known pairs in the tests."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text")
    return uncited_terms(turns.filter("turn = 0"), turns.filter("turn > 0")).select("query_id", F.array_join("terms", " ").alias("terms"), premise_finding(F.col("terms")).alias("finding"))
