"""Lineage, links and reconciliation, over orders as records that derive from customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import lineage
from palimpsest.operators.channels import graph
from palimpsest.plans.common import register, table

#: region -> nation -> customer -> order, ids made distinct by a letter.
EDGES_SQL = """
SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


def _edges(spark, sf):
    link = lambda t, a, p, b, c: table(spark, sf, t).select(F.concat(F.lit(a), F.col(p).cast("string")).alias("parent"), F.concat(F.lit(b), F.col(c).cast("string")).alias("child"))
    return link("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(link("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(link("orders", "c", "o_custkey", "o", "o_orderkey"))


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


_CLOSURE = f"WITH RECURSIVE e AS ({EDGES_SQL}), c AS (SELECT 'n3' AS id, 0 AS depth UNION SELECT child, depth + 1 FROM c JOIN e ON e.parent = c.id)"


@register("D7_descendants", _CLOSURE + "SELECT id, depth FROM c")
def descendants(spark, sf):
    return lineage.descendants(_seed(spark, "n3"), _edges(spark, sf))


@register("D8_ancestors", f"WITH RECURSIVE e AS ({EDGES_SQL}), c AS (SELECT 'o1' AS id, 0 AS depth UNION SELECT parent, depth + 1 FROM c JOIN e ON e.child = c.id) SELECT id, depth FROM c")
def ancestors(spark, sf):
    return lineage.ancestors(_seed(spark, "o1"), _edges(spark, sf))


@register("D9_hard_delete", _CLOSURE + "SELECT parent, child FROM e WHERE parent NOT IN (SELECT id FROM c) AND child NOT IN (SELECT id FROM c)")
def hard_delete(spark, sf):
    edges = _edges(spark, sf)
    return lineage.hard_delete(_seed(spark, "n3"), edges, {"links": (edges, ["parent", "child"])})[1]["links"]


@register("D10_forget_scope", f"WITH RECURSIVE e AS ({EDGES_SQL}), s AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 5 AND c_custkey % 2 = 1), c AS (SELECT id FROM s UNION SELECT child FROM c JOIN e ON e.parent = c.id) SELECT id FROM c")
def forget_scope(spark, sf):
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")
    scope = table(spark, sf, "customer").filter("c_nationkey = 5")
    return lineage.forget_scope(scope.select(name), _edges(spark, sf), scope.filter("c_custkey % 2 = 0").select(name))


_LINKS = "l AS (SELECT o_orderkey AS src, o_custkey * 3 AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'supersedes' ELSE 'derived_from' END AS relation FROM orders), r AS (SELECT c_custkey AS id FROM customer)"


def _links(spark, sf):
    links = table(spark, sf, "orders").selectExpr("o_orderkey AS src", "o_custkey * 3 AS dst", "CASE WHEN o_orderkey % 2 = 0 THEN 'supersedes' ELSE 'derived_from' END AS relation")
    return links, table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))


@register("J2_links_of_records", f"WITH {_LINKS} SELECT src, dst, relation FROM l JOIN r ON l.src = r.id")
def links_of_records(spark, sf):
    links, ids = _links(spark, sf)
    return links.join(ids, links.src == ids.id).select("src", "dst", "relation")


@register("J3_dangling_links", f"WITH {_LINKS} SELECT DISTINCT src, dst, relation FROM l WHERE src NOT IN (SELECT id FROM r) OR dst NOT IN (SELECT id FROM r)")
def dangling_links(spark, sf):
    return lineage.dangling_links(*_links(spark, sf))


@register("J4_orphan_incidence", "SELECT l_orderkey AS record_id, l_partkey AS phrase FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def orphan_incidence(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("phrase"))
    return lineage.orphan_incidence(items, table(spark, sf, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"))).select("record_id", "phrase")


@register("J8_drift", """
WITH led AS (SELECT o_orderkey AS id, o_orderkey % 10 <> 0 AS live, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
idx AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 0)
SELECT * FROM (SELECT coalesce(led.id, idx.id) AS id, CASE WHEN led.id IS NULL THEN 'orphan' WHEN idx.id IS NULL AND live THEN 'missing' WHEN idx.id IS NOT NULL AND NOT live THEN 'stale'
  WHEN idx.id IS NOT NULL AND led.price IS DISTINCT FROM idx.price THEN 'drifted' END AS state FROM led FULL JOIN idx ON led.id = idx.id) WHERE state IS NOT NULL""")
def drift(spark, sf):
    orders = table(spark, sf, "orders")
    led = orders.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderkey % 10 <> 0 AS live", "o_totalprice AS price")
    idx = orders.filter("o_orderkey % 4 <> 0").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS price")
    return lineage.drift(led, idx, ["price"])


@register("J9_neighbors", f"WITH {_LINKS}, n AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 1) SELECT id, dst AS other, relation, 'out' AS direction FROM l JOIN n ON src = id UNION ALL SELECT id, src, relation, 'in' FROM l JOIN n ON dst = id")
def neighbors(spark, sf):
    links, _ = _links(spark, sf)
    return lineage.neighbors(links, table(spark, sf, "customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("id")))


@register("A13_graph_degree", "SELECT l_suppkey AS phrase, count(DISTINCT l_orderkey) AS degree, round(1.0 / count(DISTINCT l_orderkey), 9) AS specificity FROM lineitem GROUP BY l_suppkey")
def graph_degree(spark, sf):
    degree = F.countDistinct("l_orderkey")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("phrase")).agg(degree.alias("degree"), F.round(1 / degree, 9).alias("specificity"))


@register("R4_pagerank")
def pagerank(spark, sf):
    """Customers as phrases of the suppliers' nations; held against a dense matrix in the tests."""
    inc = table(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("phrase"), F.col("s_suppkey").alias("record_id"), F.lit(1.0).alias("weight"))
    more = table(spark, sf, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 7).cast("string")).alias("phrase"), F.col("s_suppkey").alias("record_id"), F.lit(2.0).alias("weight"))
    seeds = spark.createDataFrame([(0, "n3"), (0, "d2"), (1, "n7"), (2, "unknown")], "query_id int, phrase string")
    return graph(seeds, inc.unionByName(more), limit=20)
