"""Derivation lineage: closures, erasure and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """``id, depth``: all that the edges ``parent, child`` reach from ``seeds(id)``, the seeds included.

    Breadth-first: each round joins the frontier with the edges and keeps what was not seen, so cycles end.
    Every round is checkpointed; a plan never grows with the depth.
    """
    seen = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier.id == edges.parent).select(F.col("child").alias("id")).distinct()
        frontier = cut_lineage(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"lineage is deeper than {max_depth}")


def descendants(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return closure(seeds, edges.select("parent", "child"))


def ancestors(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return closure(seeds, edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))


def hard_delete(seeds: DataFrame, edges: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The ids that go (the closure), and each table without the rows that name one in a column listed."""
    gone = descendants(seeds, edges).select("id")
    left = {}
    for name, (table, columns) in tables.items():
        for column in columns:
            table = table.join(gone.withColumnRenamed("id", column), column, "left_anti").select(*table.columns)
        left[name] = table
    return gone, left


def forget_scope(records: DataFrame, edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Ids that go when a scope is forgotten but for ``keep(id)``: what derives from a deleted record falls too."""
    return descendants(records.select("id").join(keep, "id", "left_anti"), edges).select("id")


def dangling_links(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links with an end that is no record."""
    ids = records.select("id")
    no_src = links.join(ids, links.src == ids.id, "left_anti")
    no_dst = links.join(ids, links.dst == ids.id, "left_anti")
    return no_src.unionByName(no_dst).distinct()


def orphan_incidence(incidence: DataFrame, records: DataFrame) -> DataFrame:
    return incidence.join(records.select(F.col("id").alias("record_id")), "record_id", "left_anti")


def neighbors(links: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """One hop from ``nodes(id)``, both directions: two equi-joins rather than one disjunction."""
    used = links if relation is None else links.filter(F.col("relation") == relation)
    out = used.join(nodes, used.src == nodes.id).select("id", F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    into = used.join(nodes, used.dst == nodes.id).select("id", F.col("src").alias("other"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(into)


def drift(ledger: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """``id, state``: index rows without a record, live records not indexed, stale rows, and rows that differ.

    ``ledger(id, live, ...)`` and ``index(id, ...)`` share ``columns``; rows that agree are left out.
    """
    left = ledger.select("id", "live", *[F.col(c).alias(f"l_{c}") for c in columns])
    right = index.select(F.col("id").alias("i_id"), *[F.col(c).alias(f"i_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"i_{c}"))
    state = (
        F.when(F.col("id").isNull(), "orphan")
        .when(F.col("i_id").isNull() & F.col("live"), "missing")
        .when(F.col("i_id").isNotNull() & ~F.col("live"), "stale")
        .when(F.col("i_id").isNotNull() & ~same, "drifted")
    )
    found = left.join(right, left.id == right.i_id, "full_outer").select(F.coalesce("id", "i_id").alias("id"), state.alias("state"))
    return found.filter(F.col("state").isNotNull())


def incidence_of(incidence: DataFrame, records: DataFrame, tenant: str) -> DataFrame:
    """``phrase, record_id, weight`` of one tenant's records."""
    mine = records.filter(F.col("tenant") == tenant).select(F.col("id").alias("record_id"))
    return incidence.join(mine, "record_id", "left_semi").select("phrase", "record_id", "weight")
