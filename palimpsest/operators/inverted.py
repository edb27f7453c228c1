"""Approximate dense retrieval: inverted lists over centroids, a few lists probed, and exact scores of what they hold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.channels import DIGITS, QUERY_BLOCK, dense, top_ranked
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.nearest import Heads, Vectors

#: Vectors that a centroid is trained on, and the most centroids: so the sample is bounded by their product.
SAMPLE_PER_LIST, MOST_LISTS = 64, 4096
#: About how many vectors of a list meet about QUERY_BLOCK queries in one group.
PART_ROWS = 1 << 14
#: The fewest lists that a query probes, the recall that probing is chosen for, and the queries by which it is measured.
PROBES, RECALL, MEASURED = 8, 0.92, 400


@dataclass(frozen=True)
class Lists:
    """``rows(list, id, vector)`` hold every vector once; ``centroids(list, centroid)`` are at most MOST_LISTS rows."""

    rows: DataFrame
    centroids: DataFrame


def build_lists(records: DataFrame, lists: int | None = None, seed: int = 1) -> Lists:
    """Lists of ``records(id, vector)``, by default the square root of their number.

    Centroids are trained on unit vectors of a sample by hash of the id, about SAMPLE_PER_LIST a list; then every vector
    goes to the nearest centroid and the lists are written down. Null vectors go to no list; equal vectors share one.
    """
    whole = records.filter("vector IS NOT NULL").select("id", "vector")
    n = whole.count()
    k = max(1, min(MOST_LISTS, lists or round(n**0.5), n))
    share = min(1.0, k * SAMPLE_PER_LIST / max(1, n))
    drawn = whole.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) <= share * (1 << 30))
    unit = lambda rows: Normalizer(inputCol="given", outputCol="unit").transform(rows.withColumn("given", array_to_vector("vector")))
    if n == 0:
        empty = records.sparkSession.createDataFrame([], "list int, centroid array<double>")
        return Lists(whole.select(F.lit(0).alias("list"), "id", "vector"), empty)
    model: KMeansModel = KMeans(k=k, seed=seed, maxIter=10, featuresCol="unit", predictionCol="list").fit(unit(drawn if not drawn.isEmpty() else whole))
    centroids = records.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list int, centroid array<double>")
    placed = model.transform(unit(whole)).select("list", "id", "vector")
    return Lists(cut_lineage(placed), centroids)


def search(queries: DataFrame, index: Lists, limit: int = 50, probes: int = PROBES) -> DataFrame:
    """Top ``limit`` of ``queries(query_id, vector)`` by exact cosine among the vectors of the ``probes`` nearest lists.

    As channels.dense(), but a query meets only its lists: those and the queries that probe them are brought together,
    and matrix products find what exact sums then score. A list of more than PART_ROWS vectors is dealt into parts by a
    hash of the id, its queries by QUERY_BLOCK likewise, so that no group holds more than about so many of either. A query of length zero
    scores zero everywhere; it meets some lists like any other.
    """
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(index.rows.dtypes)["id"], "score": "double"}
    probed = f"query_id {kinds['query_id']}, vector {dict(queries.dtypes)['vector']}, list int, nth int"
    near = cut_lineage(queries.select("query_id", "vector").mapInArrow(_nearest_lists(index, probes), probed).drop("nth"))
    parts = lambda rows, most, name: rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    dealt = F.broadcast(parts(index.rows, PART_ROWS, "slabs").join(parts(near, QUERY_BLOCK, "blocks"), "list"))  # a row a list
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = index.rows.join(dealt, "list").select("list", "id", "vector", own("id", "slabs").alias("slab"), every("blocks").alias("block"))
    asked = near.join(dealt, "list").select("list", "query_id", "vector", every("slabs").alias("slab"), own("query_id", "blocks").alias("block"))

    def meet(some, held):
        empty = pa.table({"query_id": some.column("query_id").slice(0, 0), "id": held.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not some.num_rows or not held.num_rows:
            return empty
        heads = Heads(some.column("query_id").combine_chunks(), some.column("vector").combine_chunks(), limit, DIGITS)
        heads.add(held.column("id").combine_chunks(), held.column("vector").combine_chunks())
        found = heads.rows()
        return empty if found is None else found

    group = ["list", "slab", "block"]
    met = asked.groupBy(group).cogroup(rows.groupBy(group)).applyInArrow(meet, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return top_ranked(met.withColumn("score", F.round("score", DIGITS)), limit)


def probes_for(queries: DataFrame, index: Lists, limit: int, recall: float = RECALL) -> int:
    """How many lists a query must probe for that share of its exact first ``limit``; no fewer than PROBES.

    Measured on MEASURED of the queries, drawn by hash, against all vectors: where vectors do not cluster, that is a large
    share of the lists.
    """
    drawn = cut_lineage(queries.filter("vector IS NOT NULL").select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED))
    held = dense(drawn, index.rows, limit).select("query_id", "id").join(index.rows.select("id", "list"), "id")
    kinds = dict(drawn.dtypes)
    order = drawn.mapInArrow(_nearest_lists(index, MOST_LISTS), f"query_id {kinds['query_id']}, vector {kinds['vector']}, list int, nth int")
    told = dict(held.join(order.drop("vector"), ["query_id", "list"]).groupBy("nth").count().collect())  # a row a list at most
    wanted, found = recall * sum(told.values()), 0
    for nth in sorted(told):
        found += told[nth]
        if found >= wanted:
            return max(PROBES, nth)
    return PROBES


def _nearest_lists(index: Lists, probes: int):
    """A function for mapInArrow over ``query_id, vector``: a row for each of the ``probes`` lists whose centroids are nearest to
    the direction of the vector, and which it is, from 1; the first lists where it has none or another length."""
    centroids = index.centroids.orderBy("list").toArrow()  # at most MOST_LISTS rows
    lists = centroids.column("list").to_numpy()

    def run(batches):
        given = Vectors(centroids.column("centroid").combine_chunks())
        for batch in batches:
            q = Vectors(batch.column("vector"))
            order = np.tile(np.arange(len(lists)), (batch.num_rows, 1))[:, :probes]
            for n in q.matrix.keys() & given.matrix.keys():
                whole = np.where((q.norm[q.rows[n]] > 0)[:, None], q.units(n), q.matrix[n])
                with np.errstate(all="ignore"):
                    gap = np.square(given.matrix[n]).sum(axis=1) - 2 * whole @ given.matrix[n].T
                order[q.rows[n]] = np.argsort(np.round(gap, 12), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(batch.num_rows), order.shape[1])
            yield pa.record_batch([batch.column(c).take(pa.array(at)) for c in ("query_id", "vector")] + [pa.array(lists[order.ravel()], pa.int32()), pa.array(np.tile(np.arange(1, order.shape[1] + 1), batch.num_rows), pa.int32())], ["query_id", "vector", "list", "nth"])

    return run
