"""Centroid clustering of vectors by ball-tree filtering, in exact integer arithmetic.

Every task packs its vectors into metric trees of bounded size, once; the trees are written to the shared folder and
each round filters the centroids through them. A ball keeps its centre, its radius, how many vectors it holds and
their integer sum. By the triangle inequality, a centroid that is farther from the centre than the nearest one by more
than twice the radius is nearest to no vector of the ball. Where one centroid is left, the whole ball goes to it by its
count and sum; else its halves are looked at, and in the leaves the distances themselves decide.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_rows, cut_lineage

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Vectors of one tree and of one leaf; trees that travel to Python at once.
TREE_VECTORS, LEAF_VECTORS, TREES_AT_ONCE = 2048, 32, 4
#: Below this, squares of differences and their sums stay in 64 bits; beyond it, Python integers are used.
NARROW = 1 << 27
_LIMB = 32


@dataclass
class Tree:
    """Points in the order of the leaves; node n holds points lo[n] to hi[n], and nodes child[n] and child[n] + 1."""

    ids: list
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as a double, exact; of Python integers where 64 bits are too narrow."""
    wide = values.astype(np.float64)
    if not wide.size or np.abs(wide).max() * scale < NARROW:
        return np.floor(wide * scale).astype(np.int64)
    exact = [scale * int(x) if abs(x) >= 1 << 53 else math.floor(scale * x) for x in wide.ravel().tolist()]
    return np.array(exact, object).reshape(wide.shape)


def build(ids: list, points: np.ndarray, leaf: int = LEAF_VECTORS) -> Tree:
    """Halve along the widest component until a ball is a leaf or a single place."""
    near = points.astype(np.float64)
    order = np.arange(len(points))
    lo, hi, child, centre, radius = [0], [len(points)], [-1], [], []
    at = 0
    with np.errstate(over="ignore", invalid="ignore"):
        while at < len(lo):
            own = near[order[lo[at] : hi[at]]]
            middle = own.mean(0)
            centre.append(middle)
            reach = np.sqrt(((own - middle) ** 2).sum(1).max())
            radius.append(reach * (1 + 1e-9))
            if len(own) > leaf and reach > 0:
                widest = int(np.argmax(own.max(0) - own.min(0)))
                half = len(own) // 2
                order[lo[at] : hi[at]] = order[lo[at] : hi[at]][np.argpartition(own[:, widest], half)]
                child[at] = len(lo)
                lo += [lo[at], lo[at] + half]
                hi += [lo[at] + half, hi[at]]
                child += [-1, -1]
            at += 1
    placed = points[order]
    sums = np.array([placed[a:b].sum(0) for a, b in zip(lo, hi, strict=True)], points.dtype)
    return Tree([ids[k] for k in order.tolist()], placed, np.array(lo), np.array(hi), np.array(child), np.array(centre), np.array(radius), sums)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points by centroids, exact."""
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(node, centroid) of the balls that go whole; the remaining points and the centroid of each."""
    if centroids.dtype != tree.points.dtype:
        centroids = centroids.astype(object)
    places = centroids.astype(np.float64)
    active, open_to = np.array([0]), np.ones((1, len(places)), bool)
    whole, points, labels = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(active):
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.sqrt(np.stack([((tree.centre[active] - c) ** 2).sum(1) for c in places], 1))
            nearest = np.where(open_to, far, np.inf).argmin(1)
            least, reach = far[np.arange(len(far)), nearest][:, None], tree.radius[active][:, None]
            beaten = np.isfinite(far) & (far - least > 2 * reach + 1e-9 * (far + least + reach))
        open_to &= ~beaten
        alone = open_to.sum(1) == 1
        whole += zip(active[alone].tolist(), open_to[alone].argmax(1).tolist(), strict=True)
        active, open_to = active[~alone], open_to[~alone]
        leaf = tree.child[active] < 0
        for node, able in zip(active[leaf].tolist(), open_to[leaf], strict=True):
            kept = np.nonzero(able)[0]
            own = np.arange(tree.lo[node], tree.hi[node])
            points.append(own)
            labels.append(kept[distances(tree.points[own], centroids[kept]).argmin(1).astype(np.int64)])
        below = tree.child[active[~leaf]]
        active, open_to = np.concatenate([below, below + 1]), np.concatenate([open_to[~leaf]] * 2)
    return whole, np.concatenate(points), np.concatenate(labels)


def _totals(tree: Tree, centroids: np.ndarray, counts: list[int], sums: list) -> None:
    whole, points, labels = filtered(tree, centroids)
    for node, c in whole:
        counts[c] += int(tree.hi[node] - tree.lo[node])
        sums[c] = sums[c] + tree.sums[node].astype(object)
    for c in np.unique(labels).tolist():
        own = points[labels == c]
        counts[c] += len(own)
        sums[c] = sums[c] + tree.points[own].sum(0).astype(object)


def _labels(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole, points, labels = filtered(tree, centroids)
    out = np.zeros(len(tree.points), np.int64)
    out[points] = labels
    for node, c in whole:
        out[tree.lo[node] : tree.hi[node]] = c
    own = (centroids if centroids.dtype == tree.points.dtype else centroids.astype(object))[out]
    return out, ((tree.points - own) ** 2).sum(1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(n, part) with value = sum of part * 2^(32 n): parts of one n may be added up over any number of tasks."""
    sign, rest, n = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        if part := rest & ((1 << _LIMB) - 1):
            yield n, sign * part
        rest >>= _LIMB
        n += 1


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for body in batch.column(0):
            yield Tree(*pickle.loads(body.as_py()))


def _usable(vector: Column, dimensions: int) -> Column:
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).collect()
    return whole_numbers(np.array([r.vector for r in rows], np.float64), scale)


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding", tree_vectors: int = TREE_VECTORS, leaf_vectors: int = LEAF_VECTORS,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable row of ``vectors``.

    Usable are vectors of exactly ``dimensions`` components, none null or non-finite; others give no row. A component
    x becomes floor(scale * x). The ``k`` usable rows with the least sha256 of ``seed:id`` are the first centroids;
    equal ids follow their vectors, null ids come last, and fewer rows than ``k`` give as many centroids. In each
    round every vector goes to the nearest centroid, of equals to the smaller number, and a centroid becomes the
    floor of the mean of its vectors; one without vectors stays. Repeated rows count each. All is exact whatever the
    size of the components; a distance or sum that passes 64 bits is null. An empty table gives an empty result.
    Columns other than the two named are ignored. The driver holds k centroids, nothing that grows with the rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(_usable(F.col("vector"), dimensions))
    centroids = _first_centroids(kept, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def plant(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, tree_vectors):
                part = batch.slice(at, tree_vectors)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions)
                tree = build(part.column("vec_id").to_pylist(), whole_numbers(values, scale), leaf_vectors)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(vars(tree).values()))], pa.binary())], ["tree"])

    with arrow_rows(spark, TREES_AT_ONCE * tree_vectors):
        trees = cut_lineage(kept.mapInArrow(plant, "tree binary"))

    with arrow_rows(spark, TREES_AT_ONCE):
        for _ in range(rounds):
            centroids = _moved(trees, centroids)
        labelled = cut_lineage(_assigned(trees, centroids))

    shown = {c: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for c, row in enumerate(centroids.tolist())}
    whole = F.count("distance") == F.count(F.lit(1))
    total = lambda: F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)")))
    per = labelled.groupBy("cluster").agg(total().alias("t")).collect()
    every = labelled.agg(total().alias("t")).first()["t"]
    fits = lambda t: t if t is not None and t < 1 << 63 else None
    facts = spark.createDataFrame(
        [(r.cluster, int(t) if (t := fits(r.t)) is not None else None, int(e) if (e := fits(every)) is not None else None, shown[r.cluster]) for r in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return labelled.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: counts and sums come from the trees in one row a centroid, component and limb."""
    k, width = centroids.shape

    def gather(batches):
        counts, sums = [0] * k, [0] * k
        for tree in _trees(batches):
            _totals(tree, centroids, counts, sums)
        rows = [(c, -1, n, part) for c in range(k) for n, part in _limbs(counts[c])]
        rows += [(c, d, n, part) for c in range(k) if counts[c] for d in range(width) for n, part in _limbs(int(sums[c][d]))]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["cluster", "dim", "limb", "part"])

    parts = trees.mapInArrow(gather, "cluster long, dim long, limb long, part long").groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part"))
    found: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        found[r.cluster, r.dim] = found.get((r.cluster, r.dim), 0) + (r.part << (_LIMB * r.limb))
    moved = [[found.get((c, d), 0) // n for d in range(width)] if (n := found.get((c, -1), 0)) else row for c, row in enumerate(centroids.tolist())]
    narrow = all(abs(x) < NARROW for row in moved for x in row)
    return np.array(moved, np.int64 if narrow else object)


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    def label(batches):
        for tree in _trees(batches):
            labels, far = _labels(tree, centroids)
            fit = [int(x) if x < 1 << 63 else None for x in far.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(labels.astype(np.int32)), pa.array(fit, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(label, "vec_id long, cluster int, distance long")
