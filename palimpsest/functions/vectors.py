"""Vector functions over arrays of floats; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and zero norms."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def normalized(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def fit_dim(a: Column, dims: int) -> Column:
    """The first ``dims`` components, scaled to length 1."""
    return normalized(F.slice(a, 1, dims))


def vector_sum(column: str, dims: int) -> list[Column]:
    """One sum a component, for groupBy().agg(); combined before the shuffle."""
    return [F.sum(F.element_at(column, k + 1).cast("double")).alias(f"c{k}") for k in range(dims)]


def mean_pool(dims: int) -> Column:
    """Over the columns of vector_sum(): their direction."""
    return normalized(F.array(*[F.col(f"c{k}") for k in range(dims)]))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best dot product, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
