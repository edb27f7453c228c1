"""Row numbers within groups of any size: a group is spread over tasks, never gathered in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage


def spread_rank(rows: DataFrame, key: str, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``rows`` with the row number of each within its ``key``, by ``order`` (ascending expressions), from 1.

    Rows are range-partitioned by key and order and sorted within partitions; what a row number needs from other
    partitions is how many rows of its key they hold, one number a key and partition. The order must be total. An
    empty table gives an empty result.
    """
    width = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorts = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = rows.withColumns(sorts)
    ranged = keyed.repartitionByRange(width, F.col(key), *map(F.col, sorts)).sortWithinPartitions(F.col(key), *map(F.col, sorts)).drop(*sorts)
    seat = F.monotonically_increasing_id()
    placed = cut_lineage(ranged.withColumn("_seat", seat)).withColumn("_part", F.shiftright("_seat", 33))
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seat").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), (before - F.col("_first") + 1).alias("_shift"))
    met = placed.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return met.withColumn(name, F.col("_seat") + F.col("_shift")).drop("_seat", "_part", "_key", "_at", "_shift")


def spread_scan(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], previous: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with running totals within ``key``, this row's included, and with values of the row before (null at first).

    As spread_rank(): what a row needs from other partitions is one row of totals and last values for each key and
    partition. ``order`` must be total within a key. An empty table gives an empty result.
    """
    previous = previous or {}
    width = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_v_{n}": c for n, c in (sums | previous).items()})
    ranged = valued.repartitionByRange(width, F.col(key), *map(F.col, order)).sortWithinPartitions(F.col(key), *map(F.col, order))
    placed = cut_lineage(ranged.withColumn("_seat", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_seat", 33))
    own = Window.partitionBy("_part", key).orderBy("_seat")  # a group is a part of one partition
    local = placed.withColumns({n: F.sum(f"_v_{n}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for n in sums} | {n: F.lag(f"_v_{n}").over(own) for n in previous} | {"_first": F.lag("_seat").over(own).isNull()})
    parts = placed.groupBy(key, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], *[F.max_by(F.struct(f"_v_{n}"), "_seat").alias(f"_t_{n}") for n in previous], F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part")  # a row for each partition that holds the key
    shifts = parts.select(
        F.col(key).alias("_key"), F.col("_part").alias("_at"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.lag(f"_t_{n}").over(before)[f"_v_{n}"].alias(f"_b_{n}") for n in previous],
    )
    met = local.join(shifts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    whole = met.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums} | {n: F.when(F.col("_first"), F.col(f"_b_{n}")).otherwise(F.col(n)) for n in previous})
    return whole.select(*rows.columns, *sums, *previous)
