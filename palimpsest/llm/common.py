"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy step works on at a time.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null becomes empty); other columns never clash or travel."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the decimal doc_id leaves 1 on division by 3."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only where none is set and all runs in one
    process, as in tests, make one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))


#: Edges of the component search that make a partition worth its files.
EDGES_OF_A_TASK = 50_000

#: Ids that a broadcast may hold; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A checkpoint; its rows are counted, and it is broadcast only if they are few."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Semi or anti join with distinct keys. They are counted first: only a set of bounded size is broadcast, so
    that the texts of ``df`` stay where they are; a larger one is shuffled with them."""
    return df.join(small(ids), key, how)


def with_row_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a long that tells every row from every other and sorts like ``id_col``.

    It is ``id_col`` itself where that has no null and no value twice. Otherwise rows are range-partitioned by id
    and numbered in that order, nulls first, and written down, so that the numbers stay what they are.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    odd = docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1))
    if odd.isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long")), name
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(shuffle_width(docs.sparkSession), F.col(id_col), F.xxhash64(F.col(text_col)), F.col(name))
    ordered = ranged.sortWithinPartitions(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(name))
    return cut_lineage(ordered.withColumn(name, F.monotonically_increasing_id())), name


def arrow_column(fn: Callable, kind: str) -> Callable[..., Column]:
    """A column function from one over iterators of Arrow arrays: set up once a task; other columns stay in the JVM."""
    return F.arrow_udf(fn, kind)


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows travel to Python at once in the jobs that run inside; the setting is put back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_arrow_rows(spark: SparkSession, rows: int) -> None:
    """From now on at most so many rows travel to Python at once in this session: for results that are only computed
    when the caller writes them, which ``arrow_rows`` does not reach. A smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(ids: list, texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield ids[start:k], texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts as bytes) of Arrow batches that have the columns of keyed_texts()."""
    for batch in row_slices(batches):
        ids = batch.column("doc_id").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield from sliced(ids, texts, limit)


def row_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node.

    ``nodes(node)`` are distinct longs, ``edges(u, v)`` link them in either direction. Alternates the
    large-star and small-star steps, which need a logarithmic number of rounds whatever the diameter, and
    checkpoints the edges after each round. A star's centre may have any number of leaves: the minimum of
    a neighbourhood is a pre-aggregated group, and it meets the edges again in an equi-join, which adaptive
    execution splits where one centre is hot. Few edges stay in few partitions, so that a round over them does not
    leave a file for every pair of tasks. Returns ``node, component``.
    """
    links = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = cut_lineage(links)
    state = _edge_state(links)
    width = max(1, min(shuffle_width(nodes.sparkSession), state[0] // EDGES_OF_A_TASK + 1))  # edges never become more
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        links = cut_lineage(_small_star(_large_star(links.coalesce(width), width), width).coalesce(width))
        before, state = state, _edge_state(links)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _edge_state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame, width: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(width)
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")).coalesce(width)
    return both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").coalesce(width).distinct().coalesce(width)


def _small_star(links: DataFrame, width: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("low")).coalesce(width)
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.filter("u <> v").unionByName(lowest.select("u", F.col("low").alias("v"))).coalesce(width).distinct()


def concat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one uint8 array, and the len+1 offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def in_worker(name: str, make: Callable[[], object]):
    """What ``make`` gives, made once in each Python worker process and kept for its later tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("palimpsest_worker_state", types.ModuleType("palimpsest_worker_state")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
