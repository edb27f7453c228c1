"""Questions and answers between chunks of documents and buckets of keys.

Documents are dealt into chunks of a few MB by a hash of doc_id and text, once, so that rows that share an id, null
ids among them, spread; several rounds then work on the same shuffled chunks (one exchange that the plan reuses). In a round each chunk asks about its distinct keys, in
one binary row for each bucket of the key range; each bucket gathers what all chunks ask about its keys
and answers every chunk in one binary row. A key that occurs in a third of all documents is thus asked at
most once by each chunk, and no document's text moves again. A question is an array of fixed-width records
in an order that the chunk can rebuild, so the answer needs no keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import keyed_texts, shuffle_width

CHUNK_BYTES = 3 << 20
ASKED = "chunk long, bucket int, body binary"
_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])

#: Buckets below zero carry a chunk's own notes to its next round.
Replies = dict[int, bytes]


#: Where ids are compared, null stands before every other.
NULL_ID = -(1 << 62)


class Chunk:
    """The rows of one chunk in the order (doc_id, text), nulls first, which any attempt rebuilds."""

    def __init__(self, table: pa.Table):
        rows = zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True)
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.shown = pa.array([r[0] for r in rows], pa.int64())
        self.ids = np.array([NULL_ID if r[0] is None else r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]


def _asked(chunk: int, bodies: dict[int, bytes]) -> pa.Table:
    keys = sorted(bodies)
    return pa.table([pa.array([chunk] * len(keys), pa.int64()), pa.array(keys, pa.int32()), pa.array([bodies[k] for k in keys], pa.binary())], schema=_ASKED)


class Exchange:
    """``texts``, if given, has doc_id, text and columns that travel with them; ``reader`` makes of a chunk's rows what
    the questions work on."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, reader: Callable[[pa.Table], object] = Chunk, texts: DataFrame | None = None):
        texts = keyed_texts(docs) if texts is None else texts
        self.reader = reader
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n_chunks = max(1, -(-size // chunk_bytes))
        self.n_partitions = max(shuffle_width(docs.sparkSession), -(-self.n_chunks // 3))
        self.n_buckets = self.n_partitions
        dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n_chunks)))
        self.chunks = dealt.repartition(self.n_partitions, "chunk")

    def ask(self, question: Callable[[Chunk, Replies], dict[int, bytes]], replies: DataFrame | None = None) -> DataFrame:
        reader = self.reader
        if replies is None:

            def first(key, table):
                return _asked(key[0].as_py(), question(reader(table), {}))

            return self.chunks.groupBy("chunk").applyInArrow(first, ASKED)

        def later(key, table, got):
            return _asked(key[0].as_py(), question(reader(table), _replies(got)))

        return self.chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(later, ASKED)

    def answer(self, asked: DataFrame, resolve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        """What each bucket says to each chunk; a chunk's notes pass by unread, spread by chunk."""

        def gather(key, table):
            if key[0].as_py() < 0:
                return table.select(["chunk", "bucket", "body"])
            order = np.argsort(table.column("chunk").to_numpy(), kind="stable")
            rows = table.take(pa.array(order))
            bodies = resolve(rows.column("body").to_pylist())
            return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array(bodies, pa.binary())], schema=_ASKED)

        place = F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket").cast("long"))
        return asked.withColumn("place", place).groupBy("place").applyInArrow(gather, ASKED)

    def finish(self, replies: DataFrame, conclude: Callable[[Chunk, Replies], pa.Table], schema: str) -> DataFrame:
        reader = self.reader

        def last(key, table, got):
            return conclude(reader(table), _replies(got))

        return self.chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(last, schema)


def _replies(table: pa.Table) -> Replies:
    return dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True))


def split_sorted(bucket_of: np.ndarray, n_buckets: int) -> list[tuple[int, slice]]:
    """(bucket, slice) of each run of a non-decreasing array."""
    ends = np.searchsorted(bucket_of, np.arange(n_buckets + 1))
    return [(b, slice(ends[b], ends[b + 1])) for b in np.unique(bucket_of).tolist()]


def joined(replies: Replies, dtype) -> np.ndarray:
    """The answers of all buckets, in the order in which a sorted question was split."""
    return np.frombuffer(b"".join(replies[b] for b in sorted(replies) if b >= 0), dtype)


def run_lengths(*keys: np.ndarray) -> np.ndarray:
    """Group number of each element of arrays that are sorted together."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def multikey_argsort(*keys: np.ndarray) -> np.ndarray:
    """Multikey quicksort: sort by the first key, then each run of equals by the next key, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    for depth in range(1, len(keys)):
        group = run_lengths(*(k[order] for k in keys[:depth]))
        tied = np.nonzero(np.bincount(group)[group] > 1)[0] if len(group) else group
        if not len(tied):
            break
        part = order[tied]
        order[tied] = part[np.lexsort((keys[depth][part], group[tied]))]
    return order
