"""Repeated passages of words: Rabin-Karp hashes of every window, counted in Spark."""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from palimpsest.llm.exchange import Chunk, Exchange, Replies, split_sorted

WINDOW_WORDS = 35
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words of one step; the powers of the base are kept that far.
STEP_WORDS = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, STEP_WORDS + 1), _powers(_INVERSE, STEP_WORDS + 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of each window of ``width`` codes; then mixed, as its low bits are weak."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    parts = []
    step = max(1, STEP_WORDS - width)
    for at in range(0, n, step):
        part = codes[at : min(len(codes), at + step + width - 1)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _POWERS[: len(part)], dtype=np.uint64)])
        m = len(part) - width + 1
        parts.append((sums[width:] - sums[:m]) * _INVERSES[:m])
    h = np.concatenate(parts)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


class _Windows:
    """All windows of a chunk: hashes in document order, and the distinct ones with how often they occur."""

    def __init__(self, chunk: Chunk, width: int):
        self.words = [t.split() for t in chunk.texts]
        hashes = [window_hashes(word_hashes(w), width) for w in self.words]
        self.counts = [len(h) for h in hashes]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.keys, self.inverse, self.times = np.unique(flat, return_inverse=True, return_counts=True)


def _ask(width: int, n_buckets: int):
    def question(chunk: Chunk, _: Replies) -> dict[int, bytes]:
        w = _Windows(chunk, width)
        return {b: w.keys[s].tobytes() + np.packbits(w.times[s] > 1).tobytes() for b, s in split_sorted(_bucket(w.keys, n_buckets), n_buckets)}

    return question


def _count(bodies: list[bytes]) -> list[bytes]:
    """For each chunk's keys, a bit each: whether the key occurs at least twice anywhere."""
    sizes, keys, twice = [], [], []
    for body in bodies:
        n = _records(len(body))
        sizes.append(n)
        keys.append(np.frombuffer(body, np.uint64, n))
        twice.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=8 * n), count=n))
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="quicksort")
    ranked = flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    weight = np.bincount(group, weights=1 + np.concatenate(twice)[order])
    repeated = np.empty(len(flat), bool)
    repeated[order] = weight[group] > 1
    ends = np.cumsum(sizes)
    return [np.packbits(repeated[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]


def _records(size: int) -> int:
    """How many 8-byte keys with a bit each fill ``size`` bytes."""
    n = size * 8 // 65
    while 8 * n + (n + 7) // 8 > size:
        n -= 1
    return n


def _answers(replies: Replies, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(replies[b], np.uint8), count=s.stop - s.start) for b, s in split_sorted(_bucket(keys, n_buckets), n_buckets)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def covered(flags: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` that starts where ``flags`` is set: merged intervals."""
    edge = np.zeros(n + 1, np.int32)
    starts = np.nonzero(flags)[0]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, stop) runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def repeated_windows(docs: DataFrame, width: int = WINDOW_WORDS, chunk_bytes: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_sha256`` (and ``kept``) for every row of ``docs(doc_id, text, ...)``.

    A word is removed if a window of ``width`` words over it also starts anywhere else, in the same document
    or another; windows are judged on the input. ``spans`` are the maximal removed runs (start, stop) in words.
    Words are runs of bytes other than space and 0x09-0x0D. Null and empty texts have no words, texts of fewer
    than ``width`` words no window; both keep all. Repeated rows are occurrences of their own, so all of them
    lose their windows; so are rows with a null doc_id. Every window of every text is hashed to 64 bits and counted over the whole corpus;
    two of n different windows collide with a chance of about n^2 / 2^65. An empty table gives an empty
    result. Columns other than doc_id and text are ignored.
    """
    ex = Exchange(docs, chunk_bytes) if chunk_bytes else Exchange(docs)
    n_buckets = ex.n_buckets

    def conclude(chunk: Chunk, replies: Replies) -> pa.Table:
        w = _Windows(chunk, width)
        flags = _answers(replies, w.keys, n_buckets)[w.inverse]
        out, at = [], 0
        for words, n in zip(w.words, w.counts, strict=True):
            mask = covered(flags[at : at + n], len(words), width)
            at += n
            spans = runs(mask)
            kept, last = [], 0
            for a, b in spans:
                kept += words[last:a]
                last = b
            kept = b" ".join(kept + words[last:])
            out.append((len(words), int(mask.sum()), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept))
        columns = [chunk.shown, *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), _SPANS, pa.string())))]
        names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array([o[4] for o in out], pa.binary()).cast(pa.string()))
            names.append("kept")
        return pa.table(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string" + ", kept string" * with_text
    return ex.finish(ex.answer(ex.ask(_ask(width, n_buckets)), _count), conclude, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
