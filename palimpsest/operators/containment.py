"""Which texts hold which strings, by seeds: hashes of the strings' heads meet hashes of every place of the texts.

A string's head is its longest prefix of 1, 2, 4, ... 32 bytes. Hashes of all windows of those lengths come from one
another by doubling. Places whose hash is a seed travel with as much of the text as the longest string of that seed needs,
meet the strings by an equi-join on the seed and are compared byte by byte. No string meets a text that lacks its head.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage

HEADS = (1, 2, 4, 8, 16, 32)
#: Distinct seeds of one pass over the texts; more strings take more passes.
SEEDS_AT_ONCE = 500_000
#: Bytes of text that one step hashes.
STEP_BYTES = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def folded(text: str | None) -> str | None:
    """Compatibility forms (NFKC) as their plain ones."""
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


def plain(text: str | None) -> str | None:
    """NFKC, lower case, and one space for each run of what is no Latin letter or digit."""
    return None if text is None else re.sub(r"[^a-z0-9]+", " ", (folded(text) or "").lower()).strip()


def window_hashes(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the window at each place), lengths doubling while the text is long enough."""
    h = text.astype(np.uint64) + np.uint64(0x27D4EB2F165667C5)
    yield 1, h * np.uint64(_MULTIPLIERS[0])
    for length, a in zip(HEADS[:-1], _MULTIPLIERS, strict=True):
        if len(h) <= length:
            return
        h = h[:-length] * np.uint64(a) + h[length:]
        h ^= h >> np.uint64(29)
        yield 2 * length, h * np.uint64(_MULTIPLIERS[0]) + np.uint64(2 * length)


def seed_of(text: bytes) -> tuple[int, int]:
    """(length of the head, its hash as a signed long)."""
    head = max(n for n in HEADS if n <= len(text))
    return head, int(dict(window_hashes(np.frombuffer(text[:head], np.uint8)))[head][0].view(np.int64))


def _seeded(needles: DataFrame, fold: Callable[[str | None], str | None]) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [fold(t) for t in frame["text"]]
            kept = [k for k, t in enumerate(texts) if t]
            body = [texts[k].encode() for k in kept]
            seeds = [seed_of(b) for b in body]
            yield pd.DataFrame({"needle": frame["needle"].iloc[kept].to_numpy(), "body": body, "head": [s[0] for s in seeds], "seed": [s[1] for s in seeds]})

    return needles.mapInPandas(run, f"needle {dict(needles.dtypes)['needle']}, body binary, head int, seed long")


def contained(needles: DataFrame, texts: DataFrame, fold: Callable[[str | None], str | None] = folded, seeds_at_once: int = SEEDS_AT_ONCE) -> DataFrame:
    """Distinct ``needle, id`` of all ``needles(needle, text)`` that stand in ``texts(id, text)``, both folded.

    Null and empty needles stand nowhere, a null text holds nothing. Ids may repeat; a pair comes back once. Seeds are
    dealt into passes of at most about ``seeds_at_once``, which are what travels to the tasks. Empty tables give nothing.
    """
    own = cut_lineage(_seeded(needles.select("needle", "text"), fold))
    distinct = own.groupBy("head", "seed").agg(F.max(F.octet_length("body")).alias("longest"))
    passes = max(1, -(-distinct.count() // seeds_at_once))
    found = None
    for k in range(passes):
        part = distinct.filter(F.pmod(F.xxhash64("seed"), F.lit(passes)) == k)
        hits = own.join(_places(texts.select("id", "text"), part.collect(), fold), ["head", "seed"])
        pairs = hits.filter(F.substring(F.col("around"), F.lit(1), F.octet_length("body")) == F.col("body")).select("needle", "id").distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _places(texts: DataFrame, seeds: list, fold: Callable[[str | None], str | None]) -> DataFrame:
    """``id, head, seed, around``: places of the texts at which a seed stands, equal ones of a text once."""
    by_head: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for head in {r.head for r in seeds}:
        rows = sorted((r.seed, r.longest) for r in seeds if r.head == head)
        by_head[head] = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)

    def of_text(body: bytes) -> set[tuple[int, int, bytes]]:
        out = set()
        for at in range(0, len(body), STEP_BYTES):
            for head, hashes in window_hashes(np.frombuffer(body[at : at + STEP_BYTES + HEADS[-1] - 1], np.uint8)):
                if head not in by_head:
                    continue
                known, longest = by_head[head]
                keys = hashes[:STEP_BYTES].view(np.int64)
                which = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                for p in np.nonzero(known[which] == keys)[0].tolist():
                    w = which[p]
                    out.add((head, int(known[w]), body[at + p : at + p + int(longest[w])]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for k in range(batch.num_rows):
                text = fold(batch.column("text")[k].as_py())
                places = sorted(of_text(text.encode())) if text else []
                if places:
                    head, seed, around = zip(*places, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k] * len(places))), pa.array(head, pa.int32()), pa.array(seed, pa.int64()), pa.array(around, pa.binary())], ["id", "head", "seed", "around"])

    return texts.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, head int, seed long, around binary")
