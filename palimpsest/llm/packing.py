"""Packing along a space-filling curve: alike documents lie next to each other in the sequences."""

from __future__ import annotations

import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import concat_bytes, in_worker, keyed_texts, shuffle_width, text_slices
from palimpsest.llm.exchange import NULL_ID

SEQUENCE_TOKENS = 1024
SEPARATOR_ID = 0
DIMENSIONS = 4
BITS = 12
#: A run of white space that the pattern would backtrack over for too long.
LONG_RUN = 50_000
#: Texts of one vector step, in bytes: its arrays then stay in the processor's cache.
VECTOR_BYTES = 192 << 10
#: Bound of the sample of documents whose keys give the range splitters.
SPLITTER_ROWS = 20_000


class UnitEncoder:
    """Ids of a byte-level BPE tokenizer file.

    Whole texts are encoded by tiktoken with the same pattern and vocabulary, which is several times as fast, and faster
    than putting a text together from units remembered; a text that holds a special token's string or a very
    long run of white space, or any text if the file asks for more than the pattern, is left to the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        self.run = re.compile(rf"\s{{{LONG_RUN}}}")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(map(to_byte.__getitem__, word)): i for word, i in spec["model"]["vocab"].items() if word not in self.specials}
        self.fast = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Only loaded for a text that asks for it: a worker that meets none does not hold its tables."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if not self.plain or any(s in text for s in self.specials) or len(text) > LONG_RUN and self.run.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def hashed_vectors(texts: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Mean signs of the hashed 4-byte grams of each text, one row a text; zero for texts of under 4 bytes."""
    flat, offsets = concat_bytes(texts)
    out = np.zeros((len(texts), dimensions))
    if len(flat) < 4:
        return out
    grams = flat[:-3].astype(np.uint32) | flat[1:-2].astype(np.uint32) << 8 | flat[2:-1].astype(np.uint32) << 16 | flat[3:].astype(np.uint32) << 24
    grams *= np.uint32(0x9E3779B1)
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x85EBCA77)
    starts, counts = offsets[:-1], np.maximum(np.diff(offsets) - 3, 0)
    for d in range(dimensions):
        ones = np.concatenate([[0], np.cumsum((grams >> np.uint32(31 - d)) & np.uint32(1), dtype=np.int64)])
        stop = np.minimum(starts + counts, len(grams))
        total = ones[stop] - ones[np.minimum(starts, len(grams))]
        out[:, d] = np.where(counts > 0, 2.0 * total / np.maximum(counts, 1) - 1.0, 0.0)
    return out


def hilbert_keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each point of [-1, 1]^d along a Hilbert curve of ``bits`` levels (Skilling's transform)."""
    n, dims = vectors.shape
    top = (1 << bits) - 1
    spread = np.tanh(vectors * 4)  # means of many signs lie near zero
    x = np.clip(np.round((spread + 1) / 2 * top), 0, top).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tail_sizes(left: int) -> list[int]:
    """A remainder as powers of two, largest first: sequences of these lengths need no padding."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


class _Packer:
    """Cuts one stream of ids into sequences; the last, partial one into powers of two."""

    def __init__(self, first_id: int, capacity: int):
        self.sequence, self.capacity, self.offset = first_id, capacity, 0
        self.pending: list[tuple[int, int, np.ndarray, int]] = []
        self.out: list[tuple] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(total - start, self.capacity - self.offset)
            self.pending.append((doc_id, start, ids[start : start + take], total))
            start, self.offset = start + take, self.offset + take
            if self.offset == self.capacity:
                self._close([self.capacity])

    def _close(self, sizes: list[int]) -> None:
        pieces, k = iter(self.pending), 0
        piece = next(pieces, None)
        for size in sizes:
            at = 0
            while at < size:
                doc_id, start, ids, total = piece
                part = ids[k : k + size - at]
                self.out.append((doc_id, start + k, len(part), zlib.crc32(part.tobytes()), total, self.sequence, at))
                at, k = at + len(part), k + len(part)
                if k == len(ids):
                    piece, k = next(pieces, None), 0
            self.sequence += 1
        self.pending, self.offset = [], 0

    def finish(self) -> None:
        if self.offset:
            self._close(_tail_sizes(self.offset))

    def take(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.out, strict=True)) or [()] * len(names)
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str | None = None, pattern: str | None = None, capacity: int = SEQUENCE_TOKENS, partitions: int | None = None) -> DataFrame:
    """Pieces (``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``) of all documents.

    Each text's hashed vector is projected to a few dimensions; its place on a Hilbert curve is the sort key.
    Documents are range-partitioned by (key, doc_id), so that copies, which share a key, still spread, and
    each range is tokenised once and cut along the curve into sequences of ``capacity`` tokens; what remains
    at the end of a range becomes sequences of a power of two tokens. A document is its ids and then id 0; a
    null or empty text is that id alone. No id is lost, none is padded. ``sequence_id`` has the range in its
    upper bits. Repeated rows are documents of their own, and so are rows with a null doc_id, which stand
    first among equal keys. A long text spans as many sequences as it needs.
    An empty table gives an empty result. The tokenizer file is read where the rows are, from
    ``tokenizer_path`` or, by default, the public byte-level BPE of 50,257 ids.
    """

    def keyed(batches):
        for ids, texts in text_slices(batches, VECTOR_BYTES):
            yield ids, texts, hilbert_keys(hashed_vectors(texts))

    def sample(batches):
        for ids, _, key in keyed(batches):
            yield pa.record_batch([pa.array(key), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    texts = keyed_texts(docs)
    width = partitions or shuffle_width(docs.sparkSession)
    share = min(1.0, SPLITTER_ROWS / max(1, texts.count()))
    picked = texts.filter("doc_id IS NOT NULL").filter(F.pmod(F.xxhash64("doc_id", F.lit("packing")), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * SPLITTER_ROWS)
    drawn = sorted((r[0], r[1]) for r in picked.mapInArrow(sample, "key long, doc_id long").collect())
    cuts = [drawn[k * len(drawn) // width] for k in range(1, width)] if drawn else []
    cut_keys, cut_ids = (np.array([c[j] for c in cuts], np.int64) for j in (0, 1))

    def place(batches):
        for ids, texts, key in keyed(batches):
            part = np.searchsorted(cut_keys, key, side="left")
            high = np.searchsorted(cut_keys, key, side="right")
            for k in np.nonzero(high > part)[0]:  # among equal keys the ids decide
                part[k] += np.searchsorted(cut_ids[part[k] : high[k]], NULL_ID if ids[k] is None else ids[k], side="right")
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(key), pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["part", "key", "doc_id", "text"])

    def cut(batches):
        import public_tokenizers

        path, split = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
        encoder = in_worker(f"units {path} {split}", lambda: UnitEncoder(path, split))
        packer = _Packer(TaskContext.get().partitionId() << 36, capacity)
        end = np.array([SEPARATOR_ID], "<u4")
        for ids, texts in text_slices(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                packer.add(doc_id, np.concatenate([encoder.encode(text.decode()), end]))
            yield packer.take()
        packer.finish()
        yield packer.take()

    placed = texts.mapInArrow(place, "part int, key long, doc_id long, text string")
    ranged = placed.repartitionById(width, "part").sortWithinPartitions("key", "doc_id")
    return ranged.select("doc_id", "text").mapInArrow(cut, PIECES)
