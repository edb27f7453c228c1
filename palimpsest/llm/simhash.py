"""SimHash near-duplicates with fuzzy keys from the perfect binary Golay code [23, 12, 7].

A 64-bit fingerprint has three segments (23, 23 and 18 bits). Two fingerprints that differ in at most two
bits agree wholly in at least one segment (pigeonhole), and in the segment after it they differ in at most
two bits. Every 23-bit word lies within three bits of exactly one Golay codeword; a word, together with its
23 neighbours, decodes to one or six codewords, and two words at most two bits apart always share one of
them. So a key is (which segment agrees, its bits, a codeword index of the next segment): about 16 keys a
fingerprint, each of 30 to 35 bits.

Distinct fingerprints are joined, not documents: a group of copies is one row. A key shared by few
fingerprints is joined with itself and verified by popcount. A key shared by more than ``pair_limit``
would give quadratically many pairs, so its fingerprints are linked exactly another way: fingerprints
within two bits of each other have a word in common among themselves and their 64 one-bit neighbours, and
any two that share such a word are within two bits, so each is linked to the least fingerprint of each
such word. No pair is lost and the work stays linear.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import by_ids, connected_components, cut_lineage, keyed_texts, small, text_slices, with_row_ids

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIR_LIMIT = 32


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words of a lower-cased text; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        grams = [b" ".join(words)]
    elif width == 1:
        grams = words
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches):
        for ids, texts in text_slices(batches):
            prints = np.array([fingerprint(shingle_hashes(t, width, seed)) for t in texts], np.uint64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return keyed_texts(docs, id_col).mapInArrow(run, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator: 11 bits."""
    rest = words.astype(np.int64).copy()
    for k in range(22, 10, -1):
        rest ^= np.where((rest >> k) & 1, GENERATOR << (k - 11), 0)
    return rest


def _error_table() -> np.ndarray:
    """For each of the 2048 syndromes, the one word of at most three bits that has it."""
    bits = [1 << k for k in range(23)]
    words = [0, *bits]
    words += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    words += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.zeros(2048, np.int64)
    table[_syndromes(np.array(words))] = words
    return table


_ERRORS = _error_table()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index (upper bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int64)
    return (words ^ _ERRORS[_syndromes(words)]) >> 11


def nearby_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: every codeword that a word or one of its 23 one-bit neighbours decodes to."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(decode((words.astype(np.int64)[:, None] ^ flips).ravel()).reshape(len(words), 24), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(first)[0], found[first]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of unsigned 64-bit fingerprints."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        row, index = nearby_codewords(parts[(k + 1) % 3])
        rows.append(row)
        keys.append((np.int64(k) << 40) | (parts[k][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def near_pairs(prints: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links ``u, v`` that connect all distinct ``fp`` of ``prints(fp)`` at two or fewer differing bits."""

    def keys(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = golay_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    def flips(batches):
        masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            near = (fp.view(np.uint64)[:, None] ^ masks).view(np.int64)
            yield pa.record_batch([pa.array(near.ravel()), pa.array(np.repeat(fp, 65))], names=["word", "fp"])

    keyed = prints.mapInArrow(keys, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(sizes, "key"))
    cold = shared.filter(F.col("n") <= pair_limit).select("key", "fp")
    other = cold.select("key", F.col("fp").alias("other"))
    pairs = cold.join(other, "key").filter("fp < other AND bit_count(fp ^ other) <= 2").select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()
    words = shared.filter(F.col("n") > pair_limit).select("fp").distinct().mapInArrow(flips, "word long, fp long")
    least = words.groupBy("word").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = words.join(least, "word").filter("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, pair_limit: int = PAIR_LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text, ...)``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the least doc_id that links reach,
    the row itself included. Null and empty texts, and texts of white space only, have fingerprint zero and link
    like any other. Repeated rows and equal texts share a fingerprint, hence a component. Texts of any length are
    read whole. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    each = cut_lineage(fingerprints(docs, width, seed, id_col))
    distinct = cut_lineage(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    ends = cut_lineage(near_pairs(distinct.select("fp"), pair_limit))
    names = small(distinct.select(F.col("fp").alias("u"), F.col("first_id").alias("a")))
    named = ends.join(names, "u").join(names.select(F.col("u").alias("v"), F.col("a").alias("b")), "v")
    # two fingerprints may have one first id where that id has several rows
    roots = connected_components(distinct.select(F.col("first_id").alias("node")).distinct(), named.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = small(distinct.join(roots, distinct.first_id.eqNullSafe(roots.node)).select("fp", "component"))
    return each.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """The row of ``docs(doc_id, text, ...)``, all columns, with the least doc_id of each component.

    Rows are told apart even where they share a doc_id or have none: exactly one row of a component stays.
    """
    rows, row = with_row_ids(docs)
    dropped = near_duplicates(rows, width, seed, id_col=row).filter("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return by_ids(rows, dropped, row, "left_anti").select(*docs.columns)
