"""Collocations by vertical positional lists, kept where the texts are.

Each phrase has a list of the places where it begins; a chunk of documents holds its own part of every list. A level's
frequent phrases are extended by merge-joining their lists with the postings of the frequent words one place behind
their end, within a piece, and with their own lists one place on, as the rest of a frequent phrase is frequent too. What
a phrase's lists hold together is its exact frequency. Between levels the chunks ask which of their phrases can be
frequent at all: one 8-byte record, a hash and a count, for each distinct phrase of a chunk, spread over buckets by
hash; of phrases that share a hash all pass. Then the passing phrases are counted by their words in a Spark aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage
from palimpsest.llm.exchange import Exchange, Replies, split_sorted

MAX_WORDS, LEAST_COUNT, TOP, SHADOW_PERCENT = 3, 10, 2000, 50
SCORE_UNIT = 1_000_000
#: A record is 56 bits of hash and a count that stops at this.
_FULL = 255
_SALTS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD, _BLANK, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _CUT


def tokenised(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word codes, number of the piece of each, the distinct words) of a text whose A-Z are lower-cased here."""
    letters = np.frombuffer(text.translate(_LOWER), np.uint8)
    kind = _KIND[letters]
    inside = kind == _WORD
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    piece = np.searchsorted(np.nonzero(kind == _CUT)[0], starts)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), piece, coded.dictionary


class Level:
    """Occurrences of phrases of one length: the places ``at``, ascending, and the ``phrase`` of each; of each phrase
    its hash, the length of its list here, the phrase that it extends and the word behind that."""

    def __init__(self, at: np.ndarray, phrase: np.ndarray, hashes: np.ndarray, counts: np.ndarray, parent: np.ndarray | None = None, word: np.ndarray | None = None):
        self.at, self.phrase, self.hashes, self.counts, self.parent, self.word = at, phrase, hashes, counts, parent, word

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted records, the phrase of each)."""
        keys = (self.hashes & ~np.uint64(_FULL)) | np.minimum(self.counts, _FULL).astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        return keys[order], order


class PhraseChunk:
    """A chunk's words in the order (lang, doc_id, text), which any attempt rebuilds; pieces never cross documents."""

    def __init__(self, table: pa.Table):
        rows = zip(table.column("lang").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True)
        groups: dict[str, list] = {}
        for lang, doc_id, text in rows:
            groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, text))
        codes, pieces, words, hashes, self.totals, self.langs = [], [], [], [], {}, []
        n_words = n_pieces = 0
        for lang in sorted(groups):
            code, piece, own = tokenised(b"\n".join(r[2] for r in sorted(groups[lang])))
            seed = xxhash.xxh64_intdigest(lang.encode())
            hashes.append(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own.to_pylist()), np.uint64, len(own)))
            codes.append(code + n_words)
            pieces.append(piece + n_pieces)
            words.append(own)
            self.langs += [lang] * len(own)
            self.totals[lang] = len(code)
            n_words += len(own)
            n_pieces += int(piece[-1]) + 1 if len(piece) else 0
        self.codes, self.pieces = np.concatenate(codes), np.concatenate(pieces)
        self.words, self.hashes = pa.concat_arrays(words), np.concatenate(hashes)

    def first(self) -> Level:
        return Level(np.arange(len(self.codes)), self.codes, self.hashes, np.bincount(self.codes, minlength=len(self.words)))

    def extend(self, level: Level, frequent: np.ndarray, posted: np.ndarray, size: int) -> Level:
        """The next level: ``frequent`` marks the level's phrases, ``posted`` the places of frequent words."""
        kept = frequent[level.phrase]
        at, phrase = level.at[kept], level.phrase[kept]
        met = _meets(posted, at + size) & _meets(at, at + 1)
        at, phrase = at[met], phrase[met]
        same = self.pieces[at + size] == self.pieces[at]
        at, phrase = at[same], phrase[same]
        wide = max(1, len(self.words))
        pairs, of, counts = np.unique(phrase * wide + self.codes[at + size], return_inverse=True, return_counts=True)
        parent, word = pairs // wide, pairs % wide
        return Level(at, of.reshape(-1), _mixed(level.hashes[parent], self.hashes[word]), counts, parent, word)


def _meets(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Merge join of two ascending lists of places: which of ``wanted`` are in ``places``."""
    if not len(places):
        return np.zeros(len(wanted), bool)
    found = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return places[found] == wanted


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _split(keys: np.ndarray, n_buckets: int) -> list[tuple[int, slice]]:
    return split_sorted(((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64), n_buckets)


def possible(bodies: list[bytes], least: int) -> list[bytes]:
    """For each chunk's records a bit each: whether the phrases of its hash reach ``least`` over all chunks."""
    parts = [np.frombuffer(b, np.uint64) for b in bodies]
    flat = np.concatenate(parts)
    key = flat >> np.uint64(8)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0]
    totals = np.add.reduceat((flat[order] & np.uint64(_FULL)).astype(np.int64), head)
    out = np.empty(len(flat), bool)
    out[order] = np.repeat(totals >= min(least, _FULL), np.diff(np.append(head, len(flat))))
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum([len(p) for p in parts])[:-1])]


def _levels(chunk: PhraseChunk, replies: Replies, n_buckets: int, size: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels 1 to ``size`` and which phrases of the levels before passed: by the chunk's notes, the last by the answers."""
    levels, passed = [chunk.first()], []
    posted = None
    for m in range(1, size):
        level = levels[-1]
        n = len(level.hashes)
        if -m in replies:
            flags = np.unpackbits(np.frombuffer(replies[-m], np.uint8), count=n).astype(bool)
        else:
            flags = _answers(level, replies, n_buckets)
        passed.append(flags)
        if posted is None:
            posted = np.nonzero(flags[chunk.codes])[0]
        levels.append(chunk.extend(level, flags, posted, m))
    return levels, passed


def _answers(level: Level, replies: Replies, n_buckets: int) -> np.ndarray:
    keys, order = level.records()
    flags = np.zeros(len(order), bool)
    for b, s in _split(keys, n_buckets):
        flags[order[s]] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=s.stop - s.start)
    return flags


def _ask(size: int, n_buckets: int) -> Callable[[PhraseChunk, Replies], dict[int, bytes]]:
    def question(chunk: PhraseChunk, replies: Replies) -> dict[int, bytes]:
        levels, passed = _levels(chunk, replies, n_buckets, size)
        keys, _ = levels[-1].records()
        notes = {-m: np.packbits(flags).tobytes() for m, flags in enumerate(passed, 1)}
        return {b: keys[s].tobytes() for b, s in _split(keys, n_buckets)} | notes

    return question


_COUNTED = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _lists(n_buckets: int, max_words: int) -> Callable[[PhraseChunk, Replies], pa.Table]:
    """The lengths of a chunk's lists of all passing phrases, and how many words it has in each language (size 0)."""

    def conclude(chunk: PhraseChunk, replies: Replies) -> pa.Table:
        levels, passed = _levels(chunk, replies, n_buckets, max_words)
        passed.append(_answers(levels[-1], replies, n_buckets))
        langs = np.array(chunk.langs, object)
        out = [pa.table([pa.array(list(chunk.totals), pa.string()), pa.array([0] * len(chunk.totals), pa.int32()), pa.array([""] * len(chunk.totals)), pa.array(list(chunk.totals.values()), pa.int64())], schema=_COUNTED)]
        rows = np.arange(len(chunk.words))[:, None]
        for m, (level, flags) in enumerate(zip(levels, passed, strict=True), 1):
            if m > 1:
                rows = np.column_stack([rows[level.parent], level.word])
            which = np.nonzero(flags)[0]
            own = rows[which]
            parts = [chunk.words.take(pa.array(own[:, k])) for k in range(m)]
            text = (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if m > 1 else parts[0]).cast(pa.large_string()).cast(pa.string())
            out.append(pa.table([pa.array(langs[own[:, 0]].tolist(), pa.string()), pa.array(np.full(len(which), m, np.int32)), text, pa.array(level.counts[which].astype(np.int64))], schema=_COUNTED))
        return pa.concat_tables(out)

    return conclude


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST_COUNT, chunk_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, size, phrase, f``: exact counts of all phrases of one to ``max_words`` words that occur ``least`` times in
    their language, and with size 0 the words of each language."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    ex = Exchange(texts, **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}), reader=PhraseChunk, texts=texts)
    n_buckets, replies = ex.n_buckets, None
    for size in range(1, max_words + 1):
        replies = ex.answer(ex.ask(_ask(size, n_buckets), replies), lambda bodies: possible(bodies, least))
    lists = ex.finish(replies, _lists(n_buckets, max_words), "lang string, size int, phrase string, f long")
    return lists.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("size") == 0) | (F.col("f") >= least))


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame, unit: int = SCORE_UNIT) -> DataFrame:
    """``lang, size, phrase, a, l, r, score`` of all phrases of two words or more, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    many = counts.filter("size >= 2")
    cut = lambda k: F.struct(k.alias("k"), _joined(words, F.lit(1), k).alias("left"), _joined(words, k + 1, F.col("size") - k).alias("right"))
    cuts = many.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("c")).select("lang", "size", "phrase", "a", "c.*")
    parts = counts.filter("size >= 1").select("lang", "phrase", "f")
    met = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    judged = met.withColumn("top", exact("a") * exact("a") * F.lit(unit)).withColumn("low", exact("l") * exact("r")).withColumn("score", F.expr("top div low"))
    best = judged.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("b"))
    return best.select("lang", "b.size", "phrase", "b.a", "b.l", "b.r", "b.score")


def overshadowed(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: the largest count of a longer phrase that holds the phrase."""
    words = F.split("phrase", " ")
    inner = lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _joined(words, i, m))
    held = counts.filter("size >= 3").select("lang", "f", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inner)))).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST_COUNT, top: int = TOP, shadow: int = SHADOW_PERCENT,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chunk_bytes: int | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, count and then text.

    Texts, A-Z lower-cased, fall into pieces at ``. , ; : ! ?`` and 0x0A-0x0D and those into words at blanks and tabs;
    phrases of 2 to ``max_words`` words that stand in one piece ``least`` times or more, overlaps included, compete. The
    score is floor(1000000 a a / (l r)) of the cut with the least, of equal ones the first. A phrase inside a longer one
    that has ``shadow`` percent of its count is dropped. A null text is empty, a null lang is ``und``; null, shared and
    repeated ids change nothing, as every row is counted. A null or empty text gives no word. Equal scores are ordered by
    count, then by the bytes of the phrase, so ranks never tie. Products are decimals of 38 digits, exact for corpora of
    up to 10^16 words. An empty table gives an empty result. Columns other than the three named are ignored.
    """
    counts = cut_lineage(phrase_counts(docs, max_words, least, chunk_bytes, id_col, text_col, lang_col))
    held = overshadowed(counts)
    kept = scored(counts).join(held, ["lang", "phrase"], "left").filter("longest IS NULL OR 100 * longest < %d * a" % shadow)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    heads = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
