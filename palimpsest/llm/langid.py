"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_column, keyed_texts, text_slices

#: Bound of the labelled sample that the dictionaries are made from: rows of each language.
SAMPLE_ROWS = 400
#: Bytes of a language's dictionary.
DICTIONARY_BYTES = 112 << 10

#: Matches from four bytes on: the languages' syllables are short.
SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
BLOCK_BYTES = 1 << 10
#: A text is rejected if the second smallest encoding is larger by less than this share of the smallest.
MIN_MARGIN = 0.0005

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def dictionary_words(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, list[str]]:
    """The words of each language that most of about ``rows`` whole texts of it hold, as many as ``size`` bytes take.

    Texts are picked by a hash of the id; words come commonest first, equally common ones by name.
    """
    labelled = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))) for lang, n in counts.items()])
    picked = labelled.filter(F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                words = list(dict.fromkeys(words_of(text.as_py())))
                yield pa.record_batch([pa.array([lang.as_py()] * len(words), pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    seen = picked.select("lang", "text").mapInArrow(run, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # bounded by the sample
    kept = seen.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(order)).filter(F.col("bytes") <= size - 1)
    found: dict[str, list[str]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["bytes"])):
        found.setdefault(r["lang"], []).append(r["word"])
    return found


def build_dictionaries(words: dict[str, list[str]]) -> dict[str, bytes]:
    """A raw-content dictionary of each language, the commonest word last; each as long as its own words make it."""
    joined = {lang: f" {' '.join(reversed(many))} ".encode() for lang, many in sorted(words.items())}
    return {lang: b for lang, b in joined.items() if len(b) >= 8}


class Compressors:
    """The encoders of all languages; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.encoders = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            search = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
            d.precompute_compress(compression_params=search)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=search).compress)
        self.words = [frozenset(c.decode().split()) for c in dictionaries.values()]

    def sizes(self, words: list[str]) -> list[float]:
        """Encoded bytes, and the share of the distinct words that a dictionary lacks: encodings come in whole
        bytes, which alone would leave the shortest texts tied. At every length the share is at most one byte."""
        body = f" {' '.join(words)} ".encode()
        blocks = [body[k : k + BLOCK_BYTES] for k in range(0, len(body), BLOCK_BYTES)]
        distinct = set(words)
        return [sum(map(len, map(encode, blocks))) + 1.0 - len(distinct & known) / len(distinct) for encode, known in zip(self.encoders, self.words, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score 0..1, margin); ``und`` without letters, and if no language was learned."""
        words = words_of(text or "")
        if not words or not self.languages:
            return "und", 0.0, 0.0
        sizes = self.sizes(words)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        score = 1.0 / sum(math.pow(2.0, -min(1000.0, x - best)) for x in sizes)
        margin = (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0
        return self.languages[order[0]], score, margin


def identify(docs: DataFrame, train: DataFrame, min_margin: float = MIN_MARGIN, **bounds) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for every row of ``docs(doc_id, text, ...)``.

    All words of a text (runs of letters, lower-cased) are compressed with one zstandard raw-content dictionary
    a language, in blocks so that the dictionary tells throughout a long text; the smallest total wins.
    Dictionaries come from a bounded sample of rows of ``train(doc_id, text, lang)``. A null text and one without
    letters give ``und``, score 0, rejected. A margin below ``min_margin`` is rejected, though ``lang_pred``
    still names the nearest language; an exact tie names the first by name. Equal texts and repeated rows get
    equal answers. An empty ``train`` gives ``und`` for all rows; an empty ``docs`` an empty result. Columns other
    than those named are ignored.
    """
    dictionaries = build_dictionaries(dictionary_words(train, **bounds))

    def run(batches):
        compressors = Compressors(dictionaries)
        for ids, texts in text_slices(batches):
            found = [compressors.predict(t.decode()) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score", "margin"])

    found = keyed_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("margin") < min_margin))


def is_identified(text: Column, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> Column:
    """Whether a text's language is told; only the texts travel to Python."""

    def told(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = Compressors(dictionaries)
        for part in parts:
            found = [compressors.predict(t.as_py()) for t in part]
            yield pa.array([lang != "und" and margin >= min_margin for lang, _, margin in found], pa.bool_())

    return arrow_column(told, "boolean")(text)


def keep_identified(docs: DataFrame, train: DataFrame, min_margin: float = MIN_MARGIN, **bounds) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, whose language is not rejected; see identify().

    Rows are judged one by one by their text alone, so repeated rows and equal texts stay or go together; null
    texts go. With an empty ``train`` no language is learned and all rows go.
    """
    return docs.filter(is_identified(F.col("text"), build_dictionaries(dictionary_words(train, **bounds)), min_margin))
