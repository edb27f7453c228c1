"""Benchmark decontamination by templates: numbers, names and units become typed placeholders."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_column, by_ids, cut_lineage, keyed_texts, sliced, small, text_slices, with_row_ids

WINDOW = 5
MIN_CONTAINMENT = 0.8
MIN_CONSISTENCY = 0.8
#: Benchmark words that one pass over the documents may hold; a larger benchmark is matched in blocks.
BLOCK_WORDS = 500_000
#: Bounds of a worker's memory of words, in words and characters.
CACHE_WORDS, CACHE_CHARS = 150_000, 4 << 20
#: Bytes of text that are matched at a time.
STEP_BYTES = 256 << 10

#: Words that name a unit when they follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg ton tons tonnes oz ounce ounces lb lbs pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years percent degrees degree dollars dollar euros euro cents cent mph kph kmh watts volts amps joules "
    "meter meters metre metres kilometers kilometres centimeters grams gram kilograms".split()
)
#: Words that stand for a number.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen".split()
)

_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d,.:/]*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"[$€£]?\d[\d,.]*([^\W\d_]+)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PLACEHOLDERS = ("<num>", "<name>", "<unit>")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Stands between two texts: no benchmark has its code, so no window over it is found.
_BREAK, _BREAK_CODE = "\x00 \x00", 0x5851F42D4C957F2D
_PUNCTUATION = ".,;:!?\"'()[]{}*-_"


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


_CODES = {p: _hash(p) for p in _PLACEHOLDERS}
_NUM, _NAME, _UNIT = (_CODES[p] for p in _PLACEHOLDERS)


class Canonicaliser:
    """Template codes of a text's words. Remembers words; starts anew when it holds too many."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {_BREAK: 0}
        #: Four numbers a word: code, code at the start of a sentence, code after a number, 1 if it ends a sentence.
        self.table = array("Q", (_BREAK_CODE, _BREAK_CODE, _BREAK_CODE, 1))
        self.chars = 0

    def _add(self, word: str) -> int:
        at = self.index[word] = len(self.index)
        self.chars += len(word)
        core = word.strip(_PUNCTUATION)
        if not core.isalpha():
            core = _EDGE.sub("", word)
        ends = 0 if word[-1:].isalpha() else word.rstrip("\"')]}*#%&$").endswith((".", "!", "?", ":"))
        low = core.lower()
        number = low in NUMBER_WORDS
        if not number and core[:1].isdigit():
            unit = _NUMBER_UNIT.fullmatch(core)
            number = bool(_NUMBER.fullmatch(core) or unit and unit[1].lower() in UNITS)
        if number:
            self.table.extend((_NUM, _NUM, _NUM, ends))
        else:
            code = _hash(low)
            named = len(core) > 1 and core[0].isupper() and core[1:].islower()
            self.table.extend((_NAME if named else code, code, _UNIT if low in UNITS else code, ends))
        return at

    def codes(self, words: list[str]) -> np.ndarray:
        return self.readings(words)[0]

    def readings(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and where a capitalised word opens a sentence: its code is the word, and it may be a name too."""
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._clear()
        known = list(map(self.index.get, words))
        if None in known:
            known = [k if k is not None else self.index[w] if w in self.index else self._add(w) for w, k in zip(words, known, strict=True)]
        plain, first, after, ends = np.frombuffer(self.table, np.uint64).reshape(-1, 4)[np.array(known, np.int64)].T
        starts = np.ones(len(words), bool)
        starts[1:] = ends[:-1] != 0
        numbers = np.zeros(len(words), bool)
        numbers[1:] = plain[:-1] == _NUM
        unit = numbers & (after == _UNIT)
        return np.where(unit, after, np.where(starts, first, plain)), starts & ~unit & (plain == _NAME)


def window_hashes(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _MULTIPLIER + codes[k : k + n]
    return h ^ (h >> np.uint64(29))


def named_windows(codes: np.ndarray, named: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, names) of the windows with one or more of their ``named`` words read as names, in every way."""
    n = len(codes) - width + 1
    if n <= 0 or not named.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.nonzero(np.convolve(named, np.ones(width, np.int64), "valid"))[0]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * _MULTIPLIER + codes[at + k]
    names = np.zeros(len(at), np.int64)
    for k in range(width):
        more = np.nonzero(named[at + k])[0]
        factor = np.uint64(pow(int(_MULTIPLIER), width - 1 - k, 1 << 64))
        h = np.concatenate([h, h[more] + (np.uint64(_NAME) - codes[at[more] + k]) * factor])
        at, names = np.concatenate([at, at[more]]), np.concatenate([names, names[more] + 1])
    read = names > 0
    h = h[read]
    return at[read], h ^ (h >> np.uint64(29)), names[read]


@dataclass
class Item:
    item_id: int
    words: list[str]
    codes: np.ndarray
    hashes: np.ndarray
    usable: np.ndarray  # windows with a word that is not a placeholder
    n_usable: int = 0
    named: np.ndarray = field(default_factory=lambda: np.empty(0, bool))  # words that open a sentence and may be names


def plain_words(words: list[str]) -> str:
    """Words without case and outer punctuation, each between two spaces."""
    return " ".join(["", *(low for w in words if (low := _EDGE.sub("", w).lower())), ""])


@dataclass
class Benchmark:
    """Items by number, and their template windows by hash. Items without a usable window are kept as plain words."""

    items: list[Item] = field(default_factory=list)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    sieve: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))
    whole: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))  # items of fewer words than a window
    literal: list[tuple[str, int]] = field(default_factory=list)  # longer items of placeholders only

    @staticmethod
    def of(rows: list[tuple[int, str]], width: int = WINDOW) -> Benchmark:
        bench, canon = Benchmark(), Canonicaliser()
        for item_id, text in rows:
            words = text.split()
            codes, named = canon.readings(words)
            hashes = window_hashes(codes, width)
            free = np.isin(codes, np.array(list(_CODES.values()), np.uint64), invert=True).astype(np.int64)
            n_free = np.convolve(free, np.ones(width, np.int64), "valid") if len(hashes) else np.empty(0, np.int64)
            usable = n_free > 0
            item = Item(item_id, words, codes, hashes, usable, len(np.unique(hashes[usable])), named)
            if not item.n_usable:
                plain = plain_words(words)
                if len(words) >= width:
                    bench.literal.append((plain, item_id))
                elif plain.strip():
                    bench.whole[plain].append(item_id)
                continue
            number = len(bench.items)
            bench.items.append(item)
            for pos in np.nonzero(usable)[0]:
                bench.places[int(hashes[pos])].append((number, int(pos)))
            for pos, h, names in zip(*named_windows(codes, named, width), strict=True):
                if n_free[pos] > names:
                    bench.places[int(h)].append((number, int(pos)))
        bench.places, bench.whole = dict(bench.places), dict(bench.whole)
        bench.sieve[[h >> 44 for h in bench.places]] = True
        return bench

    def _in_sieve(self, hashes: np.ndarray) -> np.ndarray:
        return np.nonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])[0]

    def match_all(self, texts: list[list[str]], canon: Canonicaliser, width: int, min_containment: float, min_consistency: float) -> list[list[tuple[int, float, str]]]:
        """(item_id, containment, kind) of each item whose template a text (a list of words) holds."""
        flat: list[str] = []
        starts = []
        for words in texts:
            starts.append(len(flat))
            flat += words
            flat.append(_BREAK)
        codes, named = canon.readings(flat)
        hashes = window_hashes(codes, width)
        at = self._in_sieve(hashes)
        found = list(zip(at.tolist(), hashes[at].tolist(), strict=True))
        places, read, _ = named_windows(codes, named, width)
        at = self._in_sieve(read)
        found += zip(places[at].tolist(), read[at].tolist(), strict=True)
        by_text: dict[int, list[tuple[int, int]]] = defaultdict(list)
        hit = [(a, h) for a, h in found if h in self.places]
        for (a, h), k in zip(hit, np.searchsorted(starts, [a for a, _ in hit], side="right").tolist(), strict=True):
            by_text[k - 1].append((a - starts[k - 1], h))
        out = []
        for k, words in enumerate(texts):
            got = self._aligned(words, codes[starts[k] : starts[k] + len(words)], by_text[k], width, min_containment, min_consistency) if k in by_text else []
            if self.literal or self.whole and len(words) < width:
                got = sorted({g[0]: g for g in [*self._plain(words, width), *got]}.values())
            out.append(got)
        return out

    def _plain(self, words: list[str], width: int) -> list[tuple[int, float, str]]:
        text = plain_words(words)
        found = [item_id for plain, item_id in self.literal if plain in text]
        if len(words) < width:
            found += self.whole.get(text, ())
        return [(item_id, 1.0, "verbatim") for item_id in found]

    def _aligned(self, words: list[str], codes: np.ndarray, found: list[tuple[int, int]], width: int, min_containment: float, min_consistency: float) -> list[tuple[int, float, str]]:
        covered: dict[int, set[int]] = defaultdict(set)
        for h in {h for _, h in found}:
            for number, pos in self.places[h]:
                covered[number].add(pos)
        enough = {number for number, at in covered.items() if len(at) >= min_containment * self.items[number].n_usable * 0.5}
        if not enough:
            return []
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, h in found:
            for number, pos in self.places[h]:
                if number in enough:
                    hits[number].append((at, pos))
        matched = []
        for number, places in hits.items():
            item, best = self.items[number], None
            for group in _alignments(places, len(item.words)):
                share = len({int(item.hashes[p]) for _, p in group}) / item.n_usable
                if share >= min_containment and (kind := _slots(item, words, codes, group, width, min_consistency)):
                    best = max(best or (0.0, ""), (share, kind))
            if best:
                matched.append((item.item_id, best[0], best[1]))
        best_of: dict[int, tuple[int, float, str]] = {}
        for m in matched:  # rows of the benchmark may share an id
            best_of[m[0]] = max(best_of.get(m[0], m), m)
        return sorted(best_of.values())


def _alignments(places: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
    """Groups of hits, each of which may be one copy of the item; a hit may be in several.

    Copies with other parameters may stand side by side, so hits are parted by diagonal at a few gaps: none, a
    few changed words, half an item and two items, for text put in between. For copies that have text in
    between and stand close, hits are also parted where the item starts over.
    """
    places = sorted(set(places), key=lambda x: (x[0] - x[1], x[0]))
    groups = []
    for gap in sorted({0, WINDOW, length // 2, 2 * length}):
        run = [places[0]]
        for here in places[1:]:
            if (here[0] - here[1]) - (run[-1][0] - run[-1][1]) > gap:
                groups.append(run)
                run = []
            run.append(here)
        groups.append(run)
    by_text: dict[int, list[int]] = defaultdict(list)
    for at, pos in places:
        by_text[at].append(pos)
    run = []
    for at in sorted(by_text):
        later = [pos for pos in by_text[at] if not run or pos > run[-1][1]]
        if not later:
            groups.append(run)
            run, later = [], by_text[at]
        run.append((at, min(later)))
    return list({tuple(g): g for g in [*groups, run]}.values())


def _slots(item: Item, words: list[str], codes: np.ndarray, group: list[tuple[int, int]], width: int, least: float) -> str:
    """``verbatim`` if all slots agree, ``reparameterised`` if each value maps to one value, else empty."""
    seen: dict[tuple[int, str], Counter] = defaultdict(Counter)
    openers: dict[str, Counter] = defaultdict(Counter)
    pairs = {(at + k, pos + k) for at, pos in group for k in range(width)}
    for at, pos in pairs:
        code, value, there = int(item.codes[pos]), _EDGE.sub("", item.words[pos]).lower(), _EDGE.sub("", words[at]).lower()
        if code in (_NUM, _NAME, _UNIT):
            seen[code, value][there] += 1
        elif len(item.named) and item.named[pos]:
            openers[value][there] += 1
    for value, there in openers.items():  # a name if it is one elsewhere, or if it changes; else a word
        if (_NAME, value) in seen or set(there) != {value}:
            seen[_NAME, value] += there
    total = sum(sum(c.values()) for c in seen.values())
    if not total:
        return "verbatim"
    if sum(max(c.values()) for c in seen.values()) < least * total:
        return ""
    return "verbatim" if all(set(c) == {value} for (_, value), c in seen.items()) else "reparameterised"


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about ``limit`` words, dealt by a hash; one is on the driver at a time."""
    rows = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_containment: float = MIN_CONTAINMENT, min_consistency: float = MIN_CONSISTENCY, block_words: int = BLOCK_WORDS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, contaminated, item_ids, containment, kind`` for every row of ``docs(doc_id, text, ...)``.

    Words lose case and outer punctuation; numbers, units after a number, and capitalised words inside a
    sentence become typed placeholders; one that opens a sentence is read both as a word and as a name. A document
    is contaminated by an item if a stretch of it holds at least ``min_containment`` of the item's distinct template
    windows of ``width`` words and the slots are consistent: each value of the item's slots meets one value there
    (all the same: ``verbatim``, else ``reparameterised``). An item of fewer than ``width`` words contaminates the
    documents that hold the same words and no others; a longer item of placeholders only, those that hold its words
    as they are. The benchmark is the stated query set: it is matched in blocks of bounded size against all
    documents, whose windows meet it in a hash table; documents are never shuffled for it. Null items match nothing;
    items that share an id are matched each for itself. Null and empty documents are clean. Repeated rows, and rows
    that share a doc_id, get answers of their own; equal texts get equal ones. ``item_ids`` is sorted. An empty
    benchmark leaves every row clean; an empty ``docs`` gives an empty result. Other columns are ignored.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        result = keyed_texts(docs).mapInArrow(_matcher(first, width, min_containment, min_consistency), _FOUND)
    else:
        rows, row = with_row_ids(docs)
        found = _each_block(keyed_texts(rows, row), first, second, blocks, _matcher, width, min_containment, min_consistency)
        kind = F.when(F.count_if(F.col("kind") == "verbatim") > 0, F.lit("verbatim")).otherwise(F.lit("reparameterised"))
        merged = found.groupBy(F.col("doc_id").alias(row)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("containment").alias("containment"), kind.alias("kind"))
        ids = rows.select(row, F.col("doc_id").cast("long").alias("doc_id"))
        result = ids.join(small(merged), row, "left").select("doc_id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("containment", F.lit(0.0)).alias("containment"), "kind")
    return result.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.round("containment", 6).alias("containment"), "kind")


_FOUND = "doc_id long, item_ids array<long>, containment double, kind string"


def _each_block(texts: DataFrame, first: list, second: list, more: Iterator[list], matcher, *limits) -> DataFrame:
    """What each block of the benchmark finds, in one pass over the documents after the other."""
    found = None
    for rows in (first, second, *more):
        hits = cut_lineage(texts.mapInArrow(matcher(rows, *limits), _FOUND).filter(F.size("item_ids") > 0))
        found = hits if found is None else found.unionByName(hits)
    return found


def _matcher(rows: list[tuple[int, str]], width: int, min_containment: float, min_consistency: float):
    def run(batches):
        bench, canon = Benchmark.of(rows, width), Canonicaliser()
        for ids, texts in text_slices(batches, STEP_BYTES):
            out = []
            for found in bench.match_all([t.decode().split() for t in texts], canon, width, min_containment, min_consistency):
                kinds = {k for _, _, k in found}
                out.append(([i for i, _, _ in found], max((s for _, s, _ in found), default=0.0), "verbatim" if "verbatim" in kinds else "reparameterised" if kinds else None))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.string())], names=["doc_id", "item_ids", "containment", "kind"])

    return run


def _is_clean(rows: list[tuple[int, str]], width: int, min_containment: float, min_consistency: float):
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bench, canon = Benchmark.of(rows, width), Canonicaliser()
        for part in parts:
            out = []
            texts = part.cast(pa.binary()).to_pylist()
            for _, some in sliced(texts, [t or b"" for t in texts], STEP_BYTES):
                out += [not f for f in bench.match_all([t.decode().split() for t in some], canon, width, min_containment, min_consistency)]
            yield pa.array(out, pa.bool_())

    return arrow_column(clean, "boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_containment: float = MIN_CONTAINMENT, min_consistency: float = MIN_CONSISTENCY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, that no benchmark item contaminates; see contamination().

    Rows are judged one by one by their text, so null texts stay, and equal texts and repeated rows stay or go
    together. An empty benchmark keeps all rows.
    """
    blocks = _blocks(benchmark, "item_id", "text", block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.filter(_is_clean(first, width, min_containment, min_consistency)(F.col("text")))
    rows, row = with_row_ids(docs)
    found = _each_block(keyed_texts(rows, row), first, second, blocks, _matcher, width, min_containment, min_consistency)
    return by_ids(rows, found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(*docs.columns)
