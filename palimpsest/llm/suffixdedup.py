"""Substring dedup with a sparse, range-partitioned suffix array.

Sorting every suffix of the corpus would move fifty times its bytes, so suffixes are taken where every
repeat must show. Of all positions of a window the one with the least hash of its next GRAM bytes is its
anchor; equal windows have their anchor at the same place, so whatever repeats over a whole window holds an
equal suffix at an anchor. Suffixes are ordered by their leading bytes and then by a hash of the rest.
Splitters sampled from the corpus cut that order into ranges; each bucket sorts its range by multikey
quicksort and compares neighbours. A suffix that occurs often is split by the hash, and equal suffixes never
fall to different sides of a splitter, so the comparison is complete across bucket boundaries.

1. Anchors' suffixes of GRAM bytes: which occur in two or more documents? (A sieve: chance equals do no harm.)
2. Of those, the context on both sides, which holds every window that has that anchor: the least document
   with the same context, and whether another context exists. With only one, the answer is known here.
3. Only where contexts differ: the windows themselves, and the least document that has each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import concat_bytes, keyed_texts, sliced
from palimpsest.llm.exchange import Chunk, Exchange, Replies, multikey_argsort, run_lengths, split_sorted
from palimpsest.llm.substrdedup import covered, runs

SPAN = 50
GRAM = 24
SLICE = 160 << 10
#: Bounds of the sample that splitters are taken from.
SPLITTER_TEXTS = 400
SPLITTER_CHARS = 20_000
#: Contexts of one suffix that a chunk tells apart; beyond, it asks about the windows.
MAX_CONTEXTS = 8

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW32 = np.uint64(0xFFFFFFFF)
_NO_DOC = np.int64(np.iinfo(np.int64).max)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def words_at(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian integers (a view; 7 positions fewer)."""
    return np.ndarray((max(0, len(flat) - 7),), "<u8", flat, strides=(1,)) if len(flat) >= 8 else np.empty(0, "<u8")


def span_hashes(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` (8 or more) bytes from each place on."""
    w = words_at(flat)
    h = np.full(len(at), length * int(_A) & (1 << 64) - 1, np.uint64)
    for k in (*range(0, length - 7, 8), *([length - 8] if length % 8 else [])):
        h = (h ^ w[at + k]) * _C
        h ^= h >> np.uint64(31)
    return _mix(h)


def leads(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first four bytes of each suffix as a number that sorts like them."""
    return words_at(flat)[at].astype("<u8").byteswap() >> np.uint64(32) if len(at) else np.empty(0, np.uint64)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    return np.minimum(v[: len(v) - (width - reach)], v[width - reach :]) if width > reach else v


def window_anchors(flat: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each window start, the position of its anchor; the first of equals."""
    w = words_at(flat)
    n = len(flat) - gram + 1
    h = w[:n] * _A
    for k in range(8, gram, 8):
        h ^= h >> np.uint64(32)
        h += w[k : k + n] * _C
    h ^= h >> np.uint64(29)
    h *= _D
    h &= ~_LOW32
    h |= np.arange(n, dtype=np.uint64)
    return (_sliding_min(h, span - gram + 1) & _LOW32).astype(np.int64)


class _Suffixes:
    """Anchors of all texts of a chunk, over one array of all bytes: where each stands and its windows."""

    def __init__(self, texts: list[bytes], span: int, gram: int):
        self.span, self.gram = span, gram
        self.flat, self.offsets = concat_bytes(texts)
        doc, anchor, first, last, at = [], [], [], [], 0
        for _, part in sliced(texts, texts, SLICE):
            flat, offsets = concat_bytes(part)
            lengths = np.diff(offsets)
            if len(flat) >= span:
                of_window = window_anchors(flat, span, gram)
                owner = np.repeat(np.arange(len(part)), lengths)[: len(of_window)]
                start = np.arange(len(of_window))
                inside = start + span <= offsets[owner + 1]
                start, of_window, owner = start[inside], of_window[inside], owner[inside]
                if len(start):
                    new = np.ones(len(start), bool)
                    new[1:] = (of_window[1:] != of_window[:-1]) | (owner[1:] != owner[:-1])
                    head = np.nonzero(new)[0]
                    tail = np.append(head[1:], len(start)) - 1
                    base = self.offsets[at]
                    doc.append(owner[head] + at)
                    anchor.append(of_window[head] + base)
                    first.append(start[head] + base)
                    last.append(start[tail] + base)
            at += len(part)
        empty = np.empty(0, np.int64)
        self.doc, self.anchor, self.first, self.last = (np.concatenate(x) if x else empty for x in (doc, anchor, first, last))
        self.lead = leads(self.flat, self.anchor)
        self.rest = span_hashes(self.flat, self.anchor, gram) if len(self.anchor) else np.empty(0, np.uint64)
        order = multikey_argsort(self.lead, self.rest)
        self.group = np.empty(len(order), np.int64)
        ranked = run_lengths(self.lead[order], self.rest[order])
        self.group[order] = ranked
        head = order[np.searchsorted(ranked, np.arange(ranked[-1] + 1 if len(ranked) else 0))]
        self.keys = (self.lead[head], self.rest[head])

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Hash of all that the windows of an anchor hold: how many windows, how they lie, and their bytes."""
        first, stop, anchor = self.first[which], self.last[which] + self.span, self.anchor[which]
        w, h = words_at(self.flat), (stop - first).astype(np.uint64) * _A ^ (anchor - first).astype(np.uint64) * _D
        size = stop - first
        for k in range(0, int(size.max()) if len(size) else 0, 8):
            more = k + 8 <= size
            h[more] = (h[more] ^ w[first[more] + k]) * _C
            h[more] ^= h[more] >> np.uint64(31)
        if len(size):
            h = (h ^ w[stop - 8]) * _C
        return _mix(h)


def _place(lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Where a suffix stands in the order: four leading bytes, then half of the hash of the rest."""
    return (lead << np.uint64(32)) | (rest >> np.uint64(32))


def splitters(docs: DataFrame, n_buckets: int, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """n_buckets - 1 places that cut the anchors' suffixes of a bounded sample of texts into equal parts."""
    texts = keyed_texts(docs).filter(F.octet_length("text") >= span)
    total = texts.count()
    if not total or n_buckets < 2:
        return np.empty(0, np.uint64)
    pick = F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1 << 30)) < min(1.0, SPLITTER_TEXTS / total) * (1 << 30)
    sample = [r[0].encode() for r in texts.filter(pick).select(F.substring("text", 1, SPLITTER_CHARS)).limit(2 * SPLITTER_TEXTS).collect()]
    s = _Suffixes(sample, span, gram)
    places = np.sort(_place(*s.keys))
    if not len(places):
        return np.empty(0, np.uint64)
    return places[np.arange(1, n_buckets) * len(places) // n_buckets]


def _split(cuts: np.ndarray, lead: np.ndarray, rest: np.ndarray, n_buckets: int) -> list[tuple[int, slice]]:
    return split_sorted(np.searchsorted(cuts, _place(lead, rest), side="right"), n_buckets)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns one after the other: runs of equal leads then take little room once compressed. Truth values
    take a bit each, and ids (signed) four bytes each where they lie close enough together."""
    out = [np.uint32(len(columns[0])).tobytes()]
    for c in columns:
        if c.dtype == bool:
            out.append(np.packbits(c).tobytes())
        elif c.dtype == np.int64:
            base = c.min() if len(c) else np.int64(0)
            near = not len(c) or int(c.max()) - int(base) < 1 << 32
            out += [np.uint8(near).tobytes(), np.int64(base).tobytes(), (c - base).astype(np.uint32).tobytes() if near else c.tobytes()]
        else:
            out.append(c.tobytes())
    return b"".join(out)


def _unpack(body: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.uint32, 1)[0]), 4, []
    for t in types:
        if t == "?":
            size = (n + 7) // 8
            out.append(np.unpackbits(np.frombuffer(body, np.uint8, size, at), count=n).astype(bool))
        elif t == "i8":
            near, base = body[at], np.frombuffer(body, np.int64, 1, at + 1)[0]
            at, size = at + 9, n * (4 if near else 8)
            out.append(np.frombuffer(body, np.uint32, n, at).astype(np.int64) + base if near else np.frombuffer(body, np.int64, n, at))
        else:
            size = n * np.dtype(t).itemsize
            out.append(np.frombuffer(body, t, n, at))
        at += size
    return out


def _gathered(bodies: list[bytes], *types: str) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [_unpack(b, *types) for b in bodies]
    sizes = np.array([len(p[0]) for p in parts])
    return np.cumsum(sizes)[:-1], [np.concatenate([p[k] for p in parts]) for k in range(len(types))]


def _pack_lower(own: np.ndarray, low: np.ndarray, *flags: np.ndarray) -> bytes:
    """Ids only where they are lower than those asked with, which the asker knows."""
    lower = low < own
    head = _pack(lower, *flags)
    return np.uint32(len(head)).tobytes() + head + _pack(low[lower])


def _unpack_lower(body: bytes, own: np.ndarray, flags: int = 0) -> list[np.ndarray]:
    size = int(np.frombuffer(body, np.uint32, 1)[0]) + 4
    lower, *rest = _unpack(body[4:size], *"?" * (1 + flags))
    low = own.copy()
    low[lower] = _unpack(body[size:], "i8")[0]
    return [low, *rest]


def _short(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 48 bits of a hash: enough where a chance equal only means one more question."""
    return (rest >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(16)).astype(np.uint16)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(16) | low


class _Rounds:
    """The three questions; each rebuilds the chunk's suffixes and takes from its notes what is known."""

    def __init__(self, span: int, gram: int, cuts: np.ndarray, n_buckets: int):
        self.span, self.gram, self.cuts, self.n_buckets = span, gram, cuts, n_buckets

    # -- 1: suffixes in two or more documents

    def sieve(self, chunk: Chunk, _: Replies) -> dict[int, bytes]:
        s = _Suffixes(chunk.texts, self.span, self.gram)
        lead, rest = s.keys
        several = self._several(s, chunk)
        return {b: _pack(lead[x].astype(np.uint32), *_short(rest[x]), several[x]) for b, x in _split(self.cuts, lead, rest, self.n_buckets)}

    @staticmethod
    def _several(s: _Suffixes, chunk: Chunk) -> np.ndarray:
        """Per distinct suffix: whether documents of different ids in this chunk have it."""
        n = len(s.keys[0])
        ids = chunk.ids[s.doc]
        low, high = np.full(n, _NO_DOC), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, s.group, ids)
        np.maximum.at(high, s.group, ids)
        return low != high

    @staticmethod
    def answer_sieve(bodies: list[bytes]) -> list[bytes]:
        cuts, (lead, high, low, several) = _gathered(bodies, "u4", "u4", "u2", "?")
        rest = _joined(high, low)
        order = multikey_argsort(lead, rest)
        group = run_lengths(lead[order], rest[order])
        weight = np.bincount(group, weights=1.0 + several[order])
        found = np.empty(len(order), bool)
        found[order] = weight[group] > 1
        return [np.packbits(x).tobytes() for x in np.split(found, cuts)]

    def _candidates(self, s: _Suffixes, bits: dict[int, bytes]) -> np.ndarray:
        """Anchors whose suffix the sieve let through."""
        lead, rest = s.keys
        parts = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=x.stop - x.start) for b, x in _split(self.cuts, lead, rest, self.n_buckets)]
        passed = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
        return np.nonzero(passed[s.group])[0]

    # -- 2: contexts of those suffixes

    def _contexts(self, chunk: Chunk, bits: dict[int, bytes]):
        """Sorted distinct (suffix, context) of the candidates with the least document of each; and whether a
        suffix has too many contexts here, in which case one row without context stands for them."""
        s = _Suffixes(chunk.texts, self.span, self.gram)
        which = self._candidates(s, bits)
        context = s.contexts(which)
        group = s.group[which]
        order = np.lexsort((chunk.ids[s.doc[which]], context, group))
        pair = run_lengths(group[order], context[order])
        head = order[np.searchsorted(pair, np.arange(pair[-1] + 1 if len(pair) else 0))]
        of_group, of_pair = group[head], context[head]
        many = np.bincount(of_group, minlength=1)[of_group] > MAX_CONTEXTS if len(head) else np.zeros(0, bool)
        pair_of = np.empty(len(which), np.int64)
        pair_of[order] = pair
        return s, which, pair_of, of_group, of_pair, chunk.ids[s.doc[which[head]]], many

    def contexts(self, chunk: Chunk, replies: Replies) -> dict[int, bytes]:
        s, _, _, of_group, of_pair, least, many = self._contexts(chunk, replies)
        asked = {}
        keep = ~many
        first = np.zeros(len(many), bool)
        if len(many):
            first[:] = many & np.append(True, of_group[1:] != of_group[:-1])
        rows = keep | first
        group, context, least = of_group[rows], np.where(keep, of_pair, 0)[rows], least[rows]
        lead, rest = s.keys[0][group], s.keys[1][group]
        for b, x in _split(self.cuts, lead, rest, self.n_buckets):
            asked[b] = _pack(lead[x].astype(np.uint32), *_short(rest[x]), context[x], least[x], many[rows][x])
        return asked | _notes(replies, 1)

    @staticmethod
    def answer_contexts(bodies: list[bytes]) -> list[bytes]:
        """For each (suffix, context): its least document, and whether the suffix has other contexts."""
        cuts, (lead, high, low, context, least, many) = _gathered(bodies, "u4", "u4", "u2", "u8", "i8", "?")
        rest = _joined(high, low)
        order = multikey_argsort(lead, rest, context)
        suffix = run_lengths(lead[order], rest[order])
        pair = run_lengths(suffix, context[order])
        low = np.full(pair[-1] + 1, _NO_DOC)
        np.minimum.at(low, pair, least[order])
        heads = np.searchsorted(pair, np.arange(pair[-1] + 1))
        n_contexts = np.bincount(suffix[heads])
        marked = np.bincount(suffix, weights=many[order]) > 0
        mixed = np.empty(len(order), bool)
        mixed[order] = ((n_contexts > 1) | marked)[suffix]
        out = np.empty(len(order), np.int64)
        out[order] = low[pair]
        return [_pack_lower(*x) for x in zip(*(np.split(c, cuts) for c in (least, out, mixed)), strict=True)]

    def _resolved(self, chunk: Chunk, replies: Replies):
        """After round 2: per candidate anchor the least document of its context (or none known), and whether
        its windows have to be asked about."""
        s, which, pair_of, of_group, of_pair, least, many = self._contexts(chunk, _noted(replies, 1))
        keep = ~many
        first = many & np.append(True, of_group[1:] != of_group[:-1]) if len(many) else many
        rows = np.nonzero(keep | first)[0]
        group = of_group[rows]
        lead, rest = s.keys[0][group], s.keys[1][group]
        own = replies if self._own(replies) else _noted(replies, 2)
        low, mixed = np.full(len(many), _NO_DOC), np.ones(len(many), bool)
        asked = least[rows]
        parts = [_unpack_lower(own[b], asked[x], 1) for b, x in _split(self.cuts, lead, rest, self.n_buckets)]
        if parts:
            low[rows], mixed[rows] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        low[many], mixed[many] = _NO_DOC, True
        ids = chunk.ids[s.doc[which]]
        low, mixed = low[pair_of], mixed[pair_of]
        return s, which, ids, low, mixed & (ids <= low)

    @staticmethod
    def _own(replies: Replies) -> bool:
        return not any(b <= -(2 << 24) and b > -(3 << 24) for b in replies)

    # -- 3: windows where contexts differ

    def _open_windows(self, s: _Suffixes, which: np.ndarray, open_: np.ndarray):
        """(window start, its document) for each window of the open anchors."""
        a = which[open_]
        counts = s.last[a] - s.first[a] + 1
        start = np.repeat(s.first[a] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(a) else np.empty(0, np.int64)
        return start, np.repeat(s.doc[a], counts)

    def _window_keys(self, s: _Suffixes, start: np.ndarray, ids: np.ndarray):
        lead = leads(s.flat, start)
        rest = span_hashes(s.flat, start, self.span) if len(start) else np.empty(0, np.uint64)
        order = multikey_argsort(lead, rest)
        ranked = run_lengths(lead[order], rest[order])
        group = np.empty(len(order), np.int64)
        group[order] = ranked
        n = ranked[-1] + 1 if len(ranked) else 0
        head = order[np.searchsorted(ranked, np.arange(n))]
        least = np.full(n, _NO_DOC)
        np.minimum.at(least, group, ids)
        return lead[head], rest[head], least, group

    def windows(self, chunk: Chunk, replies: Replies) -> dict[int, bytes]:
        s, which, _, _, open_ = self._resolved(chunk, replies)
        start, doc = self._open_windows(s, which, open_)
        lead, rest, least, _ = self._window_keys(s, start, chunk.ids[doc])
        asked = {b: _pack(lead[x].astype(np.uint32), rest[x], least[x]) for b, x in _split(self.cuts, lead, rest, self.n_buckets)}
        return asked | _notes(replies, 2)

    @staticmethod
    def answer_windows(bodies: list[bytes]) -> list[bytes]:
        cuts, (lead, rest, least) = _gathered(bodies, "u4", "u8", "i8")
        order = multikey_argsort(lead, rest)
        group = run_lengths(lead[order], rest[order])
        low = np.full(group[-1] + 1, _NO_DOC)
        np.minimum.at(low, group, least[order])
        out = np.empty(len(order), np.int64)
        out[order] = low[group]
        return [_pack_lower(*x) for x in zip(np.split(least, cuts), np.split(out, cuts), strict=True)]

    def removed(self, chunk: Chunk, replies: Replies) -> tuple[_Suffixes, np.ndarray]:
        """Over all bytes of the chunk: 1 at each start of a window that a smaller document has too."""
        s, which, ids, low, open_ = self._resolved(chunk, {b: x for b, x in replies.items() if b < 0})
        flags = np.zeros(len(s.flat) + 1, bool)
        whole = np.ones(len(which), bool)
        start, _ = self._open_windows(s, which, whole & (low < ids))
        flags[start] = True
        start, doc = self._open_windows(s, which, open_)
        lead, rest, asked, group = self._window_keys(s, start, chunk.ids[doc])
        parts = [_unpack_lower(replies[b], asked[x])[0] for b, x in _split(self.cuts, lead, rest, self.n_buckets)]
        if parts:
            least = np.concatenate(parts)[group]
            flags[start[least < chunk.ids[doc]]] = True
        return s, flags


def _notes(replies: Replies, depth: int) -> dict[int, bytes]:
    """What a chunk heard in round ``depth``, and its earlier notes, under keys below zero."""
    return {(b if b < 0 else -(depth << 24) - b): x for b, x in replies.items()}


def _noted(replies: Replies, depth: int) -> dict[int, bytes]:
    found = {-b - (depth << 24): x for b, x in replies.items() if b <= -(depth << 24) and b > -((depth + 1) << 24)}
    return found if found or depth > 1 else replies


def repeated_substrings(docs: DataFrame, span: int = SPAN, gram: int = GRAM, chunk_bytes: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256`` (and ``kept``) for every row.

    Texts are UTF-8 bytes. A byte is removed if a string of ``span`` bytes over it also starts in a document
    with a smaller doc_id; strings overlap, are judged on the input, and never cross documents. ``spans`` are
    the maximal removed runs (start, stop) in bytes. Null and empty texts, and texts shorter than ``span``,
    keep all. Rows with one doc_id do not remove each other; a null doc_id counts as one that is less than all others. Suffixes, contexts and windows are compared by
    four leading bytes and a 64-bit hash of the rest. An empty table gives an empty result. Columns other
    than doc_id and text are ignored. ``kept`` is binary, as a cut may fall inside a character.
    """
    if span < gram or gram < 8 or gram % 8:
        raise ValueError("gram must be a multiple of 8 and no longer than span")
    ex = Exchange(docs, chunk_bytes) if chunk_bytes else Exchange(docs)
    rounds = _Rounds(span, gram, splitters(docs, ex.n_buckets, span, gram), ex.n_buckets)

    def conclude(chunk: Chunk, replies: Replies) -> pa.Table:
        s, flags = rounds.removed(chunk, replies)
        out = []
        for k, text in enumerate(chunk.texts):
            at = s.offsets[k]
            mask = covered(flags[at : at + max(0, len(text) - span + 1)], len(text), span)
            spans, kept, last = runs(mask), [], 0
            for a, b in spans:
                kept.append(text[last:a])
                last = b
            kept = b"".join([*kept, text[last:]])
            out.append((len(text), int(mask.sum()), len(spans), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"][: 6 + with_text]
        return pa.table([chunk.shown, *(pa.array([o[k] for o in out], types[k]) for k in range(len(names) - 1))], names=names)

    heard = ex.answer(ex.ask(rounds.sieve), rounds.answer_sieve)
    heard = ex.answer(ex.ask(rounds.contexts, heard), rounds.answer_contexts)
    heard = ex.answer(ex.ask(rounds.windows, heard), rounds.answer_windows)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept_sha256 string" + ", kept binary" * with_text
    return ex.finish(heard, conclude, schema)
