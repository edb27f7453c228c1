import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from palimpsest.llm.common import connected_components
from palimpsest.llm.exactdedup import exact_duplicates, keep_last_copies
from palimpsest.llm.shingles import SMALL_SET, _across, _sketches, keep_one_of_each, prefix, shingle_sets, similar_pairs
from palimpsest.llm.simhash import decode, fingerprint, near_duplicates, near_pairs, nearby_codewords, shingle_hashes
from palimpsest.llm.substrdedup import repeated_windows
from palimpsest.llm.suffixdedup import repeated_substrings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_exact(docs, rows, no_docs):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    got = {r.doc_id: r for r in exact_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = keep_last_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {max(ids) for ids in groups.values()}
    assert exact_duplicates(no_docs).count() == 0


def brute_fingerprint(text, width=3):
    words = WORD.findall((text or "").translate(LOWER).encode())
    if not words:
        return 0
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, no_docs):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    assert all(fingerprint(shingle_hashes((r[1] or "").encode(), 3)) == prints[r[0]] for r in rows)
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fingerprint == f"{prints[i]:016x}" for i, r in got.items())
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_no_link_is_lost_whatever_the_bucket_limit(spark, limit):
    """Clouds around few centres: large buckets, links of 0, 1 and 2 bits, and pairs that only look near."""
    rng = random.Random(limit)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_pairs(spark.createDataFrame([(s,) for s in signed], "fp long"), limit).collect()
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    want = components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = connected_components(spark.createDataFrame([(s,) for s in signed], "node long"), spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_golay_words_at_two_bits_share_a_codeword():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(23)
        b = a ^ sum(1 << k for k in rng.sample(range(23), rng.randint(0, 2)))
        _, x = nearby_codewords(np.array([a]))
        _, y = nearby_codewords(np.array([b]))
        assert set(x.tolist()) & set(y.tolist()) and len(x) in (1, 6)
    nearest = np.bincount(decode(np.arange(1 << 23)), minlength=1 << 12)
    assert len(nearest) == 1 << 12 and set(nearest.tolist()) == {1 << 11}  # a perfect code


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(120)] + [(ids[150], ids[k]) for k in range(151, 190)] + [(7, 7)]
    got = connected_components(spark.createDataFrame([(i,) for i in ids], "node long"), spark.createDataFrame(edges, "u long, v long"))
    want = components(sorted(ids), lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    assert {r.node: r.component for r in got.collect()} == want


@pytest.mark.parametrize("width,chunk", [(35, 3 << 20), (5, 2000)])
def test_repeated_windows(docs, rows, no_docs, width, chunk):
    words = {r[0]: WORD.findall((r[1] or "").encode()) for r in rows}
    seen = Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    got = {r.doc_id: r for r in repeated_windows(docs, width, chunk_bytes=chunk, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
        assert got[i].kept == kept.decode() and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert sum(s.stop - s.start for s in got[i].spans) == sum(gone)
    assert repeated_windows(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [3 << 20, 1500])
def test_repeated_substrings(docs, rows, no_docs, chunk):
    span, seen, texts = 50, set(), sorted((r[0], (r[1] or "").encode()) for r in rows)
    got = {r.doc_id: r for r in repeated_substrings(docs, span, chunk_bytes=chunk, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, text in texts:
        gone = bytearray(len(text))
        windows = [text[k : k + span] for k in range(len(text) - span + 1)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + span] = b"\1" * span
        seen.update(windows)
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(text), sum(gone), len(re.findall(rb"\x01+", bytes(gone))))
        assert bytes(got[i].kept) == kept and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert repeated_substrings(no_docs).count() == 0


def test_substrings_of_many_contexts(spark):
    """One passage, whole or in part, between ever other neighbours, so that contexts differ and windows decide."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(150))
    rows = []
    for i in range(80):
        a, b = sorted((rng.randint(0, 60), rng.randint(90, 150)))
        left, right = ("".join(rng.choice("ghijk ") for _ in range(rng.randint(0, 70))) for _ in range(2))
        rows.append((i, left + passage[a:b] + right))
    got = {r.doc_id: r for r in repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=2500).collect()}
    seen = set()
    for i, text in rows:
        gone = [False] * len(text)
        for k in range(len(text) - 49):
            if text[k : k + 50] in seen:
                gone[k : k + 50] = [True] * 50
        seen.update(text[k : k + 50] for k in range(len(text) - 49))
        assert got[i].n_removed == sum(gone)


def test_similar_pairs(spark, docs, rows, no_docs):
    """Families of edited copies against all pairs; the groups are whole, and no pair is false."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts = {}
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 150))]
        for _ in range(rng.choice([1, 2, 3, 5, 14])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = f"{' '.join(copy)}"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: set(shingle_sets([t.encode()], 5)[0].tolist()) for i, t in texts.items()}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.u, r.v) for r in similar_pairs(frame).collect()}
    assert got <= true and len(true) > 20
    link = lambda pairs: components(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert link(got) == link(true)
    near = {i: brute_fingerprint(t) for i, t in texts.items()}
    both = true | {(a, b) for a in near for b in near if a < b and (near[a] ^ near[b]).bit_count() <= 2}
    assert {r.doc_id for r in keep_one_of_each(frame).collect()} == set(link(both).values())
    assert keep_one_of_each(docs).columns == docs.columns and keep_one_of_each(no_docs).count() == 0


def test_no_similar_pair_is_lost_where_many_texts_share_a_shingle(spark):
    """All texts hold one long passage and three of twenty shorter ones; those that share two of these are similar."""
    rng = random.Random(8)
    made = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    block, parts = made(304), [made(30) for _ in range(20)]
    texts = {k: " ".join([block, *(parts[p] for p in sorted(rng.sample(range(20), 3)))]) for k in range(80)}
    texts[40] += " " + made(500)
    sets = {i: set(shingle_sets([t.encode()], 5)[0].tolist()) for i, t in texts.items()}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.u, r.v) for r in similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    link = lambda pairs: components(sorted(texts), lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert len(true) > 50 and got <= true and link(got) == link(true)


def test_prefix_puts_common_shingles_last():
    import numpy as np

    h = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], np.uint64)
    assert prefix(h, 0.8, np.empty(0, np.uint64)).tolist() == [1, 2, 3]
    assert prefix(h, 0.8, np.array([1, 3, 99], np.uint64)).tolist() == [2, 4, 5]
    assert prefix(h[:1], 0.8, h).tolist() == [1] and not len(prefix(h[:0], 0.8, h))


ODD = [(1, "same", "a"), (1, "only here", "b"), (9, "SAME", "c"), (9, "same", "d"), (9, "same", "d"), (None, "same", "e"), (None, "two words", "f"), (None, "two words", "g"), (4, None, "h"), (3, "", "i")]


def test_rows_that_share_an_id_are_told_apart(spark):
    """Of equal texts one row stays, whatever other rows its id has; no text is lost with a copy of another."""
    from palimpsest.llm.exactdedup import keep_last_copies
    from palimpsest.llm.simhash import keep_one_of_each as keep_by_fingerprint

    frame = spark.createDataFrame(ODD, "doc_id long, text string, n string")
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in keep_last_copies(frame.filter("doc_id IS NOT NULL")).collect())
    assert kept == [(1, "only here"), (4, ""), (9, "same")]
    kept = sorted((str(r.doc_id), (r.text or "").lower()) for r in keep_last_copies(frame).collect())
    assert kept == [("1", "only here"), ("4", ""), ("9", "same"), ("None", "two words")]
    for keep in (keep_by_fingerprint, keep_one_of_each):
        kept = sorted((r.text or "").lower() for r in keep(frame).collect())
        assert kept == ["", "only here", "same", "two words"]


def test_large_key_sets_are_joined_by_shuffle(spark, docs, monkeypatch):
    from palimpsest.llm import common
    from palimpsest.llm.exactdedup import keep_last_copies

    few = sorted(r.doc_id for r in keep_last_copies(docs).collect())
    groups = sorted(map(tuple, exact_duplicates(docs).collect()))
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", 0)
    assert sorted(r.doc_id for r in keep_last_copies(docs).collect()) == few
    assert sorted(map(tuple, exact_duplicates(docs).collect())) == groups


def test_shingles_do_not_depend_on_the_slice(monkeypatch):
    import numpy as np

    from palimpsest.llm import shingles

    rng = random.Random(4)
    texts = ["", "a", "A b", " ".join(rng.choice(["x", "Yy", "zzz", "w" * 90]) for _ in range(300)), "\t one\ntwo three  four five\x0bsix ", "é ü ß"]
    whole = shingle_sets([t.encode() for t in texts], 5)
    assert [len(s) for s in whole[:3]] == [0, 1, 1] and len(whole[4]) == 2
    alone = [shingle_sets([t.lower().encode()], 5)[0] for t in texts]
    monkeypatch.setattr(shingles, "STEP_BYTES", 64)
    small = shingle_sets([t.encode() for t in texts], 5)
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(whole, alone, small, strict=True))


def test_texts_of_the_largest_component_are_not_dealt_against_one_another(spark, monkeypatch):
    """Work of a large group is its size times what lies outside its largest component; no link across is lost."""
    base = [f"w{k}" for k in range(60)]
    texts = {k: " ".join([*base, *(f"a{k}" for _ in range(2))]) for k in range(60)}  # one component
    texts |= {100 + k: " ".join([*base, *(f"b{k}x{j}" for j in range(3))]) for k in range(4)}  # similar to it, each apart
    texts |= {200 + k: " ".join(f"c{k}x{j}" for j in range(60)) for k in range(3)}  # like nothing
    frame = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "doc_id long, text binary")
    rows = spark.createDataFrame([(7, k, len(texts), 0 if k < 100 else k) for k in texts], "key long, id long, size int, component long")
    dealt = []
    join = type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, *a, **kw: dealt.append(self) or join(self, *a, **kw))
    found = _across(rows, _sketches(frame, 5), 0.8, 8)
    monkeypatch.undo()
    pairs = {(r.a, r.b) for r in found.filter("sure").collect()}
    assert {b for _, b in pairs} == {100, 101, 102, 103} and all(a < b and b >= 100 for a, b in pairs) and max(len(t.split()) for t in texts.values()) <= SMALL_SET
    assert dealt[-1].count() == 60 * 1 + 7 * 9  # rows that meet: 8 blocks of the largest component, one of the others


def test_shingles_that_the_sample_misses_leave_the_prefixes(spark, monkeypatch):
    """A line in thirty texts that are otherwise their own: none of its shingles stays in many prefixes."""
    from palimpsest.llm import shingles

    monkeypatch.setattr(shingles, "SAMPLE_ROWS", 0)
    line = " ".join(f"line{k}" for k in range(12))
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40)) + " " + line) for i in range(30)], "doc_id long, text string")
    keys = [k for r in shingles._prefixes(texts, 5, 0.8, 8).collect() for k in r["keys"]]
    assert len(keys) == 30 * 10 and max(Counter(keys).values()) <= 8


def test_frequent_keys_beyond_the_limit_are_the_most_frequent(spark):
    from palimpsest.llm.shingles import _frequent

    counts = spark.createDataFrame([(-1, 9), (5, 30), (7, 12), (8, 9)], "key long, n long")
    assert _frequent(counts).view(np.int64).tolist() == [5, 7, 8, -1]
    assert _frequent(counts, 3).view(np.int64).tolist() == [5, 7]
    assert _frequent(counts, 0).tolist() == [] and _frequent(counts.limit(0)).tolist() == []


def test_families_meet_once(spark):
    """Twenty texts under ten keys, each without one of them, are one group; a chain of pairs stays key by key."""
    from palimpsest.llm.shingles import _families

    family = [(k, i, i) for k in range(10) for i in range(20) if i != k]
    chain = [(100 + i, j, j) for i in range(1000, 1010) for j in (i, i + 1)]
    rows = spark.createDataFrame(family + chain, "key long, id long, component long")
    got = defaultdict(list)
    for r in _families(rows).collect():
        assert r.id == r.component
        got[r.key].append(r.id)
    assert sorted(map(sorted, got.values())) == [list(range(20)), *[[i, i + 1] for i in range(1000, 1010)]]
