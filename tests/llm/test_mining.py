"""Clustering, phrases and licences against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm.centroids import build, cluster, distances, filtered, whole_numbers
from palimpsest.llm.licences import BASE, NOTICES, scan_licences
from palimpsest.llm.phrases import collocations, possible, scored

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, tree binary"


def plain_clusters(rows, k=16, rounds=3, scale=64, seed=1, width=64):
    """Lloyd's rounds in Python integers."""
    from fractions import Fraction

    kept = [(i, [(Fraction(x) * scale).__floor__() for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [p for _, p in sorted(kept, key=key)[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    nearest = lambda p: min(range(len(centres)), key=lambda c: (far(p, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(nearest(p), []).append(p)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else old for c, old in enumerate(centres)]
    found = [(i, c := nearest(p), far(p, centres[c])) for i, p in kept]
    inertia = {c: sum(d for _, e, d in found if e == c) for c in range(len(centres))}
    fit = lambda x: x if x < 1 << 63 else None
    whole = lambda c: fit(inertia[c]) if all(d < 1 << 63 for _, e, d in found if e == c) else None
    every = fit(sum(inertia.values())) if all(d < 1 << 63 for _, _, d in found) else None
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, fit(d), whole(c), every, text[c]) for i, c, d in found), key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(rng, n, width=64, blobs=5):
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(blobs)]
    return [[x + rng.gauss(0, 0.02) for x in rng.choice(centres)] for _ in range(n)]


def test_clusters(spark):
    rng = random.Random(8)
    made = vectors(rng, 240)
    rows = list(enumerate(made)) + [(1000 + k, made[3]) for k in range(90)] + [(7, made[7])] * 3 + [(None, made[0]), (None, made[9])]
    rows += [(500, None), (501, []), (502, made[0][:63]), (503, made[0] + [0.0]), (504, [None, *made[0][1:]]), (505, [float("nan"), *made[0][1:]]), (506, [float("-inf"), *made[0][1:]])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, v, 1, "x", b"") for i, v in rows], VECTORS).repartition(3)
    want = plain_clusters(rows)
    assert shown(cluster(frame)) == want
    assert shown(cluster(frame, tree_vectors=40, leaf_vectors=3)) == want
    assert shown(cluster(frame.withColumn("embedding", frame.embedding.cast("array<float>")))) == plain_clusters([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows])


def test_clusters_small_and_wide(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and cluster(none).count() == 0
    rng = random.Random(9)
    few = list(enumerate(vectors(rng, 5, 3)))
    assert shown(cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"), dimensions=3)) == plain_clusters(few, width=3)
    for size in (1e6, 1e9, 1e35, 1e300):
        wide = [(k, [x * size for x in v]) for k, v in enumerate(vectors(rng, 60, 4))] + [(100 + k, [0.25, -0.5, 1.0, 0.0]) for k in range(5)]
        frame = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
        assert shown(cluster(frame, k=6, dimensions=4, tree_vectors=16, leaf_vectors=2)) == plain_clusters(wide, k=6, width=4)


@pytest.mark.parametrize("leaf", [1, 8])
def test_filter_gives_whole_balls(leaf):
    """Tight groups go to their centroid as balls, ties to the smaller number; nothing is left out or told twice."""
    rng = random.Random(4)
    points = whole_numbers(np.array(vectors(rng, 300, 8) + [[0.5] * 8] * 50), 64)
    tree = build(list(range(len(points))), points, leaf)
    centroids = np.concatenate([points[:6], points[:2]])
    whole, rest, labels = filtered(tree, centroids)
    assert whole and sorted(rest.tolist() + [k for n, _ in whole for k in range(tree.lo[n], tree.hi[n])]) == list(range(len(points)))
    want = distances(tree.points, centroids).argmin(1)
    assert (want[rest] == labels).all() and all((want[tree.lo[n] : tree.hi[n]] == c).all() for n, c in whole)
    assert all((tree.sums[n] == tree.points[tree.lo[n] : tree.hi[n]].sum(0)).all() for n in range(len(tree.lo)))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_licences(rows, templates, rare=6, least=0.6):
    """Every template tried at every place of every text."""
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in rows]
    vocabulary = {w for t in templates for w in t.text.split()}
    idf = {w: 1 + math.log((len(rows) + 1) / (sum(w in set(x) for x in texts) + 1)) for w in vocabulary}
    out = []
    for (i, _), words in zip(rows, texts, strict=True):
        places, shares, labels, based = [], [0.0], set(), set()
        for t in templates:
            model = t.text.split()
            chosen = set(sorted(set(model), key=lambda w: (-idf[w], w))[:rare])
            total = sum(idf[w] for w in model if w in chosen)
            for at in range(-len(model), len(words)):
                stands = lambda k, w: 0 <= at + k < len(words) and words[at + k] == w  # noqa: B023, E731
                share = sum(idf[w] for k, w in enumerate(model) if w in chosen and stands(k, w)) / total
                whole = True
                for phrase in t.phrases:
                    own = phrase.split()
                    begin = next(k for k in range(len(model)) if model[k : k + len(own)] == own)
                    whole = whole and all(stands(begin + k, w) for k, w in enumerate(own))
                if whole and round(share, 9) >= least:
                    shares.append(min(1.0, share))
                    labels.add(t.label)
                    if t.base:
                        based.add(t.label)
                        places.append(at)
        out.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(based)), ",".join(sorted(labels)), round(max(shares), 6)))
    return sorted(out, key=repr)


def licence_rows(rows):
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["stone", "of", "the", "by", "license", "mit", "general", "Public", "gnu", "cc", "4", "x9"]) for _ in range(n))
    found = [(r[0], r[1]) for r in rows] + [(None, "MIT License"), (None, None), (3, "Apache-License"), (3, "Apache-License"), (5, "the MIT\nlicense, apache  LICENSE; GNU General Public_License")]
    found += [(1000 + k, f"{noise(20)} {t.text} {noise(20)}") for k, t in enumerate((*BASE, *NOTICES))]
    found += [(1100 + k, f"{noise(9)} {t.text.replace(' the ', ' this very ').title()}") for k, t in enumerate(NOTICES)]
    found += [(1200 + k, noise(400)) for k in range(6)]
    found += [(1300, "Licensed under CC BY-NC 4.0."), (1301, "mit license " * 1500), (1302, ("x " * 1022 + "general public license ") * 3), (1303, "ü" * 5000 + " mit licenſe"), (1304, "mit licenses"), (1305, "permission"), (1306, "mit " * 3000 + "license")]
    return found


def test_licences(spark, rows, no_docs):
    found = licence_rows(rows)
    frame = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in found], "doc_id long, text string, labels string, row long, word string").repartition(3)
    got = shown(scan_licences(frame))
    assert got == plain_licences(found, (*BASE, *NOTICES))
    told = {r[0]: r for r in got}
    assert told[1300][6] == "cc-by-nc" and told[1301][2:5] == (1500, 0, 2998) and told[1302][2] == 3 and told[1306][2:5] == (1, 2999, 2999)
    assert scan_licences(no_docs).count() == 0
    assert "Python" not in (plan := scan_licences(frame)._jdf.queryExecution().toString()) and "ArrowEval" not in plan
    few = shown(scan_licences(frame, rare=2, least=0.3))
    assert few == plain_licences(found, (*BASE, *NOTICES), 2, 0.3)


def plain_collocations(rows, max_words=3, least=10, top=2000, shadow=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    held = Counter()
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for k in range(len(words) - m + 1):
                held[lang, words[k : k + m]] = max(held[lang, words[k : k + m]], a)
    out = {}
    for (lang, words), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if 100 * held[lang, words] < shadow * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted(((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, ps in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(ps)[:top], 1)), key=repr)


def phrase_rows(rows):
    rng = random.Random(12)
    words = ["Alpha", "beta", "GAMMA", "é", "ß-x", "a", "a", "a", " ", "日本", "d\x00e"]
    ends = [" ", " ", " ", "\t ", ". ", ",", "\n", "!\x0b"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    found = [(r[0], r[1], r[2]) for r in rows] + [(None, prose(80), None), (None, prose(80), "en"), (None, None, None), (4, "", "fr"), (4, "..", "fr")]
    found += [(k % 7, prose(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for k in range(90)]
    return found + [(9, "one two three four five", "es")] * 12 + [(10, "a " * 9000, "la")]


@pytest.mark.parametrize(("most", "least", "top", "shadow"), [(3, 10, 2000, 50), (2, 3, 5, 50), (4, 4, 40, 80), (3, 300, 9, 1)])
def test_collocations(spark, rows, no_docs, most, least, top, shadow):
    found = phrase_rows(rows)
    frame = spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, t, lang in found], "doc_id long, text string, lang string, n long, phrase string, size string").repartition(3)
    assert shown(collocations(frame, most, least, top, shadow, chunk_bytes=3000)) == plain_collocations(found, most, least, top, shadow)
    assert collocations(no_docs, most).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits and quotients next to whole numbers."""
    rng = random.Random(2)
    facts = [(10**13 + k, 10**13 + 7 * k, 10**14 + k * k) for k in range(20)] + [(a, rng.randint(a, 9 * a), rng.randint(a, 9 * a)) for a in (rng.randint(10, 10**13) for _ in range(60))]
    rows = []
    for k, (a, left, right) in enumerate(facts):
        rows += [("x", 1, f"l{k}", left), ("x", 1, f"r{k}", right), ("x", 2, f"l{k} r{k}", a)]
    got = {r.phrase: r.score for r in scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()}
    assert got == {f"l{k} r{k}": 1000000 * a * a // (left * right) for k, (a, left, right) in enumerate(facts)}


def test_sieve_keeps_all_that_can_be_frequent():
    """Counts that stop at 255, phrases that share a hash, and chunks that hold few each."""
    key = lambda h, n: h << 8 | n
    bodies = [np.array([key(1, 6), key(2, 255), key(3, 1)], np.uint64).tobytes(), b"", np.array([key(1, 4), key(3, 2), key(3, 6)], np.uint64).tobytes()]
    bits = lambda bodies, least: [np.unpackbits(np.frombuffer(b, np.uint8), count=n).tolist() for b, n in zip(possible(bodies, least), (3, 0, 3), strict=True)]
    assert bits(bodies, 10) == [[1, 1, 0], [], [1, 0, 0]] and bits(bodies, 9) == [[1, 1, 1], [], [1, 1, 1]] and bits(bodies, 900) == [[0, 1, 0], [], [0, 0, 0]]
