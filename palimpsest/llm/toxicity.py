"""Toxicity: undo obfuscation as a noisy channel, then score the restored words.

A character trigram model of the whole corpus is the source. A suspicious token (digits or marks among its
letters, a letter twice or more) is a lattice: each character may stand for itself, for the letter it resembles,
for a repeat of the one before, or for nothing. So is a stretch of short tokens, where a space may also stand for
nothing: letters spaced out, or a word cut in parts. Viterbi decoding gives the most probable readings. Weights of
words and word beginnings come from a bounded sample of labelled documents.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import concat_bytes, keyed_texts, text_slices

#: Bound of the sample that weights are fitted on: about so many labelled rows, picked by a hash of the id.
TRAIN_ROWS = 20_000
MIN_POSITIVE = 4
MIN_PRECISION = 0.5
#: Weight from which a single word is a sure sign.
STRONG = 0.96
PREFIXES = range(4, 10)
THRESHOLD = 0.7
#: Bounds of a worker's memory of tokens: how many, and how long each may be.
CACHE_TOKENS, CACHE_CHARS = 200_000, 40
#: Tokens of fewer characters may be parts of a word cut by spaces.
SHORT_TOKEN = 5

#: Character classes of the language model: 0 what is no letter, 1..26 a..z, 27 other letters.
CLASSES = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27

#: Letters that a character resembles.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
MARKS = frozenset("!|+$@(<€£")
_EDGE_MARKS = ".,;:?\"'[]{}*#%&^~`/\\-_=…«»¡¿“”„‘’)>"
_EDGE_RUNS = re.compile(r"^([(<!|+$@])\1+|([(<!|+$@])\2+$|!+$|^\(|\($")
_REPEAT = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")

LEET_COST, SKIP_COST, DROP_COST, REPEAT_COST, DOUBLE_COST, JOIN_COST = 0.5, 0.7, 5.0, 0.1, 3.0, 1.0


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: trigrams of character classes over every whole text; a text is framed by class 0."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for _, texts in text_slices(batches):
            flat, _ = concat_bytes([b" " + t + b" " for t in texts])
            c = _CLASS[flat]
            if len(c) >= 3:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        used = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["gram", "n"])

    return keyed_texts(docs).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log probability) of a class after two others, add-one smoothed; CLASSES^3 numbers."""
    counts = np.zeros(CLASSES**3)
    for r in trigram_counts(docs).collect():
        counts[r["gram"]] = r["n"]
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    return np.log(counts.sum(axis=2, keepdims=True) + CLASSES) - np.log(counts + 1)


def _class_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


class Restorer:
    """Readings of a token: the token itself and, if it looks obfuscated, its best lattice paths."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def core(self, token: str) -> str:
        low = token.lower().strip(_EDGE_MARKS)
        return _EDGE_RUNS.sub("", low).strip(_EDGE_MARKS) or low

    def readings(self, token: str) -> list[str]:
        core = self.core(token)
        if core.isalpha() and not _REPEAT.search(core):
            return [core]
        if not any(ch.isalpha() or ch in LEET for ch in core):
            return []
        return list(dict.fromkeys([core, *self.viterbi(core)]))

    def single_letters(self, token: str) -> list[str]:
        """Readings of a plain word in which a letter stands twice and may have been meant once."""
        core = self.core(token)
        return self.viterbi(core) if core.isalpha() and _DOUBLE.search(core) else []

    @staticmethod
    def steps(token: str, k: int, run: int) -> list[tuple[str, float]]:
        """What the character at ``k``, the ``run``-th of its kind in a row, may stand for, and at what cost."""
        ch = token[k]
        if ch == " ":
            return [(" ", 0.0), ("", JOIN_COST)]
        again = ("", REPEAT_COST if run > 2 or token[k + 1 : k + 2] == ch else DOUBLE_COST)
        if ch.isalpha():
            return [(ch, 0.0), again] if run > 1 else [(ch, 0.0)]
        found = [(letter, LEET_COST) for letter in LEET.get(ch, "")]
        if run > 1 and ch in LEET:
            found.append(again)
        if ch not in LEET:
            found.append(("", SKIP_COST))
        elif ch in MARKS:  # dearer than a letter usually is, or dropping it would always win
            found.append(("", DROP_COST))
        return found

    def viterbi(self, token: str) -> list[str]:
        """The most probable readings, best first: one for each pair of last letters that a path can end in."""
        states = {(0, 0): (0.0, "")}
        run = 0
        for k, ch in enumerate(token):
            run = run + 1 if k and ch == token[k - 1] else 1
            after: dict[tuple[int, int], tuple[float, str]] = {}
            steps = self.steps(token, k, run)
            for (a, b), (cost, text) in states.items():
                for letter, extra in steps:
                    if letter:
                        c = _class_of(letter)
                        state, total = (b, c), cost + extra + self.costs[a][b][c]
                    else:
                        state, total = (a, b), cost + extra
                    if state not in after or total < after[state][0]:
                        after[state] = (total, text + letter)
            states = after
        ends = sorted((cost + self.costs[a][b][0], text) for (a, b), (cost, text) in states.items())
        return [text for _, text in ends if text]

    def tokens(self, text: str, wanted=None) -> Counter:
        """Tokens and how often they occur, and the words that stretches of short tokens restore to.

        Stretches are decoded where three or more characters stand alone in a row, and where tokens written
        together hold a word of ``wanted`` (an automaton of words).
        """
        words = text.split()
        found = Counter(words)
        short = [w if len(w) < SHORT_TOKEN else "|" for w in words]
        squeezed = "".join(short).lower()
        alone = list(map(len, words)).count(1) > 2
        if not alone and (wanted is None or next(wanted.iter(squeezed), None) is None):
            return found
        start = 0
        for k in range(len(words) + 1):
            if k < len(words) and len(words[k]) < SHORT_TOKEN:
                continue
            if k - start > 1:
                found.update(self._restored([w.lower() for w in words[start:k]], wanted))
            start = k + 1
        return found

    def _restored(self, parts: list[str], wanted) -> list[str]:
        single = "".join("1" if len(p) == 1 else "0" for p in parts)
        if "111" not in single and not (wanted is not None and self._crosses(parts, wanted)):
            return []
        best = self.viterbi(" ".join(filter(None, (p.strip(_EDGE_MARKS) or p for p in parts))))
        words = [w for w in best[0].split() if w not in parts] if best else []
        # a lone letter before a spaced word may read as its first, so the sure signs within are what counts
        return words if wanted is None else [w for word in words for _, w in wanted.iter(word)]

    @staticmethod
    def _crosses(parts: list[str], wanted) -> bool:
        """Whether a wanted word stands over a boundary of the parts."""
        ends = set(itertools.accumulate(len(p) for p in parts))
        return any(any(last - len(word) + 1 < e <= last for e in ends) for last, word in wanted.iter("".join(parts)))


def automaton(weights: dict[str, float]):
    """Finds the words that are sure signs in running text; None without any."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, p in weights.items():
        if p >= STRONG and len(word) >= SHORT_TOKEN and not word.endswith("*"):
            found.add_word(word, word)
    if not len(found):
        return None
    found.make_automaton()
    return found


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (marked by a star), which inflected forms share."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if n <= len(word))]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of at most about ``rows`` labelled documents, picked by a hash of the id; equal texts once."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < share * (1 << 30))
    texts = keyed_texts(docs).join(F.broadcast(picked), "doc_id")  # about ``rows`` ids
    return texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))


def fit_weights(docs: DataFrame, labels: DataFrame, restorer: Restorer, rows: int = TRAIN_ROWS) -> dict[str, float]:
    """Feature -> probability that a document with it is toxic, for those that show it beyond chance."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen = {f for t in restorer.tokens(text or "") for w in restorer.readings(t) for f in word_features(w)}
                for f in seen:
                    counts.setdefault(f, [0, 0])[toxic > 0] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "n0", "n1"])

    sample = labelled_sample(docs, labels, rows).select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = sample.mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    p = F.col("n1") / n
    lower = (p + 2 / n - 2 * F.sqrt((p * (1 - p) + 1 / n) / n)) / (1 + 4 / n)  # Wilson's bound, z = 2
    kept = counts.filter((F.col("n1") >= MIN_POSITIVE) & (lower >= MIN_PRECISION))  # bounded by the sample
    return {r["feature"]: (r["n1"] + 0.1) / (r["n0"] + r["n1"] + 1.0) for r in kept.collect()}


def _once(word: str) -> str:
    """Every letter once where it stands several times in a row: the same for all readings of a plain word."""
    return _RUN.sub(r"\1", word)


class Scorer:
    """What a text's weighted words say: how many are sure signs, and how many, how often and how densely the
    weaker ones stand. ``calibration`` weighs these five figures and a constant into a probability."""

    def __init__(self, restorer: Restorer, weights: dict[str, float], calibration: list[float] | None = None):
        self.restorer, self.weights, self.calibration = restorer, weights, calibration
        self.wanted = automaton(weights)
        self.collapsed = {_once(w) for w, p in weights.items() if p >= STRONG and not w.endswith("*")}
        self.known: dict[str, tuple[str, float] | None] = {}

    def _best(self, words: list[str]) -> tuple[str, float] | None:
        best = None
        for word in words:
            p = max((self.weights.get(f, 0.0) for f in word_features(word)), default=0.0)
            if p and (best is None or p > best[1]):
                best = (word, p)
        return best

    def _weigh(self, token: str) -> tuple[str, float] | None:
        best = self._best(self.restorer.readings(token))
        # a doubled letter is common, so that only a word that is a sure sign counts; most words are not near one
        if best is None and _once(self.restorer.core(token)) in self.collapsed:
            sure = [w for w in self.restorer.single_letters(token) if self.weights.get(w, 0.0) >= STRONG]
            best = (sure[0], self.weights[sure[0]]) if sure else None
        if len(self.known) < CACHE_TOKENS and len(token) <= CACHE_CHARS:
            self.known[token] = best
        return best

    def figures(self, text: str) -> list[float]:
        known, strong, weak, occurrences, total = self.known, set(), set(), 0, 0
        for token, n in self.restorer.tokens(text, self.wanted).items():
            total += n
            hit = known[token] if token in known else self._weigh(token)
            if hit and hit[1] >= STRONG:
                strong.add(hit[0])
            elif hit:
                weak.add(hit[0])
                occurrences += n
        return [min(len(strong), 3), math.log1p(len(weak)), math.log1p(occurrences), min(5.0, 100 * occurrences / max(1, total)), math.log1p(total) / 5, 1.0]

    def score(self, text: str) -> float:
        if not self.calibration:
            return 0.0
        logit = sum(w * x for w, x in zip(self.calibration, self.figures(text), strict=True))
        return round(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))), 9)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [round(v, 9) for v in w.tolist()]


def fit_calibration(train: DataFrame, labels: DataFrame, restorer: Restorer, weights: dict[str, float], rows: int = TRAIN_ROWS) -> list[float] | None:
    """How the figures of the sampled texts tell their labels; None without weights or with one class only."""
    if not weights:
        return None

    def run(batches):
        scorer = Scorer(restorer, weights)
        for batch in batches:
            found = [scorer.figures(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["doc_id", "x", "toxic"])

    sample = labelled_sample(train, labels, rows).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    found = sorted(sample.mapInArrow(run, "doc_id long, x array<double>, toxic int").collect())  # bounded by the sample
    y = np.array([float(r["toxic"] > 0) for r in found])
    return fit_logistic(np.array([r["x"] for r in found]), y) if 0 < y.sum() < len(y) else None


def score_toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs(doc_id, text, ...)``.

    ``train(doc_id, text)`` with ``labels(doc_id, toxic)`` gives the weights of words and then the calibration,
    both from one bounded sample; the character model counts every text of ``docs``. Null and empty texts
    score what a text without weighted words does, near 0; equal texts score equally. ``predicted`` is 1 from
    ``threshold`` on. Without labels of both kinds all scores are 0. A doc_id labelled twice counts as toxic if one
    label says so; texts of any length are read whole; repeated rows get equal scores; of equally probable readings
    the first by name counts. An empty ``docs`` gives an empty result. Other columns are ignored.
    """
    restorer = Restorer(language_model(docs))
    weights = fit_weights(train, labels, restorer, rows)
    calibration = fit_calibration(train, labels, restorer, weights, rows)

    def run(batches):
        scorer = Scorer(restorer, weights, calibration)
        for ids, texts in text_slices(batches):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([scorer.score(t.decode()) for t in texts], pa.float64())], names=["doc_id", "score"])

    scored = keyed_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
