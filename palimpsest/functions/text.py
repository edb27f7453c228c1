"""Text functions as Columns; only phrase extraction needs Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Whitespace as Unicode has it, and ASCII punctuation.
SPACES = r"(?U)\s+"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
MAX_PHRASES = 32

#: Words that never make a phrase.
PHRASE_STOPWORDS = frozenset(
    "a about after again also an and are as at be because been before but by can could did do does during for from had has have he "
    "her here hers his how i if in is it its just me my no not of oh ok okay on or our over she should so some still than that the "
    "their them then there these they this those to under was we were what when where which while who why will with would yeah yes "
    "you your".split()
)

#: Normalised answers, and beginnings of answers, that decline.
ABSTENTIONS = ("", "i dont know", "i don t know", "unknown", "no information")
ABSTENTION_STARTS = ("i dont know", "i don t know", "i cannot determine", "i can t determine", "there is no information", "no information")


def split_words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """The larger of a quarter of the characters and the number of words."""
    return F.greatest(F.floor(F.char_length(text) / 4).cast("long"), F.size(split_words(text)).cast("long"))


def normalize(text: Column) -> Column:
    """Lower-case words without ASCII punctuation and articles."""
    plain = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, " ")
    return F.filter(split_words(plain), lambda w: ~w.isin(*ARTICLES))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays share, repeats included."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the normalised words; 1 if both are empty, 0 if one is."""
    p, g = normalize(prediction), normalize(gold)
    shared = multiset_overlap(p, g).cast("double")
    f1 = 2 * shared / (F.size(p) + F.size(g))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(f1)


def gold_token_recall(evidence: Column, gold: Column) -> Column:
    """Share of the gold words that the evidence has, repeats included; 1 without gold words."""
    e, g = normalize(evidence), normalize(gold)
    return F.when(F.size(g) == 0, F.lit(1.0)).otherwise(multiset_overlap(e, g) / F.size(g))


def is_abstention(response: Column) -> Column:
    joined = F.array_join(normalize(response), " ")
    starts = F.lit(False)
    for s in ABSTENTION_STARTS:
        starts = starts | joined.startswith(s)
    return joined.isin(*ABSTENTIONS) | starts


def exact_match(prediction: Column, gold: Column) -> Column:
    return (F.array_join(normalize(prediction), " ") == F.array_join(normalize(gold), " ")).cast("double")


def stamped_date(text: Column) -> Column:
    """The date of a leading ``[YYYY-MM-DD] `` stamp, else null."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^\[(\d{4}-\d{2}-\d{2})\]", 1), F.lit("")))


def strip_stamp(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[\d{4}-\d{2}-\d{2}\] ?", "")


def is_found(gold: Column, evidence: Column, least: int = 30, head: int = 80) -> Column:
    """Whether the head of a long enough gold text stands in one of the evidence texts."""
    probe = F.left(gold, F.lit(head))
    return (F.char_length(gold) > least) & F.exists(evidence, lambda e: F.contains(strip_stamp(e), probe))


def preview(text: Column, chars: int = 180) -> Column:
    return F.substring(text, 1, chars)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def content_words(text: Column, least: int = 4) -> Column:
    return F.array_sort(F.array_distinct(F.filter(words(text), lambda w: F.char_length(w) >= least)))


def singular(word: Column) -> Column:
    """Without a plural ending, if three letters stay."""
    for ending in ("es", "s"):
        cut = F.left(word, F.char_length(word) - len(ending))
        fits = word.endswith(ending) & (F.char_length(word) - len(ending) >= 3)
        stem = F.when(fits, cut) if ending == "es" else stem.when(fits, cut)
    return stem.otherwise(word)


def states(identity: Column, memory: Column) -> Column:
    """Whether every word of the identity stands in the memory, up to plural."""
    have = F.transform(words(memory), singular)
    return F.forall(words(identity), lambda w: F.array_contains(have, singular(w)))


def unmentioned_terms(question: Column, evidence: Column, least: int = 4) -> Column:
    """Content words of the question that the evidence lacks, up to plural; sorted."""
    have = F.transform(words(evidence), singular)
    return F.filter(content_words(question, least), lambda w: ~F.array_contains(have, singular(w)))


def best_line(text: Column, query: Column) -> Column:
    """The line that shares most distinct words with the query; the first of equals."""
    wanted = F.array_distinct(words(query))
    lines = F.split(text, "\n")
    scored = F.transform(lines, lambda line, k: F.struct(F.size(F.array_intersect(F.array_distinct(words(line)), wanted)).alias("n"), (-k).alias("k"), line.alias("line")))
    return F.array_max(scored)["line"]


def pack_lines(text: Column, limit: int = 1800) -> Column:
    """Lines packed greedily into chunks of at most ``limit`` bytes; a longer line stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        fits = F.octet_length(acc["open"]) + 1 + F.octet_length(line) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), line.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), line).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), line.alias("open")))
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


_PHRASE_TOKEN = re.compile(r"(?:[^\W_]|[-'])+")
_YEAR_OR_DATE = re.compile(r"(?:19\d\d|20\d\d|2100|\d{4}-\d{2}-\d{2})")


def phrases_of(text: str | None) -> list[str]:
    """Capitalised runs, each of their words, years and ISO dates; sorted, distinct, at most MAX_PHRASES."""
    found: set[str] = set()
    run: list[str] = []

    def flush() -> None:
        found.update(run)
        if len(run) > 1:
            found.add(" ".join(run))
        run.clear()

    end = None
    for m in _PHRASE_TOKEN.finditer(text or ""):
        token, low = m[0], m[0].lower()
        gap = "\n" if end is None else text[end : m.start()]
        end = m.end()
        if token[0].isupper() and low not in PHRASE_STOPWORDS:
            if gap.strip(" \t"):
                flush()
            run.append(low)
            continue
        flush()
        if _YEAR_OR_DATE.fullmatch(token):
            found.add(low)
    flush()
    return sorted(p for p in found if len(p) >= 2 and p not in PHRASE_STOPWORDS)[:MAX_PHRASES]


@F.pandas_udf(ArrayType(StringType()))
def phrases(text: pd.Series) -> pd.Series:
    return text.map(phrases_of)
