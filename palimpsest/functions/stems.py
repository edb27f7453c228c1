"""English stems by the published Porter2 rules, as Columns: they are meant for a table of distinct words.

R1 is what follows the first consonant behind a vowel, R2 the same within R1; both are kept as the length before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage

#: The rules' exceptions, endings and replacements.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al",
    "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize",
    "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_VOWEL = "[aeiouy]"


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.char_length(word) - n)


def _before(word: Column, found: str) -> Column:
    """Length of the part that a pattern from the beginning covers; the whole word's where it does not match."""
    part = F.regexp_extract(word, found, 0)
    return F.when(part == "", F.char_length(word)).otherwise(F.char_length(part))


def _longest(word: Column, endings, rule) -> Column:
    """What ``rule`` makes of the first ending that fits, of endings listed longest first; the word where none does."""
    out = F.when(F.lit(False), word)
    for e in endings:
        out = out.when(word.endswith(e), rule(e))
    return out.otherwise(word)


def _is_short(word: Column, r1: Column) -> Column:
    """A word that ends in a short syllable and has no R1."""
    return (r1 >= F.char_length(word)) & word.rlike("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def with_stems(words: DataFrame, column: str = "word", out: str = "stem") -> DataFrame:
    """Adds the stem of each lower-case word; words of one or two letters, and null, stay as they are.

    Each step reads the word several times, so the steps are written down one by one rather than nested.
    """
    w, r1, r2 = F.col("_w"), F.col("_r1"), F.col("_r2")
    step = lambda rows, c: cut_lineage(rows.withColumn("_w", c))
    rows = step(words, F.regexp_replace(F.regexp_replace(F.col(column), "’", "'"), "^'", ""))
    rows = step(rows, F.regexp_replace(w, f"^y|(?<={_VOWEL})y", "Y"))
    first = _before(w, "^[^aeiouy]*[aeiouy]+[^aeiouy]")
    rows = rows.withColumn("_r1", F.when(w.rlike("^(?:gener|arsen)"), 5).when(w.startswith("commun"), 6).otherwise(first))
    rows = cut_lineage(rows)
    rest = F.substring(w, r1 + 1, F.char_length(w))
    rows = rows.withColumn("_r2", r1 + F.when(F.char_length(rest) == 0, 0).otherwise(_before(rest, "^[^aeiouy]*[aeiouy]+[^aeiouy]")))
    rows = step(cut_lineage(rows), F.regexp_replace(w, "'s'$|'s$|'$", ""))
    # 1a: plurals
    ies = F.when(F.char_length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    rows = step(rows, F.when(w.endswith("sses"), _cut(w, 2)).when(w.rlike("ie[ds]$"), ies).when(w.rlike("[us]s$"), w).when(w.rlike(f"{_VOWEL}.+s$"), _cut(w, 1)).otherwise(w))
    rows = rows.withColumn("_kept", w.isin(*KEPT))
    # 1b: past and progressive
    inside = lambda n: F.char_length(w) - n >= r1
    eed = lambda n: F.when(inside(n), F.concat(_cut(w, n), F.lit("ee"))).otherwise(w)
    rows = cut_lineage(rows.withColumn("_stripped", F.regexp_extract(w, f"^(.*{_VOWEL}.*?)(?:ed|edly|ing|ingly)$", 1)))
    bare = F.col("_stripped")
    doubled = bare.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
    mended = F.when(bare.rlike("(?:at|bl|iz)$") | (~doubled & _is_short(bare, r1)), F.concat(bare, F.lit("e"))).when(doubled, _cut(bare, 1)).otherwise(bare)
    rows = step(rows, F.when(F.col("_kept"), w).when(w.endswith("eedly"), eed(5)).when(w.endswith("eed"), eed(3)).when(bare != "", mended).otherwise(w)).drop("_stripped")
    # 1c, 2 and 3
    rows = step(rows, F.when(~F.col("_kept") & w.rlike("^.+[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    rows = step(rows, F.when(F.col("_kept"), w).otherwise(_longest(w, STEP_2, lambda e: _replaced(e, STEP_2[e], w, inside))))
    third = lambda e: F.when((F.char_length(w) - len(e) >= (r2 if e == "ative" else r1)), F.concat(_cut(w, len(e)), F.lit(STEP_3[e]))).otherwise(w)
    rows = step(rows, F.when(F.col("_kept"), w).otherwise(_longest(w, STEP_3, third)))
    # 4 and 5
    fourth = lambda e: F.when((F.char_length(w) - len(e) >= r2) & (w.rlike("[st]ion$") if e == "ion" else F.lit(True)), _cut(w, len(e))).otherwise(w)
    rows = step(rows, F.when(F.col("_kept"), w).otherwise(_longest(w, STEP_4, fourth)))
    last = F.char_length(w) - 1
    short = _cut(w, 1).rlike("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
    fifth = F.when(w.endswith("e") & ((last >= r2) | ((last >= r1) & ~short)), _cut(w, 1)).when(w.endswith("ll") & (last >= r2), _cut(w, 1)).otherwise(w)
    rows = step(rows, F.when(F.col("_kept"), w).otherwise(fifth))
    whole = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    stem = F.when(F.char_length(column) <= 2, F.col(column)).otherwise(F.coalesce(F.try_element_at(whole, F.col(column)), F.regexp_replace(w, "Y", "y")))
    return rows.withColumn(out, stem).drop("_w", "_r1", "_r2", "_kept")


def _replaced(ending: str, by: str, w: Column, inside) -> Column:
    fits = inside(len(ending))
    if ending == "li":
        fits = fits & w.rlike("[cdeghkmnrt]li$")
    if ending == "ogi":
        fits = fits & w.endswith("logi")
    return F.when(fits, F.concat(_cut(w, len(ending)), F.lit(by))).otherwise(w)
