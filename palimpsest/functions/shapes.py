"""What kind of question a text asks, by fixed cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.trust import any_cue

#: Cue lists.
INTERVAL_CUES = ("how long", "how many days", "how many weeks", "how many months", "how many years", "how much time", " before ", " after ", " since ", "which event", "earlier", "later")
AGGREGATION_CUES = ("how many ", "how much ", " in total", "total ", "altogether", "combined")
ADVICE_CUES = ("recommend", "suggest", "tips", "ideas", "advice", "what should i", "can you help", "could you help", "help me", "i'm looking for", "i am looking for", "do you think")
RECALL_CUES = ("you recommended", "you suggested", "you mentioned", "you told me", "you gave me", "you provided", "remind me", "our previous", "our last", "we discussed", "we talked")
INFERENCE_MODALS = ("likely", "might", "would", "could", "probably")
USER_WORDS = ("i", "i'm", "i've", "i'd", "me", "my", "you", "your")
ENUMERATION_CUES = ("what are some", "what kinds of", "what types of", "what sorts of")
AUXILIARIES = ("has", "have", "had", "did", "does", "do", "are", "were", "is", "was")
PERSONAL_SUBJECTS = ("i", "you", "we", "they")
KIND_WORDS = ("kind", "kinds", "type", "types", "sort", "sorts")
IRREGULAR_PLURALS = ("children", "people", "men", "women")
NOT_PLURAL = ("news", "series", "species", "lens", "always", "perhaps", "sometimes", "towards", "afterwards", "besides", "whereas", "across", "plus", "yes")
SPAN_WORDS = 6


def person_words(text: Column) -> Column:
    """Lower-case words; typographic apostrophes count as plain ones."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "’", "'"), r"[^\p{L}\p{N}']+"), lambda w: w != "")


def is_interval_question(text: Column) -> Column:
    return any_cue(F.lower(text), INTERVAL_CUES)


def is_aggregation_question(text: Column) -> Column:
    return any_cue(F.lower(text), AGGREGATION_CUES) & ~is_interval_question(text)


def is_advice_request(text: Column) -> Column:
    low = F.lower(text)
    return any_cue(low, ADVICE_CUES) & ~any_cue(low, RECALL_CUES)


def is_inference_question(text: Column) -> Column:
    """A modal that neither follows nor precedes ``you``."""
    words = person_words(text)
    padded = F.concat(F.array(F.lit("")), words, F.array(F.lit("")))
    places = F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(padded) - 1))
    at = lambda k: F.coalesce(F.try_element_at(padded, k), F.lit(""))
    return F.exists(places, lambda k: at(k).isin(*INFERENCE_MODALS) & (at(k - 1) != "you") & (at(k + 1) != "you"))


def is_non_recall_request(text: Column) -> Column:
    addressed = F.arrays_overlap(person_words(text), F.array(*map(F.lit, USER_WORDS)))
    return (is_advice_request(text) & addressed) | is_inference_question(text)


def is_plural_noun(word: Column) -> Column:
    regular = (F.char_length(word) >= 4) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us") & ~word.endswith("is") & ~word.isin(*NOT_PLURAL)
    return word.rlike("^[a-z]+$") & (word.isin(*IRREGULAR_PLURALS) | regular)


def is_enumeration_question(text: Column) -> Column:
    """A list cue; or what/which, then a plural head noun and an auxiliary; or what are/were and a thing."""
    words = person_words(text)
    after_wh = lambda ws: F.slice(ws, _first(ws, ("what", "which")) + 1, F.greatest(F.lit(1), F.size(ws)))
    rest = after_wh(words)
    aux_at = _first(F.slice(rest, 1, SPAN_WORDS + 1), AUXILIARIES)
    span = F.slice(rest, 1, F.greatest(F.lit(0), aux_at - 1))
    word = lambda k: F.coalesce(F.try_element_at(rest, F.lit(k)), F.lit(""))
    of_at = _first(span, ("of",))
    before_of = F.coalesce(F.try_element_at(span, F.greatest(F.lit(1), of_at - 1)), F.lit(""))
    head = F.when((of_at > 1) & ~before_of.isin(*KIND_WORDS), before_of).otherwise(F.coalesce(F.try_element_at(span, F.lit(-1)), F.lit("")))
    bare = word(1).isin("are", "were") & (word(2) != "") & ~word(2).isin(*PERSONAL_SUBJECTS)
    asks = (_first(words, ("what", "which")) > 0) & (aux_at > 0) & F.when(aux_at == 1, bare).otherwise(is_plural_noun(head))
    return any_cue(F.lower(text), ENUMERATION_CUES) | asks


def _first(words: Column, wanted: tuple[str, ...]) -> Column:
    """One-based place of the first wanted word, else 0."""
    return F.coalesce(F.array_position(F.transform(words, lambda w: w.isin(*wanted)), True), F.lit(0)).cast("int")
