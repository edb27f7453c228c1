"""What a model's reply, a speaker's line or a dated event amounts to, as Columns wherever SQL functions suffice."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from palimpsest.functions.text import exact_match, is_abstention, states, token_f1
from palimpsest.functions.timephrases import parse_whole, parse_within, relative_phrases, resolve_relative

#: Mismatches under which an answer may still be given, and words that negate.
ANSWERABLE = ("none", "detail unstated")
NEGATIONS = ("not", "never", "no")
#: How much of a text each reader is shown, in characters.
SHOWN = {"rerank": 8000, "selector": 400, "evidence": 2000, "ask": 1200}
LEAST_CHECKED = 2

EVENT = StructType([StructField("t_valid", DateType()), StructField("text", StringType())])


def shown(text: Column, to: str) -> Column:
    """The head of a text that a reader of that kind is shown."""
    return F.left(text, F.lit(SHOWN[to]))


def score_one(response: Column, gold: Column, adversarial: Column) -> Column:
    """``struct<score, exact>``: an adversarial question is right if declined, another wrong if declined, else F1."""
    declined = is_abstention(response)
    pick = lambda c: F.when(adversarial, declined.cast("double")).when(declined, F.lit(0.0)).otherwise(c)
    return F.struct(pick(token_f1(response, gold)).alias("score"), pick(exact_match(response, gold)).alias("exact"))


def _given(answer: Column) -> Column:
    return F.nullif(F.regexp_replace(answer, r"(?U)^\s+|\s+$", ""), F.lit(""))


def accepted_commit(reply: Column) -> Column:
    """The answer that a second pass commits to, null where it keeps the decline or the reply cannot be read."""
    got = F.from_json(reply, "answer string, evidence_absent boolean")
    return F.when(~got["evidence_absent"] & _given(got["answer"]).isNotNull() & ~is_abstention(got["answer"]), got["answer"])


def accepted_typed(reply: Column) -> Column:
    """The trimmed answer, if its mismatch leaves the question answerable."""
    got = F.from_json(reply, "answer string, mismatch string")
    answer = _given(got["answer"])
    return F.when(got["mismatch"].isin(*ANSWERABLE) & ~is_abstention(answer), answer)


def accepted_grounded(reply: Column, memories: Column) -> Column:
    """The answer, if each thing named stands in the memory it names (from 0) and one memory is cited."""
    got = F.from_json(reply, "named array<struct<thing: string, memory: int>>, supporting array<int>, answer string")
    held = lambda t: F.coalesce(states(t["thing"], F.get(memories, t["memory"])), F.lit(False))
    cited = F.exists(got["supporting"], lambda i: (i >= 0) & (i < F.size(memories)))
    fine = (F.size(got["named"]) > 0) & F.forall(got["named"], held) & cited & _given(got["answer"]).isNotNull()
    return F.when(fine & ~is_abstention(got["answer"]), got["answer"])


def verdict_tier(reply: Column, tier: Column) -> Column:
    """Trust after adjudication: an injection, and a reply that cannot be read, quarantine."""
    injected = F.from_json(reply, "injection boolean")["injection"]
    return F.when(F.coalesce(injected, F.lit(True)), "quarantined").otherwise(tier)


def valid_candidates(reply: Column) -> Column:
    """``array<struct<text, entities>>`` of extracted facts: trimmed, empty ones dropped, entities sorted and distinct."""
    facts = F.from_json(reply, "facts array<struct<text: string, entities: array<string>>>")["facts"]
    phrases = lambda e: F.array_sort(F.array_distinct(F.filter(F.transform(e, lambda p: F.trim(p)), lambda p: p != "")))
    clean = F.transform(facts, lambda f: F.struct(F.trim(f["text"]).alias("text"), F.coalesce(phrases(f["entities"]), F.array().cast("array<string>")).alias("entities")))
    kept = F.filter(clean, lambda f: F.coalesce(f["text"] != "", F.lit(False)))
    return F.coalesce(kept, F.array().cast("array<struct<text: string, entities: array<string>>>"))


def turn_speaker(line: Column) -> Column:
    """The speaker of ``[date] Name: text``, null where a line is no turn."""
    return F.nullif(F.regexp_extract(line, r"^\s*(?:\[[^\]]*\]\s*)*([A-Z][A-Za-z]*): ", 1), F.lit(""))


def dialogue_speakers(memories: Column) -> Column:
    """Speakers of all memories that open with a turn and have two or more of them, in order of appearance."""
    names = lambda m: F.filter(F.transform(F.split(m, "\r?\n"), turn_speaker), lambda n: n.isNotNull())
    opens = lambda m: turn_speaker(F.element_at(F.split(m, "\r?\n"), 1)).isNotNull()
    each = F.transform(F.filter(memories, opens), lambda m: F.array_distinct(names(m)))
    return F.array_distinct(F.flatten(F.filter(each, lambda n: F.size(n) >= 2)))


def _name_pattern(name: Column) -> Column:
    return F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), name, F.lit(r"\E(?![A-Za-z0-9])"))


def names(text: Column, name: Column) -> Column:
    """Whether a text holds a name as a whole word; ``Jon's`` does, ``Jonathan`` does not."""
    return F.regexp_like(text, _name_pattern(name))


def negation_count(text: Column) -> Column:
    """How many negating words a text holds, contractions included."""
    words = F.split(F.regexp_replace(F.lower(text), "’", "'"), r"[^\p{L}\p{N}']+")
    return F.size(F.filter(words, lambda w: w.isin(*NEGATIONS) | w.endswith("n't")))


def disputes(statement: Column, question: Column, speakers: Column) -> Column:
    """Why a statement is not the question's own claim, null if it is: it negates more, or names another speaker."""
    other = F.get(F.filter(speakers, lambda s: names(statement, s) & ~names(question, s)), F.lit(0))
    return F.when(negation_count(statement) > negation_count(question), F.lit("negates the question")).when(other.isNotNull(), F.concat(F.lit("names "), other, F.lit(", whom the question does not")))


def speaker_swap(statement: Column, speakers: Column) -> Column:
    """The statement about the other of two speakers; null unless it names exactly one of exactly two."""
    a, b = F.get(speakers, F.lit(0)), F.get(speakers, F.lit(1))
    swap = lambda x, y: F.regexp_replace(statement, _name_pattern(x), y)
    two = F.size(speakers) == 2
    return F.when(two & names(statement, a) & ~names(statement, b), swap(a, b)).when(two & names(statement, b) & ~names(statement, a), swap(b, a))


def _bare_words(text: Column) -> Column:
    """Words as written, without quotes at their ends and a possessive ending."""
    trimmed = F.transform(F.split(text, r"[^\p{L}\p{N}']+"), lambda w: F.regexp_replace(F.regexp_replace(w, "^'+|'+$", ""), "'s$", ""))
    return F.filter(trimmed, lambda w: w != "")


def grounding(gist: Column, cited: Column) -> Column:
    """``struct<matched, total>``: how many of the gist's names and numbers are words of the cited text."""
    said = F.transform(_bare_words(cited), F.lower)
    checked = F.transform(F.filter(_bare_words(gist), lambda w: (F.char_length(w) >= LEAST_CHECKED) & w.rlike(r"^[\p{Lu}0-9]")), F.lower)
    return F.struct(F.size(F.filter(checked, lambda w: F.array_contains(said, w))).alias("matched"), F.size(checked).alias("total"))


def evidence_label(text: Column, kind: Column, tier: Column, day: Column, stamp: bool = True, mark: bool = True, resolve: bool = True) -> Column:
    """A text as evidence: its day, a mark if it is untrusted, and after it what its relative phrases mean.

    An event's phrase was resolved when it was written, so it is not resolved again.
    """
    head = [F.concat(F.lit("["), F.date_format(day, "yyyy-MM-dd"), F.lit("] "))] if stamp else []
    if mark:
        head.append(F.when(tier == "untrusted", F.lit("[untrusted source] ")).otherwise(F.lit("")))
    if not (resolve and stamp):
        return F.concat(*head, text)
    till = lambda p: F.when(p["lo"] == p["hi"], F.lit("")).otherwise(F.concat(F.lit(".."), p["hi"].cast("string")))
    told = F.transform(relative_phrases(text, day), lambda p: F.concat(F.lit(" ("), p["phrase"], F.lit(" = "), p["lo"].cast("string"), till(p), F.lit(")")))
    return F.concat(*head, text, F.when(kind == "event", F.lit("")).otherwise(F.array_join(told, "")))


def resolve_when(when: str | None, said: date) -> tuple[str, date, date | None]:
    """(state, lo, hi) of an event's time phrase: ``said`` without one, ``stated`` if the grammar tells it, else
    ``unresolved``. Relative forms come first; a duration has no place in time."""
    phrase = (when or "").strip()
    if not phrase:
        return "said", said, None
    if found := resolve_relative(phrase, said):
        return "stated", found[0][1], found[0][2]
    whole = parse_whole(phrase)
    span = whole[1:3] if whole and whole[0] == "range" else None if whole else parse_within(phrase)
    return ("stated", *span) if span else ("unresolved", said, None)


def when_bracket(when: str | None, said: date) -> str:
    """When an event happened and when it was said."""
    state, lo, hi = resolve_when(when, said)
    phrase = (when or "").strip()
    if state == "said":
        return f"[said {said}]"
    if state == "unresolved":
        return f'["{phrase}", said {said}]'
    return f'[{lo if lo == hi else f"{lo} to {hi}"} — "{phrase}", said {said}]'


@F.pandas_udf(EVENT)
def event_record(subject: pd.Series, verb: pd.Series, thing: pd.Series, when: pd.Series, said: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    """The day and the text of an extracted event: what happened, when, when it was said, and other names."""
    out = []
    for s, v, o, w, d, a in zip(subject, verb, thing, when, said, aliases, strict=True):
        others = [x.strip() for x in ([] if a is None else a) if x and x.strip()]
        text = f"{(s or '').strip()} {(v or '').strip()} {(o or '').strip()} {when_bracket(w, d)}"
        out.append((resolve_when(w, d)[1], text + (f"\nalso: {'; '.join(others)}" if others else "")))
    return pd.DataFrame(out, columns=["t_valid", "text"])


def rerank_depth(depth: Column, k: Column, factor: Column) -> Column:
    """How many rows of a head are reranked: at least ``k`` for each unit of the factor."""
    return F.greatest(depth, k * F.greatest(factor, F.lit(1)))
