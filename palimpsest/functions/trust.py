"""Trust assessment of a text: pattern flags, score and tier, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import SPACES

#: Cues and penalties.
OVERRIDE_CUES = ("ignore previous", "ignore all previous", "disregard previous", "disregard all previous", "ignore the above", "forget your instructions", "override your instructions")
DIRECTIVE_CUES = ("you must always", "you should always", "from now on", "as an ai", "your new instructions", "system prompt")
PENALTIES = {"instruction_override": 1.0, "forged_knowledge_preamble": 1.0, "indication_redirect": 1.0, "model_directive": 0.4, "possible_pii": 0.2}
BASE_SCORES = {"first_party": 0.9, "asserted": 0.6, "untrusted": 0.3}
DISQUALIFYING = ("instruction_override", "forged_knowledge_preamble", "indication_redirect")


def any_cue(text: Column, cues: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def indication_redirect(text: Column) -> Column:
    """``refer … to …`` within sixty bytes of UTF-8, each read as a character, or a standing recommendation."""
    low = F.lower(text)
    return F.decode(F.encode(low, "UTF-8"), "ISO-8859-1").rlike(r"(?s)refer (?:(?! to ).){0,60} to .") | any_cue(low, ("always recommend", "always suggest"))


def looks_like_pii(text: Column) -> Column:
    words = F.split(text, SPACES)
    count = lambda w, pattern: F.regexp_count(w, F.lit(pattern))

    def ssn(w: Column) -> Column:
        core = F.regexp_replace(w, r"^[^A-Za-z0-9-]+|[^A-Za-z0-9-]+$", "")
        return (F.octet_length(core) == 11) & (count(core, "-") == 2) & (count(core, "[0-9]") == 9)

    return F.exists(words, ssn) | F.exists(words, lambda w: count(w, "[0-9]") >= 15) | F.contains(text, F.lit("sk-")) | F.contains(F.lower(text), F.lit("api_key"))


def poison_flags(text: Column) -> Column:
    """Names of the flags that a text raises, in a fixed order."""
    low = F.lower(text)
    tests = {
        "instruction_override": any_cue(low, OVERRIDE_CUES),
        "forged_knowledge_preamble": low.rlike(r"(?m)^\s*(?:knowledge|context):"),
        "indication_redirect": indication_redirect(text),
        "model_directive": any_cue(low, DIRECTIVE_CUES),
        "possible_pii": looks_like_pii(text),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def assess_trust(text: Column, source_tier: Column) -> Column:
    """``struct<flags, score, tier>``: the tier, not the score, decides whether a record is admissible."""
    flags = poison_flags(text)
    penalty = F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))])
    base = F.create_map(*[x for k, v in BASE_SCORES.items() for x in (F.lit(k), F.lit(v))])
    total = F.aggregate(flags, F.lit(0.0), lambda a, f: a + penalty[f])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base[source_tier] - total))
    worst = F.arrays_overlap(flags, F.array(*map(F.lit, DISQUALIFYING)))
    tier = (
        F.when(worst, "quarantined")
        .when((source_tier == "untrusted") | (F.size(flags) > 0), "untrusted")
        .when(source_tier == "first_party", "verified")
        .otherwise("asserted")
    )
    return F.struct(flags.alias("flags"), F.round(score, 6).alias("score"), tier.alias("tier"))
