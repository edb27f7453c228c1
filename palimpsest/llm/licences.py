"""Licence scan by a positional index of rare words, in DataFrame functions only.

The corpus tells how rare each word of the licence templates is. A template's rarest words, and the rarest word of each
phrase that it must hold, make the index. Every place of an indexed word in a file names, for each posting of the word,
the place at which the template would begin; postings that agree on it are intersected by grouping on that place. A
place counts where its words carry enough of the template's weight and every mandatory phrase stands there word by word.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ascii_lower, cut_lineage, with_row_ids


@dataclass(frozen=True)
class Template:
    """Words of a licence text, the label they give, and phrases of it that must stand where they belong."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


#: Phrases that name a licence by themselves.
BASE = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)
#: Sentences of public licences and notices.
NOTICES = (
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it", "gnu general public license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "associated documentation files")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

#: Rare words that index a template, and the share of their weight that a place must carry.
RARE_WORDS, LEAST_SHARE = 6, 0.6
#: Words that one row holds at a time.
PIECE_WORDS = 1024
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def licence_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def rarity(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each of the given words over all rows, at least 1."""
    met = F.explode(F.array_intersect(licence_words(F.col(text_col)), F.array(*map(F.lit, words))))
    found = {r.word: r.n for r in docs.select(met.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = docs.count()
    return {w: 1 + math.log((n + 1) / (found.get(w, 0) + 1)) for w in words}


@dataclass(frozen=True)
class Posting:
    """A word at place ``at`` of a template; ``phrase`` is the mandatory phrase to verify from ``start``, if any."""

    word: str
    template: int
    at: int
    weight: float
    phrase: tuple[str, ...]
    start: int


def postings(templates: Sequence[Template], idf: dict[str, float], rare: int = RARE_WORDS) -> list[Posting]:
    """For each template, places of its rarest words by weight, and the rarest word of each phrase."""
    out = []
    rank = lambda w: (-idf[w], w)
    for n, t in enumerate(templates):
        words = t.text.split()
        chosen = set(sorted(set(words), key=rank)[:rare])
        places = [k for k, w in enumerate(words) if w in chosen]
        total = sum(idf[words[k]] for k in places)
        out += [Posting(words[k], n, k, idf[words[k]] / total, (), 0) for k in places]
        for phrase in t.phrases:
            own = tuple(phrase.split())
            at = next(k for k in range(len(words)) if tuple(words[k : k + len(own)]) == own)
            anchor = min(range(len(own)), key=lambda k: (rank(own[k]), k))
            out.append(Posting(own[anchor], n, at + anchor, 0.0, own, at))
    return out


def _index(spark: SparkSession, found: list[Posting]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(p.word).alias("word"), F.lit(p.template).alias("template"), F.lit(p.at).alias("at"), F.lit(p.weight).alias("weight"),
            F.array(*map(F.lit, p.phrase)).cast("array<string>").alias("phrase"), F.lit(p.at - p.start).alias("inside"),
        )
        for p in found
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _places(docs: DataFrame, row: str, id_col: str, text_col: str, words: list[str], reach: int) -> DataFrame:
    """``row, id, n_words, first, hits``: each text in pieces, and the indexed words of a piece with what stands around."""
    told = docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), licence_words(F.col(text_col)).alias("words"))
    cut = lambda at: F.struct(at.alias("first"), F.slice("words", F.greatest(at - reach, F.lit(0)) + 1, F.lit(PIECE_WORDS + 2 * reach)).alias("part"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = told.select("row", "id", F.size("words").cast("long").alias("n_words"), F.explode(F.transform(starts, cut)).alias("p")).select("row", "id", "n_words", "p.first", "p.part")
    shift = F.least(F.col("first"), F.lit(reach))  # places of the part that belong to the piece before
    own = F.least(F.size("part") - shift, F.lit(PIECE_WORDS))
    inside = F.when(own > 0, F.sequence(shift, shift + own - 1)).otherwise(F.array().cast("array<int>"))
    around = lambda i: F.slice("part", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    hit = lambda i: F.struct(
        (F.col("first") - shift + i).cast("long").alias("pos"), F.get("part", i).alias("word"), around(i).alias("around"), F.least(i, F.lit(reach)).alias("mid")
    )
    hits = F.transform(F.filter(inside, lambda i: F.get("part", i).isin(*words)), hit)
    return pieces.select("row", "id", "n_words", "first", hits.alias("hits")).filter((F.col("first") == 0) | (F.size("hits") > 0))


def scan_licences(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, rare: int = RARE_WORDS, least: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row of ``docs``.

    ``n_base`` counts all places of the ``base`` templates' words in a row, ``first_word`` and ``last_word`` are their
    least and largest start in words from 0, null without one. ``labels`` has theirs and those of the ``notices`` found;
    both are sorted, without repeats, joined by commas, empty if there are none. ``score`` is the largest share of a
    template's weight at a verified place, 0 without one. Null and empty texts have no words. Each row is a file of its
    own, whatever its id: repeated rows, and rows whose id is null or shared, all come back. Places that tie all count.
    Texts may be of any length, as rows hold a bounded piece at a time. An empty table gives an empty result. Columns
    other than the two named are ignored. Only the templates' words and their counts come to the driver.
    """
    spark = docs.sparkSession
    templates = [*base, *notices]
    docs, row = with_row_ids(docs.select(id_col, text_col), id_col, text_col)
    idf = rarity(docs, sorted({w for t in templates for w in t.text.split()}), text_col)
    found = postings(templates, idf, rare)
    reach = max(len(p.phrase) for p in found) - 1
    scanned = cut_lineage(_places(docs, row, id_col, text_col, sorted({p.word for p in found}), reach))

    hits = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    met = hits.join(F.broadcast(_index(spark, found)), "word")
    stands = (F.col("mid") >= F.col("inside")) & (F.slice("around", F.greatest(F.col("mid") - F.col("inside"), F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    verified = F.when(F.size("phrase") > 0, stands.cast("int")).otherwise(0)
    starts = met.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start")).agg(F.sum("weight").alias("share"), F.sum(verified).alias("verified"))

    needed = F.array(*[F.lit(len(t.phrases)) for t in templates])
    labels, is_base = F.array(*[F.lit(t.label) for t in templates]), F.array(*[F.lit(t.base) for t in templates])
    good = starts.filter((F.round("share", 9) >= least) & (F.col("verified") == F.get(needed, F.col("template"))))
    told = good.select("row", "start", "share", F.get(labels, F.col("template")).alias("label"), F.get(is_base, F.col("template")).alias("base"))
    mine = F.when(F.col("base"), F.col("start"))
    summed = told.groupBy("row").agg(
        F.count(mine).alias("n_base"), F.min(mine).alias("first_word"), F.max(mine).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max(F.least(F.round("share", 6), F.lit(1.0))).alias("score"),
    )
    files = scanned.filter("first = 0").select("row", F.col("id").alias("doc_id"), "n_words")
    out = files.join(summed, "row", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", empty("base_labels"), empty("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
