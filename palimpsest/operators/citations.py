"""Whether cited texts state what a question names, by stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.stems import with_stems

#: Words of a question that name nothing, and the letters that another needs.
FUNCTION_WORDS = (
    "what when where which who whom whose why how many much did does have has had was were are can could would should will about that this these those "
    "there their them they then than into over total time times ago last first before and the for with from your"
).split()
LEAST_LETTERS = 3


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def uncited_terms(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """``query_id, terms``: words of ``questions(query_id, text)`` whose stem no text of ``cited(query_id, text)`` has.

    Numbers of any length count, other words from LEAST_LETTERS on that are not function words; terms stand in the order of
    the question, each once. A null text has no words; a question whose words are all cited, or that has none, has an empty
    array. Words are stemmed once each, in a table of the distinct words of both sides.
    """
    asked = questions.select("query_id", F.posexplode(_words(F.col("text"))).alias("at", "word"))
    wanted = asked.filter(F.col("word").rlike("^[0-9]+$") | ((F.char_length("word") >= LEAST_LETTERS) & ~F.col("word").isin(*FUNCTION_WORDS))).groupBy("query_id", "word").agg(F.min("at").alias("at"))
    said = cited.join(questions.select("query_id"), "query_id", "left_semi").select("query_id", F.explode(_words(F.col("text"))).alias("word")).distinct()
    stems = with_stems(wanted.select("word").unionByName(said.select("word")).distinct())
    have = said.join(stems, "word").select("query_id", "stem").distinct()
    missing = wanted.join(stems, "word").join(have, ["query_id", "stem"], "left_anti")
    terms = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])  # words of one question
    found = missing.groupBy("query_id").agg(terms.alias("terms"))
    return questions.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def premise_finding(terms: Column) -> Column:
    """What is told of a question's terms that no memory has; null if all are stated."""
    return F.when(F.size(terms) > 0, F.concat(F.lit("No memory mentions: "), F.array_join(terms, ", "), F.lit(".")))
