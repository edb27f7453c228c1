"""Recall of gold phrases in the first k pieces of evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.operators.containment import plain


def plain_text(text: Column) -> Column:
    """NFKC, lower case, runs of other than Latin letters and digits as one space."""
    return F.pandas_udf(lambda s: pd.Series([plain(t) for t in s], dtype=object), StringType())(text)


def recall_sweep(golds: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``k, questions, hits, recall`` of ``golds(query_id, phrase)`` in ``ranked(query_id, rank, text)``.

    A question is hit at k if all its phrases stand in its first k texts, joined in order. Phrases that are empty once
    plain do not count, nor do questions without another; a question without evidence is missed. Only the first max(ks)
    texts of a question, which is the feature, are put together in a row.
    """
    wanted = golds.select("query_id", plain_text(F.col("phrase")).alias("phrase")).filter("phrase <> ''").distinct()
    head = ranked.filter(F.col("rank") <= max(ks)).select("query_id", "rank", plain_text(F.col("text")).alias("text"))
    seen = head.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("rows"))
    met = wanted.join(seen, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    first = F.array_join(F.transform(F.filter("rows", lambda x: x["rank"] <= F.col("k")), lambda x: x["text"]), " ")
    holds = F.coalesce(F.contains(F.trim(F.regexp_replace(first, " +", " ")), F.col("phrase")), F.lit(False))
    asked = met.groupBy("query_id", "k").agg(F.every(holds).alias("hit"))
    out = asked.groupBy("k").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))
    return out.select("k", "questions", "hits", "recall")
