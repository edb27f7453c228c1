"""Shapes of questions by stratum."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.evaluation import arms
from palimpsest.functions.shapes import INTERVAL_CUES, is_interval_question
from palimpsest.plans.common import register, table

_CUES = " OR ".join(f"contains(lower(text), '{c}')" for c in INTERVAL_CUES)


@register("E19_shape_table", f"SELECT role AS stratum, count(*) FILTER ({_CUES}) AS fires, count(*) AS \"of\" FROM conversations GROUP BY role")
def shape_table(spark, sf):
    return arms.shape_table(table(spark, sf, "conversations").withColumnRenamed("role", "stratum"), is_interval_question(F.col("text")))
