"""Blocks beside the evidence: dated events on a day that the question names, or what the user said of themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import approx_tokens
from palimpsest.operators import compose


@dataclass(frozen=True)
class Block:
    """The kind of record that a block serves, how many, its own budget and how many of the kind a scope may hold."""

    name: str
    kind: str
    header: str
    rows: int
    tokens: int = 512
    most: int = 2000


#: Kinds, sizes and budgets of the blocks; events are kept as semantic records.
EVENTS = Block("events", "semantic", "[events] Events of the day that the question names:", 3)
PROFILE = Block("profile", "profile", "[profile] What the user has said of themselves:", 8)


def side_block(questions: DataFrame, records: DataFrame, block: Block, score: Callable[[Column, Column], Column]) -> DataFrame:
    """``query_id, slot, id, value, tokens`` of ``questions(query_id, scope, text, open, lo, hi)``.

    Only a question whose gate is ``open`` has a block, of ``records(id, scope, kind, text, day)`` of its scope and the
    block's kind; with ``lo`` and ``hi`` only those whose day lies between. A scope that holds more of the kind than the
    block may rank is refused whole rather than ranked in part. The best rows by ``score(question, text)``, equals by id,
    fill the budget greedily; a header stands before them in slot 0. A question without candidates, or whose scope is null,
    has no block.
    """
    mine = records.filter(F.col("kind") == block.kind)
    held = mine.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= block.most).select("scope")
    asked = questions.filter("open").select("query_id", "scope", F.col("text").alias("question"), "lo", "hi").join(held, "scope")
    near = F.coalesce(F.col("day").between(F.col("lo"), F.col("hi")), F.col("lo").isNull() & F.col("hi").isNull())
    met = asked.join(mine.select("scope", "id", "text", "day"), "scope").filter(near)  # at most ``most`` rows a question
    ranked = met.withColumn("score", F.round(score(F.col("question"), F.col("text")), 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= block.rows)
    head = ranked.withColumn("tokens", approx_tokens(F.col("text")))
    kept = compose.head_budget(head, block.rows, block.tokens).join(head.select("query_id", "id", "text"), ["query_id", "id"])
    rows = kept.select("query_id", F.col("position").alias("slot"), "id", F.col("text").alias("value"), "tokens")
    top = rows.select("query_id").distinct().select("query_id", F.lit(0).alias("slot"), F.lit(None).alias("id"), F.lit(block.header).alias("value"), approx_tokens(F.lit(block.header)).alias("tokens"))
    return top.select(*[F.col(c).cast(t) for c, t in rows.dtypes]).unionByName(rows)


def user_block(words: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """``query_id, id, tokens, position, total_tokens`` of turns.user_words() that fit, in order; one that does not is
    skipped, the first always stands."""
    return compose.head_budget(words, 1 << 30, max_tokens).select("query_id", "id", "tokens", "position", "total_tokens")
