"""Reading trajectories as text: lists, summaries, searches and windows of their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GREP_LINES, GREP_STATES, LINE_CHARS, READ_LINES = 40, 400, 240, 150


def listing(headers: DataFrame) -> DataFrame:
    """``line`` by start URL and id."""
    goal = F.regexp_replace(F.trim("goal"), r"\s+", " ")
    return headers.orderBy("start_url", "id").select(F.concat(F.lit("- "), F.concat_ws(" | ", "id", "start_url", "outcome", goal)).alias("line"))


def summary(states: DataFrame) -> DataFrame:
    """``trajectory, last_state, actions``: numbered actions, each with the state it led to."""
    acted = F.col("action").isNotNull() & (F.trim("action") != "")
    n = F.sum(acted.cast("int")).over(Window.partitionBy("trajectory").orderBy("state_index"))
    line = F.when(acted, F.concat(n.cast("string"), F.lit(". "), F.col("action"), F.lit(" -> state "), F.col("state_index").cast("string"), F.lit(" ("), F.col("url"), F.lit(")")))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("state_index", "line")))), lambda x: x["line"])
    return states.withColumn("line", line).groupBy("trajectory").agg(F.max("state_index").alias("last_state"), F.array_join(lines, "\n").alias("actions"))


def grep(states: DataFrame, needle: str, most: int = GREP_LINES, most_states: int = GREP_STATES) -> DataFrame:
    """``trajectory, state_index, line_no, line``: the first lines that hold the needle, whatever the case.

    A page is searched as a whole before its lines are unfolded; at most ``most_states`` states are read.
    """
    low = needle.lower()
    hit = states.filter(F.contains(F.lower("page"), F.lit(low))).orderBy("trajectory", "state_index").limit(most_states)
    lines = hit.select("trajectory", "state_index", F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    found = lines.filter(F.contains(F.lower("line"), F.lit(low))).orderBy("trajectory", "state_index", "line_no").limit(most)
    return found.withColumn("line", F.left("line", F.lit(LINE_CHARS)))


def read(states: DataFrame, trajectory: str, state_index: int, from_line: int = 0, lines: int = READ_LINES) -> DataFrame:
    """``line_no, line`` of a window of one page."""
    page = states.filter((F.col("trajectory") == trajectory) & (F.col("state_index") == state_index))
    numbered = page.select(F.posexplode(F.split("page", "\n")).alias("line_no", "line"))
    return numbered.filter(F.col("line_no").between(from_line, from_line + lines - 1)).orderBy("line_no")


def span(states: DataFrame, trajectory: str, first: int, last: int, most: int = 20) -> DataFrame:
    """States first..last of a trajectory; a reversed or too long span is refused."""
    if last < first or last - first + 1 > most:
        raise ValueError(f"not a span of at most {most} states: {first}..{last}")
    return states.filter((F.col("trajectory") == trajectory) & F.col("state_index").between(first, last)).orderBy("state_index")


def anchored(headers: DataFrame, anchors: DataFrame, states: DataFrame) -> DataFrame:
    """States of the trajectories whose anchor record is there: ``headers(trajectory, record_id, ...)``,
    ``anchors(record_id, ...)``, ``states(trajectory, state_index, ...)``; their order is the state's index."""
    return headers.join(anchors, "record_id").join(states, "trajectory")


def exported(headers: DataFrame, states: DataFrame) -> DataFrame:
    """``id, json``: each trajectory as an indented ASCII document; a trajectory without states has an empty list.

    ``headers(id, goal, outcome, start_url)``, ``states(trajectory, state_index, step, url, action, thought, page)``.
    """
    part = F.struct("state_index", "step", "url", "action", "thought", "page")
    grouped = states.groupBy(F.col("trajectory").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("states"))
    rows = headers.select("id", "goal", "outcome", "start_url").join(grouped, "id", "left")

    def run(frames):
        import json

        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                told = [] if r.states is None else list(r.states)
                pages = [{"state_index": int(s["state_index"]), "step": int(s["step"]), "url": s["url"], "action": s["action"], "thoughts": s["thought"], "text": s["page"], "screenshot": f"screenshots/{int(s['state_index']):04}.png"} for s in told]
                actions = [s["action"] for s in told if s["action"] and s["action"].strip()]
                whole = {"id": r.id, "goal": r.goal, "outcome": r.outcome, "start_url": r.start_url, "actions": actions, "states": pages}
                out.append((r.id, json.dumps(whole, indent=2) + "\n"))
            yield pd.DataFrame(out, columns=["id", "json"])

    return rows.mapInPandas(run, f"id {dict(headers.dtypes)['id']}, json string")
