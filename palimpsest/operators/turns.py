"""Turns inside episodes: which of them carry a topic, which are shown, and what was asked before an answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import approx_tokens, words
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.ranks import spread_scan
from palimpsest.operators.segment import FOLD_TURNS, adjacent_similarity, boundary_candidates, depths, reached

#: Short replies that acknowledge, and bounds of key utterances.
ACKNOWLEDGEMENTS = (
    "hi", "hey", "hello", "bye", "goodbye", "thanks", "thank you", "ok", "okay", "sure", "yes", "yeah", "yep", "wow",
    "cool", "nice", "great", "awesome", "sounds good", "you too", "take care", "see you",
)
KEY_WORDS, ACK_WORDS, CONTENT_CHARS, RESTATED, MIN_KEY = 4, 8, 3, 0.8, 2
ELISION = "…"
PROMPT_TOKENS = 256


def key_utterances(turns: DataFrame, unit: str, order: str, text: str = "text", fold_turns: int = FOLD_TURNS) -> DataFrame:
    """``turns`` with ``key``: long enough, no acknowledgement, and no restatement of the key utterance before.

    ``order`` must be unique within a unit; a null text is no key. What is restated depends on what was kept: units of up
    to ``fold_turns`` turns are folded in order, in a row of their own; of longer ones each utterance points to the next
    that does not restate it, and the pointers are followed from the first (segment.reached). Both give the same keys.
    """
    spoken = words(F.coalesce(F.col(text), F.lit("")))
    joined = F.array_join(spoken, " ")
    ack = joined.isin(*ACKNOWLEDGEMENTS) | F.exists(F.array(*map(F.lit, ACKNOWLEDGEMENTS)), lambda c: joined.startswith(F.concat(c, F.lit(" "))))
    able = (F.size(spoken) >= KEY_WORDS) & ~((F.size(spoken) <= ACK_WORDS) & ack)
    content = F.array_sort(F.array_distinct(F.filter(spoken, lambda w: F.char_length(w) >= CONTENT_CHARS)))
    own = turns.select(unit, order, able.alias("able"), content.alias("content"))
    long_units = cut_lineage(turns.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_turns).select(unit))
    if long_units.isEmpty():
        found = _folded_keys(own, unit, order)
    else:
        few = _folded_keys(own.join(long_units, unit, "left_anti"), unit, order)
        found = few.unionByName(_spread_keys(own.join(long_units, unit, "left_semi"), unit, order))
    return turns.join(found, [unit, order])


def _restates(content: Column, before: Column) -> Column:
    shared = F.size(F.array_intersect(content, before)) / F.size(content)
    return F.coalesce(before.isNotNull() & (F.size(content) > 0) & (shared >= RESTATED), F.lit(False))


def _folded_keys(own: DataFrame, unit: str, order: str) -> DataFrame:
    rows = own.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(order, "able", "content"))).alias("rows"))
    start = F.expr("named_struct('before', cast(null as array<string>), 'keys', cast(array() as array<boolean>))")

    def step(acc: Column, x: Column) -> Column:
        key = x["able"] & ~_restates(x["content"], acc["before"])
        return F.struct(F.when(key, x["content"]).otherwise(acc["before"]).alias("before"), F.array_append(acc["keys"], key).alias("keys"))

    found = rows.select(unit, F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step, lambda a: a["keys"]).alias("keys"))).alias("z"))
    return found.select(unit, F.col(f"z.rows.{order}").alias(order), F.col("z.keys").alias("key"))


def _spread_keys(own: DataFrame, unit: str, order: str) -> DataFrame:
    """Stretches of able turns of the same content count as one when the next key is looked for, so that a round of
    looking goes on past a stretch; there are as many rounds as different restatements follow one another."""
    numbered = spread_scan(own.filter("able").select(unit, order, "content"), unit, [order], {"idx": F.lit(1)}, {"before": F.col("content")})
    new = F.coalesce((F.col("content") != F.col("before")).cast("long"), F.lit(1))
    able = cut_lineage(spread_scan(numbered.withColumn("new", new), unit, ["idx"], {"stretch": F.col("new")}).select(unit, order, "idx", "stretch", "content"))
    heads = able.groupBy(unit, "stretch").agg(F.min("idx").alias("head"), F.first("content").alias("other"))
    alike = able.groupBy(unit, "stretch").agg(F.max("idx").alias("last"))
    # within its own stretch a turn with content is restated by the next one; one without is not
    here = able.join(alike, [unit, "stretch"])
    plain = (F.size("content") == 0) & (F.col("idx") < F.col("last"))
    jumps = here.filter(plain).select(unit, "idx", (F.col("idx") + 1).alias("to"))
    open_ = cut_lineage(here.filter(~plain).select(unit, "idx", "content", (F.col("stretch") + 1).alias("stretch")))
    while not open_.isEmpty():
        met = open_.join(heads, [unit, "stretch"])
        again = _restates(F.col("other"), F.col("content"))
        jumps = cut_lineage(jumps.unionByName(met.filter(~again).select(unit, "idx", F.col("head").alias("to"))))
        open_ = cut_lineage(met.filter(again).select(unit, "idx", "content", (F.col("stretch") + 1).alias("stretch")))
    keys = reached(cut_lineage(able.filter("idx = 1").select(unit, "idx")), cut_lineage(jumps), unit)
    key = able.join(keys.withColumn("key", F.lit(True)), [unit, "idx"], "left_semi").select(unit, order, F.lit(True).alias("key"))
    return own.select(unit, order).join(key, [unit, order], "left").select(unit, order, F.coalesce("key", F.lit(False)).alias("key"))


def spaced_boundaries(candidates: DataFrame, unit: str, gap: str, depth: str, n_key: str, least: int = MIN_KEY) -> DataFrame:
    """Deepest first, the gaps that stay ``least`` key utterances from one another and from both ends.

    ``candidates(unit, gap, depth, n_key)``: a gap lies between key utterances ``gap`` and ``gap`` + 1 of ``n_key``.
    Candidates at a distance of ``least`` or more have no say over one another, so each run of closer ones is folded
    for itself, whatever the length of the unit.
    """
    opens = F.col(gap) + 1
    inside = candidates.filter((opens >= least) & (F.col(n_key) - opens >= least)).select(unit, F.col(gap).cast("long").alias("g"), F.col(depth).alias("depth"))
    placed = spread_scan(inside, unit, ["g"], {"nth": F.lit(1)}, {"before": F.col("g")})
    runs = spread_scan(placed.withColumn("new", F.coalesce((F.col("g") - F.col("before") >= least).cast("long"), F.lit(1))), unit, ["nth"], {"run": F.col("new")})
    rows = runs.groupBy(unit, "run").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "g"))).alias("rows"))
    start = F.array().cast("array<bigint>")
    take = lambda acc, x: F.when(F.forall(acc, lambda t: F.abs(t - x["g"]) >= least), F.array_append(acc, x["g"])).otherwise(acc)
    return rows.select(unit, F.explode(F.aggregate("rows", start, take)).alias(gap))


def topic_starts(turns: DataFrame, unit: str, order: str, text: str = "text", vector: str = "vector", width: int = 2, least: int = MIN_KEY, fold_turns: int = FOLD_TURNS) -> DataFrame:
    """``unit, order`` of the turns that open a topic, of ``turns`` that have a ``vector``.

    Only key utterances count. A topic opens behind a gap between two of them that is deeper than its neighbours and deep
    among the gaps of its unit, with ``least`` key utterances to the next such gap and to both ends. Units of fewer than
    2 ``width`` + 2 key utterances, and those whose depths are all alike, have none.
    """
    keyed = key_utterances(turns, unit, order, text, fold_turns).filter("key")
    placed = spread_scan(keyed.select(unit, order, F.col(vector).alias("vector")), unit, [order], {"nth": F.lit(1)})
    n = placed.groupBy(unit).agg(F.max("nth").alias("n_key")).filter(F.col("n_key") >= 2 * width + 2)
    gaps = adjacent_similarity(placed, unit, "nth").join(n, unit).withColumn("gap", F.col("nth") - 1)
    deep = depths(gaps.select(unit, "gap", "n_key", "similarity"), unit, "gap", width)
    varied = deep.filter("depth IS NOT NULL").groupBy(unit).agg((F.max("depth") > F.min("depth")).alias("varied")).filter("varied").select(unit)
    cut = spaced_boundaries(boundary_candidates(deep.join(varied, unit), unit, "gap"), unit, "gap", "depth", "n_key", least)
    return cut.select(unit, (F.col("gap") + 2).alias("nth")).join(placed, [unit, "nth"]).select(unit, order)


def turn_spans(text: str, speakers: list[str]) -> list[tuple[int, int]]:
    """(start, end) in characters of each turn; a line opens one if it begins with a speaker and a colon."""
    spans: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if spans and not any(line.startswith(f"{s}: ") for s in speakers):
            spans[-1] = spans[-1][0], end
        else:
            spans.append((at, end))
        at = end + 1
    return spans


def rendered(text: str, spans: list[tuple[int, int]], centers: list[int], radius: int = 1) -> str:
    """The turns around the centers, and a mark for each run of turns left out; without centers the whole text."""
    kept = sorted({t for c in centers if c < len(spans) for t in range(max(0, c - radius), min(len(spans), c + radius + 1))})
    if not kept:
        return text
    runs: list[list[int]] = []
    for t in kept:
        if runs and t == runs[-1][1] + 1:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    parts = [text[spans[lo][0] : spans[hi][1]] for lo, hi in runs]
    head = [ELISION] if spans[runs[0][0]][0] > 0 else []
    tail = [ELISION] if spans[runs[-1][1]][1] < len(text) else []
    return "\n".join([*head, f"\n{ELISION}\n".join(parts), *tail])


def select_turns(units: DataFrame, k: int, slots: int) -> DataFrame:
    """``query_id, owner, score, place, centers`` of the records that take a slot, best unit first.

    ``units(query_id, owner, turn, score)``: each turn of an episode, and with a null turn each other record of a
    query's pool, which the channels have cut. A record's first unit takes a slot; a later turn of a record that has
    one adds a center only while fewer than ``k`` units, centers included, are taken.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(order=rows["turn"].fillna(-1)).sort_values(["score", "owner", "order"], ascending=[False, True, True])
        taken: dict[int, tuple[float, list[int]]] = {}
        used = 0
        for owner, turn, score in zip(rows["owner"], rows["turn"], rows["score"], strict=True):
            center = [] if pd.isna(turn) else [int(turn)]
            if owner in taken:
                if used < k and center and taken[owner][1]:
                    taken[owner][1].extend(center)
                    used += 1
            elif len(taken) >= slots:
                break
            else:
                taken[owner] = score, center
                used += 1
        query = rows["query_id"].iloc[0]
        return pd.DataFrame([(query, o, s, n, c) for n, (o, (s, c)) in enumerate(taken.items(), 1)], columns=["query_id", "owner", "score", "place", "centers"])

    kind = dict(units.dtypes)
    return units.select("query_id", "owner", "turn", "score").groupBy("query_id").applyInPandas(walk, f"query_id {kind['query_id']}, owner {kind['owner']}, score double, place int, centers array<int>")


def _turns_of(text: Column) -> Column:
    """Turns of an episode of user and assistant lines, in order."""
    opens = lambda line, k: (k == 0) | line.startswith("user: ") | line.startswith("assistant: ")
    marked = F.transform(F.split(text, "\n"), lambda line, k: F.struct(opens(line, k).alias("opens"), line.alias("line")))
    add = lambda acc, x: F.when(x["opens"], F.array_append(acc, x["line"])).otherwise(
        F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(F.element_at(acc, -1), F.lit("\n"), x["line"]))
    )
    return F.aggregate(marked, F.array().cast("array<string>"), add)


def round_view(evidence: DataFrame, episodes: DataFrame, cap: int = PROMPT_TOKENS) -> DataFrame:
    """``query_id, id, outcome, predecessor, prompt``: the user's turn that an assistant's episode in the evidence answers.

    ``evidence(query_id, id)``, ``episodes(id, session, index, text)`` with the index of the first turn. The
    predecessor is the session's latest episode that begins earlier, of equals the one with the largest id; it must
    end right before and its last turn be the user's, not be evidence itself and fit the cap.
    """
    earlier = Window.partitionBy("session").orderBy("index").rangeBetween(Window.unboundedPreceding, -1)
    turns = _turns_of(F.col("text"))
    held = episodes.select("id", "session", "index", "text", F.size(turns).alias("n"), F.element_at(turns, -1).alias("last"))
    before = held.withColumn("p", F.max(F.struct(F.col("index").alias("at"), F.col("id").alias("pid"), "n", "last")).over(earlier))
    asked = evidence.select("query_id", "id").distinct().join(before.filter(F.col("text").startswith("assistant: ")).select("id", "index", "p"), "id")
    also = evidence.select("query_id", F.col("id").alias("pid"), F.lit(True).alias("shown")).distinct()
    met = asked.withColumn("pid", F.col("p.pid")).join(also, ["query_id", "pid"], "left")
    outcome = (
        F.when(F.col("pid").isNull(), "no_predecessor")
        .when(F.col("p.at") + F.col("p.n") != F.col("index"), "not_adjacent")
        .when(~F.col("p.last").startswith("user: "), "predecessor_not_user")
        .when(F.col("shown"), "predecessor_in_evidence")
        .when(approx_tokens(F.col("p.last")) > cap, "prompt_over_cap")
        .otherwise("fired")
    )
    done = met.withColumn("outcome", outcome)
    fired = F.col("outcome") == "fired"
    return done.select("query_id", "id", "outcome", F.when(fired, F.col("pid")).alias("predecessor"), F.when(fired, F.col("p.last")).alias("prompt"))


def user_words(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """``query_id, id, text, tokens, rank`` of the users' turns of the sessions that the evidence comes from, in order.

    ``evidence(query_id, session)``, ``turns(id, session, index, role, text)``; within_budget() cuts the block.
    """
    mine = turns.filter("role = 'user'").join(evidence.select("query_id", "session").distinct(), "session")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("session", "index", "id"))
    return mine.select("query_id", "id", "text", approx_tokens(F.col("text")).alias("tokens"), nth.alias("rank"))


def selected(pool: DataFrame, keep: Column, k: int) -> DataFrame:
    """The pool in a selector's order: the indices it names first (valid, once each, at most ``k``), then the rest.

    ``pool(query_id, n, ...)`` has positions ``n`` from 0; ``keep`` is the reply's array, null after a failed call.
    Gives ``place`` and ``degraded``: ``call_failed``, ``model_declined`` or ``none``; both faults keep rank order.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    named = F.slice(F.array_distinct(F.filter(keep.cast("array<bigint>"), lambda i: (i >= 0) & (i < F.col("size")))), 1, k)
    marked = pool.withColumn("size", size).withColumn("named", named)
    why = F.when(F.col("named").isNull(), "call_failed").when(F.size("named") == 0, "model_declined").otherwise("none")
    at = F.array_position("named", F.col("n").cast("bigint"))
    placed = marked.withColumn("degraded", why).withColumn("order", F.when(at > 0, at).otherwise(F.col("n") + k + 1))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("order"))).drop("size", "named", "order")
