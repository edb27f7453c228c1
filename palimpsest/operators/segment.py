"""Turn streams into episodes and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import approx_tokens
from palimpsest.functions.vectors import cosine
from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.ranks import spread_scan

GAP_SECONDS, TOKEN_CAP = 3600, 512
#: Turns of a unit that may be folded in one row.
FOLD_TURNS = 1000
#: Places of a unit whose pointers are followed in one go.
BLOCK = 1 << 14


def episodes(
    turns: DataFrame, unit: str, order: str, text: str = "text", at: str | None = None, gap_seconds: int = GAP_SECONDS, token_cap: int = TOKEN_CAP,
    topic: str | None = None, fold_turns: int = FOLD_TURNS,
) -> DataFrame:
    """``turns`` with ``episode`` (from 0 within the unit) and ``ended_by``.

    A new unit always opens an episode, then a gap of more than ``gap_seconds``, then a turn whose ``topic`` flag is
    set, then a turn that would take the open episode over ``token_cap``; a turn over the cap stands alone. ``order``
    must be unique within a unit; a null time makes no gap, a null flag no topic, a null text no tokens. The last turn of
    an episode says why it ended. Units of up to ``fold_turns`` turns are folded in a row of their own; longer ones, which
    no task need hold, are cut by running totals and pointers (spread_starts). Both give the same episodes.
    """
    flag = F.lit(False) if topic is None else F.coalesce(F.col(topic), F.lit(False))
    when = F.lit(None).cast("long") if at is None else F.unix_timestamp(at)
    own = lambda rows: rows.select(unit, order, F.coalesce(approx_tokens(F.col(text)), F.lit(0)).cast("long").alias("tokens"), when.alias("at"), flag.alias("topic"))
    sizes = cut_lineage(turns.groupBy(unit).agg(F.count(F.lit(1)).alias("n")))
    long_units, short_units = (sizes.filter(c).select(unit) for c in (F.col("n") > fold_turns, F.col("n") <= fold_turns))
    if long_units.isEmpty():
        cut = _folded(own(turns), unit, order, gap_seconds, token_cap)
    else:
        long_turns = cut_lineage(own(turns.join(long_units, unit, "left_semi")))  # texts are read once
        cut = spread_starts(long_turns, unit, order, gap_seconds, token_cap)
        if not short_units.isEmpty():
            cut = _folded(own(turns.join(short_units, unit, "left_semi")), unit, order, gap_seconds, token_cap).unionByName(cut)
    return turns.join(cut, [unit, order])


def _folded(own: DataFrame, unit: str, order: str, gap_seconds: int, token_cap: int) -> DataFrame:
    """``unit, order, episode, ended_by`` by one pass over the turns of a unit, held in its row."""
    rows = own.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(F.col(order), "tokens", "at", "topic"))).alias("rows"))
    start = F.expr("named_struct('used', 0L, 'at', cast(null as bigint), 'part', -1, 'cuts', cast(array() as array<struct<part:int,why:string>>))")

    def step(acc, x):
        why = F.when(acc["part"] < 0, "first").when(x["at"] - acc["at"] > gap_seconds, "time_gap").when(x["topic"], "topic_shift").when(acc["used"] + x["tokens"] > token_cap, "token_cap")
        part = acc["part"] + why.isNotNull().cast("int")
        used = F.when(why.isNotNull(), x["tokens"]).otherwise(acc["used"] + x["tokens"])
        return F.struct(used.alias("used"), x["at"].alias("at"), part.alias("part"), F.array_append(acc["cuts"], F.struct(part.alias("part"), why.alias("why"))).alias("cuts"))

    cuts = F.aggregate("rows", start, step, lambda acc: acc["cuts"])
    placed = rows.select(unit, F.posexplode(F.arrays_zip(F.col("rows"), cuts.alias("cuts"), F.slice(cuts, 2, F.greatest(F.size("rows"), F.lit(1))).alias("after"))).alias("k", "z"), F.size("rows").alias("n"))
    ended = F.when(F.col("k") + 1 == F.col("n"), "end_of_unit").otherwise(F.col("z.after.why"))
    return placed.select(unit, F.col(f"z.rows.{order}").alias(order), F.col("z.cuts.part").cast("long").alias("episode"), ended.alias("ended_by"))


def spread_starts(own: DataFrame, unit: str, order: str, gap_seconds: int, token_cap: int) -> DataFrame:
    """``unit, order, episode, ended_by`` of units of any length, spread over tasks.

    Running totals of tokens tell for each turn which later turn would pass the cap, were an episode to begin with it: the
    turn whose stretch of the total holds the sum, found by an equi-join on stretches of ``token_cap`` tokens. Episodes
    begin at gaps and topics and wherever those pointers lead from there (reached).
    """
    counted = spread_scan(own, unit, [order], {"idx": F.lit(1), "total": F.col("tokens")}, {"before": F.col("at")})
    why = F.when(F.col("idx") == 1, "first").when(F.col("at") - F.col("before") > gap_seconds, "time_gap").when(F.col("topic"), "topic_shift")
    marked = spread_scan(counted.withColumn("why", why), unit, ["idx"], {"run": F.col("why").isNotNull().cast("long")})
    turns = cut_lineage(marked.select(unit, order, "idx", "tokens", "total", "why", "run"))

    cell = lambda c: F.floor(c / token_cap)
    low = F.col("total") - F.col("tokens")
    held = turns.filter("tokens > 0").select(unit, "run", "idx", "total", F.explode(F.sequence(cell(low), cell(F.col("total") - 1))).alias("cell"))
    cells = held.groupBy(unit, "cell").agg(F.array_sort(F.collect_list(F.struct("total", "idx", "run"))).alias("ends"))  # at most token_cap + 1
    past = turns.withColumn("limit", low + token_cap).withColumn("cell", cell(F.col("limit"))).join(cells, [unit, "cell"])
    over = past.withColumn("over", F.get(F.filter("ends", lambda x: x["total"] > F.col("limit")), F.lit(0)))
    following = F.when(F.col("over.idx") == F.col("idx"), F.col("idx") + 1).when(F.col("over.run") == F.col("run"), F.col("over.idx"))
    jumps = cut_lineage(over.select(unit, "idx", following.alias("to")).filter("to IS NOT NULL"))

    starts = reached(cut_lineage(turns.filter("why IS NOT NULL").select(unit, "idx")), jumps, unit)
    opened = turns.join(starts.withColumn("opens", F.lit(1)), [unit, "idx"], "left")
    numbered = spread_scan(opened.select(unit, order, "idx", "why", "opens"), unit, ["idx"], {"episode": F.coalesce("opens", F.lit(0)).cast("long")})
    ends = opened.filter("opens = 1").select(unit, (F.col("idx") - 1).alias("idx"), F.coalesce("why", F.lit("token_cap")).alias("ended"))
    last = turns.groupBy(unit).agg(F.max("idx").alias("idx")).withColumn("ended", F.lit("end_of_unit"))
    met = numbered.join(ends.unionByName(last), [unit, "idx"], "left")
    return met.select(unit, order, (F.col("episode") - 1).alias("episode"), F.col("ended").alias("ended_by"))


def reached(starts: DataFrame, jumps: DataFrame, unit: str, block: int = BLOCK) -> DataFrame:
    """``unit, idx`` of all places to which ``jumps(unit, idx, to)``, one a place and forwards, lead from the starts.

    Pointers are followed inside blocks of ``block`` places first. Paths that meet stay together, so what leads out of a
    block is a few places; pointers from those alone are doubled, in as many rounds as the logarithm of the blocks of a
    path, and then every block follows what leads into it. A pointer thus moves three times, however long its path is.
    """
    kind = dict(jumps.dtypes)[unit]
    dealt = lambda rows: rows.withColumn("block", F.floor(F.col("idx") / block))
    placed = dealt(jumps.select(unit, F.col("idx").cast("long").alias("idx"), F.col("to").cast("long").alias("to"))).groupBy(unit, "block")
    first = starts.select(unit, F.col("idx").cast("long").alias("idx")).distinct()

    def out(key, rows):
        idx, to = _ascending(rows)
        ends = np.unique(to[_ends(idx, to)])
        return pa.table({unit: pa.repeat(key[0], len(ends)), "idx": ends})

    def through(key, rows, entries):
        idx, to = _ascending(rows)
        entries = entries.filter(pa.array(np.isin(entries.column("idx").to_numpy(), idx)))
        at = np.searchsorted(idx, entries.column("idx").to_numpy())
        return pa.table({unit: pa.repeat(key[0], len(at)), "idx": entries.column("idx"), "to": to[_ends(idx, to)[at]], "first": entries.column("first")})

    def inside(key, rows, entries):
        idx, to = _ascending(rows)
        given = entries.column("idx").to_numpy()
        met = np.isin(idx, given).tolist()
        for k, after in enumerate(_following(idx, to).tolist()):  # pointers lead forwards
            if met[k]:
                met[after] = True
        found = np.union1d(idx[np.array(met, bool)], given)
        return pa.table({unit: pa.repeat(key[0], len(found)), "idx": found})

    places = f"{unit} {kind}, idx long"
    exits = placed.applyInArrow(out, places).distinct().withColumn("first", F.lit(False))
    entries = dealt(first.withColumn("first", F.lit(True)).unionByName(exits)).groupBy(unit, "block")
    coarse = cut_lineage(placed.cogroup(entries).applyInArrow(through, f"{places}, to long, first boolean"))
    led = cut_lineage(coarse.filter("first").select(unit, F.col("to").alias("idx")).distinct())
    led = _doubled(led, cut_lineage(coarse.filter("NOT first").drop("first")), unit)
    return placed.cogroup(dealt(first.unionByName(led).distinct()).groupBy(unit, "block")).applyInArrow(inside, places)


def _ascending(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    idx, to = rows.column("idx").to_numpy(), rows.column("to").to_numpy()
    order = np.argsort(idx, kind="stable")
    return idx[order], to[order]


def _following(idx: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where each pointer's target stands among the pointers; its own place if it leads out of them."""
    at = np.minimum(np.searchsorted(idx, to), max(0, len(idx) - 1))
    return np.where(idx[at] == to, at, np.arange(len(idx)))


def _ends(idx: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which pointer leads out of them at last, for each pointer."""
    last = _following(idx, to)
    while (last != last[last]).any():
        last = last[last]
    return last


def _doubled(starts: DataFrame, jumps: DataFrame, unit: str) -> DataFrame:
    """As reached(), by doubling all pointers: rounds that join all of them."""
    while not jumps.isEmpty():
        led = starts.join(jumps, [unit, "idx"]).select(unit, F.col("to").alias("idx"))
        starts = cut_lineage(starts.unionByName(led).distinct())
        further = jumps.select(unit, F.col("idx").alias("to"), F.col("to").alias("beyond"))
        jumps = cut_lineage(jumps.join(further, [unit, "to"]).select(unit, "idx", F.col("beyond").alias("to")))
    return starts


def windows(turns: DataFrame, unit: str, position: str, size: int = 25, stride: int = 20) -> DataFrame:
    """``unit, window, lo, hi``: overlapping windows over positions 0..n-1; the last one ends at n."""
    n = turns.groupBy(unit).agg((F.max(position) + 1).alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / stride)).cast("int")
    spread = n.select(unit, "n", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return spread.select(unit, "window", (F.col("window") * stride).alias("lo"), F.least(F.col("n"), F.col("window") * stride + size).alias("hi"))


def adjacent_similarity(vectors: DataFrame, unit: str, order: str) -> DataFrame:
    """Cosine of each row with the next one of its unit."""
    after = F.lead("vector").over(Window.partitionBy(unit).orderBy(order))
    return vectors.withColumn("after", after).filter(F.col("after").isNotNull()).withColumn("similarity", F.round(cosine(F.col("vector"), F.col("after")), 9)).drop("after")


def depths(similarities: DataFrame, unit: str, order: str, width: int = 2) -> DataFrame:
    """Mean of ``width`` similarities on each side less twice the one between; null where a side is short."""
    w = Window.partitionBy(unit).orderBy(order)
    left, right = w.rowsBetween(-width, -1), w.rowsBetween(1, width)
    whole = (F.count("similarity").over(left) == width) & (F.count("similarity").over(right) == width)
    depth = F.avg("similarity").over(left) + F.avg("similarity").over(right) - 2 * F.col("similarity")
    return similarities.withColumn("depth", F.when(whole, F.round(depth, 6)))


def boundary_candidates(depth_rows: DataFrame, unit: str, order: str) -> DataFrame:
    """Strict local maxima of depth of at least the mean less half a (population) deviation."""
    w = Window.partitionBy(unit)
    near = w.orderBy(order)
    side = lambda c: F.coalesce(c, F.lit(float("-inf")))
    peak = (F.col("depth") > side(F.lag("depth").over(near))) & (F.col("depth") > side(F.lead("depth").over(near)))
    bound = F.avg("depth").over(w) - 0.5 * F.stddev_pop("depth").over(w)
    kept = depth_rows.filter(F.col("depth").isNotNull()).withColumn("keep", peak & (F.round("depth", 6) >= F.round(bound, 6)))
    return kept.filter("keep").drop("keep")


def merged_windows(centers: DataFrame, key: str, position: str, radius: int = 1) -> DataFrame:
    """``key, lo, hi``: each center with ``radius`` on both sides; windows that touch or overlap are one."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    spans = centers.select(key, F.greatest(F.lit(0), F.col(position) - radius).alias("lo"), (F.col(position) + radius).alias("hi"))
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("new", new).withColumn("island", island).groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def previous_of(rows: DataFrame, unit: str, order: str, condition, columns: list[str]) -> DataFrame:
    """As-of backwards: for each row, ``columns`` of the latest earlier row of its unit that meets the condition."""
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        rows = rows.withColumn(f"previous_{c}", F.last(F.when(condition, F.col(c)), ignorenulls=True).over(w))
    return rows


def accumulator_fires(events: DataFrame, key: str, order: str, amount: str, threshold: float) -> DataFrame:
    """Rows at which a running sum passes another multiple of the threshold (amounts below the threshold)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(amount).over(w)
    passed = F.floor(F.round(total, 6) / threshold)
    return events.withColumn("passed", passed).withColumn("fires", passed > F.floor(F.round(total - F.col(amount), 6) / threshold))
