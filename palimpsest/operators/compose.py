"""From ranked records to a budgeted evidence set.

Rows carry ``query_id`` and ``rank``. Set-wise steps are minima and bounded windows over any number of rows;
MMR and near-duplicates, which depend on all that was kept before, work on one query's head, which is bounded by
the depth that the channels were cut to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.checkpoints import cut_lineage
from palimpsest.operators.ranks import spread_rank


def _per_query():
    return Window.partitionBy("query_id")

TRUST_ORDER = ("verified", "asserted", "untrusted", "quarantined")


def distinct_texts(ranked: DataFrame) -> DataFrame:
    """Of equal texts of a query, the best ranked; copies are one row before anything moves."""
    rest = [c for c in ranked.columns if c not in ("query_id", "text", "rank")]
    best = ranked.groupBy("query_id", "text").agg(F.min(F.struct("rank", *rest)).alias("row"))
    return best.select(*[F.col(c) if c in ("query_id", "text") else F.col(f"row.{c}").alias(c) for c in ranked.columns])


def untrusted_ceiling(ranked: DataFrame, most: int) -> DataFrame:
    """At most ``most`` untrusted rows, the best ranked; each task cuts to so many before anything moves."""
    untrusted = F.coalesce(F.col("trust_tier") == "untrusted", F.lit(False))
    nth = F.row_number().over(_per_query().orderBy("rank"))
    first = ranked.filter(untrusted).withColumn("so_far", nth).filter(F.col("so_far") <= most).drop("so_far")
    return ranked.filter(~untrusted).unionByName(first)


def kind_quota(ranked: DataFrame, kind: str, reserved: int) -> DataFrame:
    """The first ``reserved`` rows of a kind go first; nothing is dropped. Gives ``position``."""
    nth = F.row_number().over(_per_query().orderBy("rank"))
    early = ranked.filter(F.col("kind") == kind).select("query_id", "rank").withColumn("nth", nth).filter(F.col("nth") <= reserved).select("query_id", "rank", F.lit(False).alias("late"))
    marked = ranked.join(early, ["query_id", "rank"], "left").withColumn("late", F.coalesce("late", F.lit(True)))
    return spread_rank(marked, "query_id", [F.col("late"), F.col("rank")], "position").drop("late")


def within_budget(ranked: DataFrame, k: int = 6, max_tokens: int = 2048) -> DataFrame:
    """Greedy: at most ``k`` rows; a row that does not fit is skipped, the first is always taken.

    Gives the kept rows' ``query_id, id, tokens, position`` with the query's ``total_tokens``,
    ``dropped_for_tokens`` and ``k_bound``. One pass a position: the next row is a minimum over those behind the last
    one that still fit, so that no query's rows are gathered, however many they are.
    """
    rows = ranked.select("query_id", F.struct("rank", "id").alias("place"), F.col("tokens").cast("long").alias("tokens"))
    least = F.min(F.struct("place", "tokens")).alias("row")
    taken = rows.groupBy("query_id").agg(least).select("query_id", F.col("row.place").alias("place"), F.col("row.tokens").alias("tokens"), F.lit(1).alias("position"), F.col("row.tokens").alias("used"))
    kept = state = cut_lineage(taken)
    for position in range(2, k + 1):
        last = state.select("query_id", F.col("place").alias("last"), "used")
        fits = rows.join(last, "query_id").filter((F.col("place") > F.col("last")) & (F.col("used") + F.col("tokens") <= max_tokens))
        found = fits.groupBy("query_id", "used").agg(least)
        state = cut_lineage(found.select("query_id", F.col("row.place").alias("place"), F.col("row.tokens").alias("tokens"), F.lit(position).alias("position"), (F.col("used") + F.col("row.tokens")).alias("used")))
        if state.isEmpty():
            break
        kept = kept.unionByName(state)
    ends = kept.groupBy("query_id").agg(F.max("used").alias("total_tokens"), F.max("position").alias("kept"), F.max("place").alias("last"))
    full = F.col("kept") == k
    seen = F.count_if(~full | (F.col("place") <= F.col("last")))
    totals = rows.join(ends, "query_id").groupBy("query_id", "total_tokens", "kept").agg((seen - F.col("kept")).cast("int").alias("dropped_for_tokens"), (F.count_if(full & (F.col("place") > F.col("last"))) > 0).alias("k_bound"))
    return kept.join(totals.drop("kept"), "query_id").select("query_id", F.col("place.id").alias("id"), "tokens", "position", "total_tokens", "dropped_for_tokens", "k_bound")


def head_quota(head: DataFrame, kind: str, reserved: int) -> DataFrame:
    """kind_quota() of heads that a channel has cut to a bounded depth: one window a query, nothing is written down."""
    nth = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank"))
    late = ~((F.col("kind") == kind) & (F.col("_nth") <= reserved))
    return head.withColumn("_nth", nth).withColumn("_late", F.coalesce(late, F.lit(True))).withColumn("position", F.row_number().over(_per_query().orderBy("_late", "rank"))).drop("_nth", "_late")


def head_budget(head: DataFrame, k: int = 6, max_tokens: int = 2048) -> DataFrame:
    """within_budget() of heads of a bounded depth: a fold over the rows of a query, which one row holds."""
    rows = head.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("tokens").cast("long").alias("tokens")))).alias("rows"))
    kind = dict(head.dtypes)["id"]
    start = F.expr(f"named_struct('used', 0L, 'kept', cast(array() as array<struct<id:{kind},tokens:bigint>>), 'dropped', 0, 'bound', false)")

    def step(acc, x):
        full = F.size(acc["kept"]) >= k
        fits = ~full & ((F.size(acc["kept"]) == 0) | (acc["used"] + x["tokens"] <= max_tokens))
        taken = F.array_append(acc["kept"], F.struct(x["id"].alias("id"), x["tokens"].alias("tokens")))
        return F.struct(
            F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, taken).otherwise(acc["kept"]).alias("kept"),
            (acc["dropped"] + (~full & ~fits).cast("int")).alias("dropped"), (acc["bound"] | full).alias("bound"),
        )

    done = rows.select("query_id", F.aggregate("rows", start, step).alias("d"))
    return done.select("query_id", "d", F.posexplode("d.kept").alias("at", "row")).select(
        "query_id", "row.id", "row.tokens", (F.col("at") + 1).alias("position"), F.col("d.used").alias("total_tokens"), F.col("d.dropped").alias("dropped_for_tokens"), F.col("d.bound").alias("k_bound")
    )


def composed(head: DataFrame, k: int = 6, max_tokens: int = 2048, untrusted: int | None = None, quota: tuple[str, int] | None = None, by_time: bool = False) -> DataFrame:
    """``query_id, id, slot, tokens, total_tokens, dropped_for_tokens, k_bound, trust`` of ranked heads.

    ``head(query_id, id, rank, text, tokens, kind, trust_tier, t_valid)`` is what the channels have cut. Of equal texts the
    best ranked stays, then no more than ``untrusted`` rows that are not trusted, then ``quota`` (kind, number) go first; the
    budget takes rows in that order, and what it takes stands by time or best first and last. ``trust`` is the set's weakest.
    One lazy plan: nothing is written down and no job runs.
    """
    rows = distinct_texts(head.select("query_id", "rank", "text", "id", "tokens", "kind", "trust_tier", "t_valid"))
    if untrusted is not None:
        rows = untrusted_ceiling(rows, untrusted)
    if quota is not None:
        rows = head_quota(rows, *quota).drop("rank").withColumnRenamed("position", "rank")
    kept = head_budget(rows, k, max_tokens)
    shown = kept.join(rows.select("query_id", "id", "trust_tier", "t_valid"), ["query_id", "id"])
    placed = chronological(shown, rank="position").withColumnRenamed("place", "slot") if by_time else bookend(shown)
    trust = weakest_tier(shown).select("query_id", F.col("trust_tier").alias("trust"))
    return placed.join(trust, "query_id").select("query_id", "id", F.col("slot").cast("int").alias("slot"), "tokens", "total_tokens", "dropped_for_tokens", "k_bound", "trust")


def mmr(ranked: DataFrame, k: int = 6, trade: float = 0.7, max_tokens: int = 2048) -> DataFrame:
    """Maximal marginal relevance over ``query_id, id, rank, tokens, vector``; relevance is by rank.

    The first is the best ranked; then the row that gains most, ties to the better rank, among those that fit.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True)
        n = len(rows)
        v = np.array([np.asarray(x, float) for x in rows["vector"]])
        length = np.linalg.norm(v, axis=1, keepdims=True)
        unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        relevance = 1 - np.arange(n) / max(1, n - 1)
        tokens = rows["tokens"].to_numpy()
        chosen, used, nearest = [0], int(tokens[0]), np.maximum(0.0, unit @ unit[0])
        while len(chosen) < min(k, n):
            gain = np.round(trade * relevance - (1 - trade) * nearest, 9)
            gain[chosen] = -np.inf
            gain[used + tokens > max_tokens] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] == -np.inf:
                break
            chosen.append(best)
            used += int(tokens[best])
            nearest = np.maximum(nearest, unit @ unit[best])
        out = rows.loc[chosen, ["query_id", "id"]].copy()
        out["position"] = range(1, len(chosen) + 1)
        return out

    kind = dict(ranked.dtypes)
    return ranked.select("query_id", "id", "rank", "tokens", "vector").groupBy("query_id").applyInPandas(pick, f"query_id {kind['query_id']}, id {kind['id']}, position int")


def drop_near_kept(ranked: DataFrame, bound: float = 0.93) -> DataFrame:
    """Walk a query's rows best first; drop a row within ``bound`` cosine of one that was kept."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(["rank", "id"])
        kept, keep = [], []
        for x in rows["vector"]:
            v = np.asarray(x, float)
            length = np.linalg.norm(v)
            v = v / length if length > 0 else v
            fresh = not any(float(v @ u) >= bound for u in kept)
            keep.append(fresh)
            if fresh:
                kept.append(v)
        return rows.loc[keep, ["query_id", "id", "rank"]]

    kind = dict(ranked.dtypes)
    return ranked.select("query_id", "id", "rank", "vector").groupBy("query_id").applyInPandas(walk, f"query_id {kind['query_id']}, id {kind['id']}, rank {kind['rank']}")


def bookend(kept: DataFrame, column: str = "position") -> DataFrame:
    """Best first and last, worst in the middle: 1, 3, 5, ..., 6, 4, 2. Gives ``slot``."""
    sizes = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    r, n = F.col(column), F.col("_n")
    slot = F.when(r % 2 == 1, (r + 1) / 2).otherwise(n + 1 - r / 2)
    return kept.join(sizes, "query_id").withColumn("slot", slot.cast("int")).drop("_n")


def timeline(kept: DataFrame, day: str = "day") -> DataFrame:
    """One line a query: days from the first, in order of the day and id."""
    first = F.min(day).over(_per_query())
    dated = kept.withColumn("offset", F.datediff(day, first))
    line = F.struct(F.col(day).alias("d"), F.col("id").cast("string").alias("k"), F.concat(F.lit("+"), F.col("offset").cast("string"), F.lit("d "), F.col("id").cast("string")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "; ")
    return dated.groupBy("query_id").agg(lines.alias("timeline"), F.max("offset").alias("span_days"))


def weakest_tier(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """The least trusted tier of a set."""
    severity = F.coalesce(*[F.when(F.col("trust_tier") == t, F.lit(k)) for k, t in enumerate(TRUST_ORDER)], F.lit(TRUST_ORDER.index("untrusted")))
    worst = F.element_at(F.array(*map(F.lit, TRUST_ORDER)), F.max(severity) + 1)
    return rows.groupBy(key).agg(worst.alias("trust_tier"))


def chronological(kept: DataFrame, at: str = "t_valid", rank: str = "rank") -> DataFrame:
    """Oldest first, equals as they were ranked; gives ``place``."""
    return kept.withColumn("place", F.row_number().over(_per_query().orderBy(at, rank)))
