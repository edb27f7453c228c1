"""Streaming forms: sessions by gap, resumable append, a running accumulator with reset, a failure guard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = "60 minutes"


def gap_sessions(turns: DataFrame, unit: str, at: str = "at", late: str = "10 minutes", gap: str = GAP) -> DataFrame:
    """Episodes of a turn stream: a session closes when no turn came for the gap and the watermark passed it."""
    windowed = turns.withWatermark(at, late).groupBy(unit, F.session_window(at, gap).alias("w"))
    counted = windowed.agg(F.count(F.lit(1)).alias("n_turns"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return counted.select(unit, "first_at", "last_at", "n_turns")


def accumulate(events: DataFrame, key: str, amount: str, threshold: float) -> DataFrame:
    """Fires for a key each time its running sum reaches the threshold, which is then taken off."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        fired = 0
        for frame in frames:
            for x in frame[amount]:
                total += float(x)
                while total >= threshold:
                    total -= threshold
                    fired += 1
        state.update((total,))
        yield pd.DataFrame({"key": [str(keys[0])], "fired": [fired], "left": [total]})

    return events.groupBy(key).applyInPandasWithState(step, "key string, fired int, left double", "total double", "update", GroupStateTimeout.NoTimeout)


class FailureGuard:
    """Stops a run once the failed-call rate is surely above a bound: Wilson's lower limit after enough calls."""

    def __init__(self, bound: float = 0.02, least: int = 9, z: float = 1.96):
        self.bound, self.least, self.z = bound, least, z
        self.calls = self.failed = 0

    def add(self, calls: int, failed: int) -> bool:
        """Count a batch; True if the run has to stop."""
        self.calls, self.failed = self.calls + calls, self.failed + failed
        if self.calls < self.least or not self.failed:
            return False
        n, p, z = self.calls, self.failed / self.calls, self.z
        low = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        return low > self.bound


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Write a stream of rows to a JSON sink once each, whatever is replayed."""
    from palimpsest.sources.bundles import append_missing

    return stream.writeStream.foreachBatch(lambda batch, _: append_missing(batch, path, key)).option("checkpointLocation", checkpoint).outputMode("append")
