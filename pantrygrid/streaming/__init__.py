"""Streaming twins of the keyed operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrygrid.operators.logs import decide


def daily_counts(events: DataFrame, time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Events of each UTC day; a day is final once the watermark has passed it."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def rate_limited(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The limiter over a stream of events (key, id, t): state is the accepted hits of a key's last window, never more than limit. A key without events for two windows of clock time has no state."""

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["t", "id"])
        ok, wait = zip(*decide(pdf["t"].tolist(), hits, limit, window))
        state.update((hits,))
        state.setTimeoutDuration(max(int(2000 * window), 1000))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"], "accepted": ok, "wait": wait})

    out, kept = "key long, id long, accepted boolean, wait double", "hits array<double>"
    return events.select("key", "id", "t").groupBy("key").applyInPandasWithState(run, out, kept, "append", "ProcessingTimeTimeout")
