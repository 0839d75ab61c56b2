"""Series, logs, counters and limits over keyed events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.operators.menus import numbered

def slopes(points: DataFrame) -> DataFrame:
    """key, slope: the median of the slopes between all pairs of a key's points (key, day: date, y), by Theil and Sen. Points of a key and day are one, by their mean."""
    daily = points.groupBy("key", "day").agg(F.avg("y").alias("y"))
    a, b = daily.alias("a"), daily.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.day") < F.col("b.day")))
    return pairs.groupBy(F.col("a.key").alias("key")).agg(F.percentile((F.col("b.y") - F.col("a.y")) / F.datediff("b.day", "a.day"), F.lit(0.5)).alias("slope"))


def filled(points: DataFrame) -> DataFrame:
    """Every day from a key's first to its last (key, day, y), days without a value with the last one before."""
    ends = points.groupBy("key").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("key", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    so_far = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(points, ["key", "day"], "left").select("key", "day", F.last("y", ignorenulls=True).over(so_far).alias("y"))


def decide(times: list[float], hits: list[float], limit: int, window: float) -> list[tuple[bool, float]]:
    """Decisions at times given the accepted hits still in the window (changed in place): rejected ones are not kept."""
    out = []
    for t in times:
        while hits and t - hits[0] >= window:
            hits.pop(0)
        ok = len(hits) < limit
        out.append((ok, 0.0 if ok else window - (t - hits[0])))
        if ok:
            hits.append(t)
    return out


def rate_limited(events: DataFrame, limit: int, window: float) -> DataFrame:
    """key, id, accepted, wait of events (key, id, t: seconds): at most limit accepted in any window; a rejected event does not count.

    The rule feeds back, so a key's events are met in order. They stream through a task batch by batch; all that is kept
    of them is the accepted hits of the last window, so a key of any size is met in little memory.
    """

    def run(batches):
        key, hits = None, []
        for pdf in batches:
            out = []
            for k, part in pdf.groupby("key", sort=False, dropna=False):
                if k != key and not (pd.isna(k) and pd.isna(key) and key is not None):
                    key, hits = k, []
                ok, wait = zip(*decide(part["t"].tolist(), hits, limit, window))
                out.append(pd.DataFrame({"key": part["key"], "id": part["id"], "accepted": ok, "wait": wait}))
            if out:
                yield pd.concat(out)

    ordered = events.select("key", "id", "t").repartition("key").sortWithinPartitions("key", "t", "id")
    return ordered.mapInPandas(run, "key long, id long, accepted boolean, wait double")


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id, n, transcript: the turns in order, one line each. A conversation is one row, as long as it is."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n").alias("transcript"))


def markdown(turns: DataFrame) -> DataFrame:
    """conv_id, number, markdown of turns (conv_id, turn, role, text): conversations numbered in order of their first turn, turns under headings. A conversation is one row, as long as it is."""
    quoted = lambda text: F.concat(F.lit("> "), F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\n> ")))
    said = lambda t: F.concat(F.lit("### "), t["turn"].cast("string"), F.lit(". "), t["role"], F.lit("\n\n"), F.when(t["role"] == "user", quoted(t["text"])).otherwise(F.coalesce(t["text"], F.lit("—"))))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    got = numbered(whole.select("conv_id", F.array_join(F.transform("x", said), "\n\n").alias("body")), "conv_id", "number")
    return got.select("conv_id", (F.col("number") + 1).alias("number"), F.concat(F.lit("## Conversation "), (F.col("number") + 1).cast("string"), F.lit("\n\n"), "body").alias("markdown"))


def window_view(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """id, n, retry_after of events (key, id, t: microseconds): all events of the last window, and, over the limit, seconds until the first of them leaves it. An upper bound only: the limiter does not count what it rejects."""
    last = Window.partitionBy("key").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return events.select("id", F.count("*").over(last).alias("n"), F.when(F.count("*").over(last) > limit, seconds - (F.col("t") - F.min("t").over(last)) / 1e6).otherwise(0.0).alias("retry_after"))


def sessions(events: DataFrame, hours: float) -> DataFrame:
    """session, first, updated, events: stretches of a key's events (session, ts) with no pause of over so many hours; times to the millisecond."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    order = Window.partitionBy("session").orderBy("ms")
    opens = F.coalesce(F.col("ms") - F.lag("ms").over(order) > int(hours * 3_600_000), F.lit(True))
    cut = events.select("session", ms.alias("ms")).withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(order))
    return cut.groupBy("session", "part").agg(F.timestamp_millis(F.min("ms")).alias("first"), F.timestamp_millis(F.max("ms")).alias("updated"), F.count("*").alias("events")).drop("part")


def trace_steps(turns: DataFrame) -> DataFrame:
    """turn, pos, node, seconds, calls of turns (turn, trace): a trace is a JSON array of {node, seconds, llm: answers of a model, if there were any}.

    Traces are parsed once, to variants; one that is no JSON, or no array, has no steps, and a field of another kind is null.
    """
    return turns.sparkSession.sql(
        """SELECT t.turn, s.pos, try_variant_get(s.value, '$.node', 'string') AS node, try_variant_get(s.value, '$.seconds', 'double') AS seconds,
                  coalesce(size(try_variant_get(s.value, '$.llm', 'array<variant>')), 0) AS calls
           FROM (SELECT turn, try_parse_json(trace) AS trace FROM {turns}) t, LATERAL variant_explode(t.trace) s
           WHERE schema_of_variant(t.trace) LIKE 'ARRAY%'""",
        turns=turns,
    )


def step_medians(steps: DataFrame) -> DataFrame:
    """node, turns, seconds, calls of steps (turn, pos, node, seconds, calls): the median of a node's seconds in a turn (they add up), and the mean of its calls."""
    each = steps.groupBy("turn", "node").agg(F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls"))
    return each.groupBy("node").agg(F.count("*").alias("turns"), F.percentile("seconds", F.lit(0.5)).alias("seconds"), F.avg("calls").alias("calls"))


def slots(events: list[tuple], leases: dict[str, float], limit: int, length: float) -> list[bool | None]:
    """Whether each acquire of a key's events (t, kind: acquire or release, lease), in their order, gets one of limit places; None for a release.

    leases: places taken, with the time that each ends at, which this changes. A lease that nobody releases ends by itself
    after length; who holds it and asks again keeps it for longer. Releasing what is not held does nothing.
    """
    out = []
    for t, kind, lease in events:
        for gone in [x for x, end in leases.items() if end <= t]:
            del leases[gone]
        if kind == "release":
            leases.pop(lease, None)
            out.append(None)
            continue
        free = lease in leases or len(leases) < limit
        if free:
            leases[lease] = t + length
        out.append(free)
    return out
