"""Keyed state of conversations over streams: memory of a session, weekly target, expiry, and menus whose days follow on a timer.

Each operator gives, over a stream, what its batch twin gives over the same rows, in whatever order the rows arrive within
the watermark. State of a key is a few values and small maps in the state store, not a list of all rows; what is older
than the memory reaches is removed, and a key that nothing touches goes by TTL or timer.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pantrygrid.operators import dialogue, logs, planner

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000
#: Fixed value: hours that an idle session lives.
SESSION_HOURS = 24


def state_store(spark: SparkSession) -> None:
    """Maps, TTL and timers need the state store that keeps its rows outside the heap."""
    if spark.conf.get(_STORE) != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)


class _Memory(StatefulProcessor):
    def __init__(self, days: int, ttl_ms: int | None):
        self.days, self.ttl_ms = days, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getMapState("profile", "key string", "turn long, value string", self.ttl_ms)
        self.plan = handle.getValueState("plan", "turn long, plan string", self.ttl_ms)
        self.eaten = handle.getMapState("eaten", "turn long", "day int, items string", self.ttl_ms)
        self.seen = handle.getValueState("seen", "turns long, today int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, today = self.seen.get() if self.seen.exists() else (0, None)
        for pdf in rows:
            for r in pdf.to_dict("records"):
                turn, day = int(r["turn"]), None if pd.isna(r["day"]) else (r["day"] - _EPOCH).days
                turns, today = turns + 1, day if today is None else today if day is None else max(today, day)
                for k, v in dict(r["profile"] if r["profile"] is not None else {}).items():
                    if not self.profile.containsKey((k,)) or self.profile.getValue((k,))[0] <= turn:
                        self.profile.updateValue((k,), (turn, v))
                if r["plan"] is not None and (not self.plan.exists() or self.plan.get()[0] <= turn):
                    self.plan.update((turn, r["plan"]))
                if day is not None and r["eaten"] is not None and len(r["eaten"]):
                    self.eaten.updateValue((turn,), (day, json.dumps(list(r["eaten"]))))
        self.seen.update((turns, today))
        kept = []
        for (turn,), (day, items) in list(self.eaten.iterator()):
            if today - day < self.days:
                kept.append((turn, json.loads(items)))
            else:  # today only grows, so it never counts again
                self.eaten.removeKey((turn,))
        profile = {k: v for (k,), (_, v) in self.profile.iterator()}
        yield pd.DataFrame({"session": [key[0]], "turns": [turns], "profile": [json.dumps(profile, sort_keys=True, ensure_ascii=False)], "plan": [self.plan.get()[1] if self.plan.exists() else None], "eaten": [[x for _, items in sorted(kept) for x in items]]})

    def close(self) -> None:
        pass


def memory(turns: DataFrame, days: int = dialogue.MEMORY_DAYS, ttl_ms: int | None = None) -> DataFrame:
    """session, turns (how many so far), profile (JSON object), plan, eaten after each batch of turns (session, turn, day, profile: map, plan, eaten: array), as dialogue.memory has them; a turn's number decides, not when it arrives. A session untouched for ttl_ms of clock time starts anew."""
    state_store(turns.sparkSession)
    out = "session long, turns long, profile string, plan string, eaten array<string>"
    own = turns.select("session", "turn", "day", "profile", "plan", "eaten")
    return own.groupBy("session").transformWithStateInPandas(_Memory(days, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None")


class _Targets(StatefulProcessor):
    def __init__(self, formula: float, step: float, days: int):
        self.formula, self.step, self.days = formula, step, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int", "tdee double")
        self.last = handle.getValueState("last", "tdee double, since int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, tdee in zip(pdf["ts"], pdf["tdee"]):
                day = (ts.date() - _EPOCH).days
                self.waiting.updateValue((day,), (float(tdee),))
                self.handle.registerTimer((day + 1) * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A day is over: its estimate, and any before it that still waits, in their order."""
        border, out = expiredTimerInfo.getExpiryTimeInMs() // _DAY_MS, []
        for day in sorted(d for (d,) in self.waiting.keys() if d < border):
            (found,) = self.waiting.getValue((day,))
            before = self.last.get() if self.last.exists() else None
            now = dialogue.next_target(found, day, before, self.formula, self.step, self.days)
            self.last.update(now)
            self.waiting.removeKey((day,))
            out.append((key[0], _EPOCH + dt.timedelta(days=day), now[0]))
        if out:
            yield pd.DataFrame(out, columns=["key", "day", "tdee"])

    def close(self) -> None:
        pass


def targets(estimates: DataFrame, formula: float, late: str = "2 days", step: float = 0.10, days: int = dialogue.CHANGE_DAYS) -> DataFrame:
    """key, day, tdee: the target after each day's estimate (key, ts, tdee), as dialogue.adapted has it. A day waits in state until the watermark has passed its end; one estimate a day, the last that came."""
    state_store(estimates.sparkSession)
    own = estimates.select("key", "ts", "tdee").withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(_Targets(formula, step, days), "key long, day date, tdee double", "Append", "EventTime")


class _Expiry(StatefulProcessor):
    def __init__(self, hours: float):
        self.ttl_ms = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts in pdf["ts"]:
                ms = int(ts.timestamp() * 1000)
                known = self.waiting.containsKey((ms,))
                self.waiting.updateValue((ms,), ((self.waiting.getValue((ms,))[0] if known else 0) + 1,))
                self.handle.registerTimer(ms + self.ttl_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The session ends where nothing came within its time after a moment; what came up to then belongs to it."""
        end = expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms
        moments = sorted(ms for (ms,) in self.waiting.keys())
        if any(end < ms <= end + self.ttl_ms for ms in moments):
            return
        own = [ms for ms in moments if ms <= end]
        if own:
            n = sum(self.waiting.getValue((ms,))[0] for ms in own)
            for ms in own:
                self.waiting.removeKey((ms,))
            yield pd.DataFrame({"session": [key[0]], "first": [pd.Timestamp(own[0], unit="ms")], "updated": [pd.Timestamp(own[-1], unit="ms")], "events": [n]})

    def close(self) -> None:
        pass


def expired(events: DataFrame, hours: float = SESSION_HOURS, late: str = "1 hour") -> DataFrame:
    """session, first, updated, events: sessions of events (session, ts) that had nothing for so many hours of event time, as logs.sessions has them. Their state goes with them; times count to the millisecond."""
    state_store(events.sparkSession)
    own = events.select("session", "ts").withWatermark("ts", late)
    return own.groupBy("session").transformWithStateInPandas(_Expiry(hours), "session long, first timestamp, updated timestamp, events long", "Append", "EventTime")


class _Menu(StatefulProcessor):
    def __init__(self, catalogue: pd.DataFrame, days: int, window: int, retries: int, steps: int, pause_ms: int):
        self.catalogue, self.days, self.window, self.retries, self.steps, self.pause_ms = catalogue, days, window, retries, steps, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pool = handle, planner.Pool(self.catalogue)
        self.menu = handle.getValueState("menu", "ask string, day int, recent string")

    def _planned(self, key, timerValues) -> pd.DataFrame:
        text, day, recent = self.menu.get()
        ask, recent = json.loads(text), [set(x) for x in json.loads(recent)]
        got = planner.next_day(self.pool, ask, day, recent, self.window, self.retries, self.steps)
        recent = [*recent, {d for _, d, _ in got[2]} if got else set()][-self.window :] if self.window else []
        if day + 1 < self.days:
            self.menu.update((text, day + 1, json.dumps([sorted(x) for x in recent])))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause_ms)
        else:
            self.menu.clear()
        rows = [(key[0], day, meal, d, s, got[0], got[1]) for meal, d, s in got[2]] if got else []
        return pd.DataFrame(rows, columns=["person", "day", "meal", "dish", "serving", "attempt", "failed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            last = pdf.to_dict("records")[-1]
        for timer in list(self.handle.listTimers()):  # a new menu takes the place of the one that is being made
            self.handle.deleteTimer(timer)
        ask = planner.ask_of(last)
        self.menu.update((json.dumps({k: [float(x) for x in v] if k == "shares" else v for k, v in ask.items()}), 0, "[]"))
        yield self._planned(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.menu.exists():
            yield self._planned(key, timerValues)

    def close(self) -> None:
        pass


def menus(asks: DataFrame, dishes: DataFrame, days: int, window: int = planner.VARIETY, retries: int = planner.RETRIES, steps: int = planner.STEPS, pause_ms: int = 1) -> DataFrame:
    """The rows of planner.menu for a stream of asks (as its people): the first day at once, each next one on a timer, so that nobody waits for a whole month.

    A person's state is the ask, the number of the next day and the dishes of the last window days; it goes with the last
    day. Every task holds the catalogue (dishes, a table), which must have HELD dishes at most; a larger one raises.
    """
    state_store(asks.sparkSession)
    many = dishes.count()
    if many > planner.HELD:
        raise ValueError(f"{many} dishes are more than a task holds ({planner.HELD})")
    whole = planner.with_defaults(asks).select("person", *planner._ASK)
    out = "person long, day int, meal int, dish long, serving double, attempt int, failed int"
    return whole.groupBy("person").transformWithStateInPandas(_Menu(planner.known(dishes).toPandas(), days, window, retries, steps, pause_ms), out, "Append", "ProcessingTime")


class _Slots(StatefulProcessor):
    def __init__(self, limit: int, length: float):
        self.limit, self.length = limit, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leases = handle.getMapState("leases", "lease string", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"])
        seconds = [ts.timestamp() for ts in pdf["ts"]]
        before = {lease: until for (lease,), (until,) in self.leases.iterator()}
        leases = dict(before)
        granted = logs.slots(list(zip(seconds, pdf["kind"], pdf["lease"])), leases, self.limit, self.length)
        for lease in before.keys() - leases.keys():
            self.leases.removeKey((lease,))
        for lease, until in leases.items():
            if before.get(lease) != until:
                self.leases.updateValue((lease,), (until,))
                self.handle.registerTimer(int(until * 1000) + 1)
        out = pd.DataFrame({"key": key[0], "id": pdf["id"], "granted": pd.Series(granted, index=pdf.index, dtype=object)})
        yield out[[x is not None for x in granted]].astype({"granted": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Leases that ended and that no event has cleared away."""
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for lease in [x for (x,), (until,) in list(self.leases.iterator()) if until <= now]:
            self.leases.removeKey((lease,))
        return iter(())

    def close(self) -> None:
        pass


def slots(events: DataFrame, limit: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """key, id, granted for each acquire of a stream of events (key, id, ts, kind: acquire or release, lease), as logs.slots decides; micro-batches come in order of time. A key's state is its open leases, limit at most; one that nobody releases goes when the watermark has passed its end."""
    state_store(events.sparkSession)
    own = events.select("key", "id", "ts", "kind", "lease").withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(_Slots(limit, seconds), "key long, id long, granted boolean", "Append", "EventTime")
