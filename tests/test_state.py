"""Keyed state over streams: the same as in batch, in any order of micro-batches; TTL, timers and the days of a menu."""

import datetime as dt
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from pantrygrid.operators import dialogue, logs
from pantrygrid.operators import planner as p
from pantrygrid.plans import planner as q
from pantrygrid.streaming import state

NAMES = itertools.count()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State of a few keys: each partition of each micro-batch starts a worker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_by(spark, name, enough, seconds=40):
    """Rows of a table of a stream, once there are enough: with clock time a stream has never seen all."""
    for _ in range(2 * seconds):
        got = spark.table(name).collect()
        for query in spark.streams.active:
            if query.exception():
                raise query.exception()
        if enough(got):
            break
        time.sleep(0.5)
    return got


def streamed(spark, tmp_path, make, schema, batches, seconds=None):
    """Rows that a stream gives for files that come one after another; each is a micro-batch. With seconds one row a batch is awaited, and so long."""
    source = tmp_path / f"in{next(NAMES)}"
    source.mkdir()
    name = f"out{next(NAMES)}"
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"))
    query = stream.writeStream.format("memory").queryName(name).outputMode("update" if "turns" in stream.columns else "append").option("checkpointLocation", str(tmp_path / f"at{next(NAMES)}")).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{k}"))
            if seconds is None:
                query.processAllAvailable()
            else:
                rows_by(spark, name, lambda got: len(got) > k)
                time.sleep(seconds)
        return [r.asDict() for r in spark.table(name).collect()]
    finally:
        query.stop()


TURNS = "session long, turn long, day date, profile map<string,string>, plan string, eaten array<string>"


def turns():
    rnd = random.Random(3)
    rows = []
    for s in range(3):
        for t in range(9):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=20 * t + s)
            rows.append((s, t, day, {k: f"{k}{t}" for k in "abc" if rnd.random() < 0.4} or None, f"plan {t}" if rnd.random() < 0.4 else None, [f"e{t}.{i}" for i in range(rnd.randint(0, 2))] or None))
    return rows


def test_memory_is_that_of_the_batch_in_any_order(spark, tmp_path):
    rows = turns()
    want = {r["session"]: (dict(r["profile"] or {}), r["plan"], r["eaten"]) for r in dialogue.memory(spark.createDataFrame(rows, TURNS)).collect()}
    for seed in (0, 1):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        last = {}
        for r in streamed(spark, tmp_path, state.memory, TURNS, [mixed[i::4] for i in range(4)]):
            if r["turns"] >= last.get(r["session"], (0,))[0]:
                last[r["session"]] = (r["turns"], (json.loads(r["profile"]), r["plan"], r["eaten"]))
        assert {k: v for k, (_, v) in last.items()} == want


def test_an_untouched_session_starts_anew(spark, tmp_path):
    one = lambda t: [(1, t, dt.date(2024, 1, 1), {"a": str(t)}, f"plan {t}", ["x"])]
    kept = streamed(spark, tmp_path, lambda s: state.memory(s, ttl_ms=600_000), TURNS, [one(1), one(2)], seconds=0)
    gone = streamed(spark, tmp_path, lambda s: state.memory(s, ttl_ms=1500), TURNS, [one(1), one(2)], seconds=4)
    assert max(r["turns"] for r in kept) == 2 and max(r["turns"] for r in gone) == 1 and len(gone) == 2


def test_targets_are_those_of_the_batch_in_any_order(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, dt.datetime(2024, 1, 1, 6) + dt.timedelta(days=d), float(rnd.randint(1500, 2600))) for k in (1, 2) for d in sorted(rnd.sample(range(60), 25))]
    days = spark.createDataFrame([(k, ts.date(), t) for k, ts, t in rows], "key long, day date, tdee double")
    want = sorted((r["key"], r["day"], r["tdee"]) for r in dialogue.adapted(days, 2000.0).collect())
    far = [(9, dt.datetime(2030, 1, 1), 0.0)]
    for seed in (0, 1):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        got = streamed(spark, tmp_path, lambda s: state.targets(s, 2000.0, late="100 days"), "key long, ts timestamp, tdee double", [mixed[:20], mixed[20:33], mixed[33:], far])
        assert sorted((r["key"], r["day"], r["tdee"]) for r in got) == want
    assert len({t for *_, t in want}) > 4


def test_the_step_is_taken_from_the_last_target():
    first = dialogue.next_target(3000.0, 0, None, 2000.0, 0.1, 7)
    assert first == (2200.0, 0) and dialogue.next_target(3000.0, 6, first, 2000.0, 0.1, 7) == first
    assert dialogue.next_target(3000.0, 7, first, 2000.0, 0.1, 7) == (2420.0, 7)


def test_sessions_expire_as_in_batch(spark, tmp_path):
    rnd = random.Random(8)
    start = dt.datetime(2024, 3, 1)
    rows = [(k, start + dt.timedelta(minutes=rnd.randrange(0, 6000))) for k in (1, 2, 3) for _ in range(25)]
    rows += rows[:3]
    tup = lambda r: (r["session"], r["first"], r["updated"], r["events"])
    want = sorted(tup(r) for r in logs.sessions(spark.createDataFrame(rows, "session long, ts timestamp"), 6).collect())
    far = [(9, dt.datetime(2030, 1, 1))]
    for seed in (0, 1):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        got = streamed(spark, tmp_path, lambda s: state.expired(s, 6, late="10 days"), "session long, ts timestamp", [mixed[:30], mixed[30:], far])
        assert sorted(tup(r) for r in got) == want
    assert len(want) > 6


def test_days_of_a_menu_follow_on_a_timer(spark, tmp_path):
    dishes, people = q._dishes(spark, "/root/testdata/sf0.001"), q._people(spark, "/root/testdata/sf0.001").where("person < 4")
    rows = [tuple(r) for r in people.collect()]
    schema = ", ".join(f"{n} {t}" for n, t in people.dtypes)
    source = tmp_path / "asks"
    source.mkdir()
    stream = state.menus(spark.readStream.schema(schema).parquet(f"{source}/*"), dishes, 4, retries=0, steps=30)
    query = stream.writeStream.format("memory").queryName("menus").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / "b0"))
        first = {r["day"] for r in rows_by(spark, "menus", len)}
        got = rows_by(spark, "menus", lambda got: len({(r["person"], r["day"]) for r in got}) == 4 * len(rows))
    finally:
        query.stop()
    assert first and 3 not in first  # the first days come before the last is made
    assert sorted(map(tuple, got)) == sorted(map(tuple, p.menu(dishes, people, 4, retries=0, steps=30).collect()))


def test_a_large_catalogue_is_refused(spark, monkeypatch):
    monkeypatch.setattr(p, "HELD", 3)
    dishes, people = q._dishes(spark, "/root/testdata/sf0.001"), q._people(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="more than a task holds"):
        state.menus(people, dishes, 2)


class Places:
    """A counter of places with leases, event by event."""

    def __init__(self, limit, length):
        self.limit, self.length, self.held = limit, length, {}

    def acquire(self, t, lease):
        self.held = {x: end for x, end in self.held.items() if end > t}
        if lease in self.held or len(self.held) < self.limit:
            self.held[lease] = t + self.length
            return True
        return False

    def release(self, lease):
        self.held.pop(lease, None)


def test_places_with_leases_are_those_of_a_plain_counter(spark, tmp_path):
    rnd = random.Random(4)
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    rows, want, places = [], {}, {k: Places(2, 60) for k in (1, 2)}
    for i in range(120):
        k, t, lease, kind = rnd.choice([1, 2]), 7 * i, f"l{rnd.randrange(6)}", rnd.choice(["acquire", "acquire", "release"])
        rows.append((k, i, start + dt.timedelta(seconds=t), kind, lease))
        if kind == "acquire":
            want[i] = places[k].acquire(t, lease)
        else:
            places[k].release(lease)
    got = streamed(spark, tmp_path, lambda s: state.slots(s, 2, 60), "key long, id long, ts timestamp, kind string, lease string", [rows[:50], rows[50:51], rows[51:]])
    assert {r["id"]: r["granted"] for r in got} == want and set(want.values()) == {True, False}
