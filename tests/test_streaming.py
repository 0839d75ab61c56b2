import datetime as dt

from pantrygrid import streaming
from pantrygrid.operators import logs


def events(spark):
    return spark.createDataFrame([(1, k, float(t)) for k, t in enumerate([0, 10, 20, 59, 61, 65, 130])] + [(2, 50, 5.0)], "key long, id long, t double")


def run(stream, spark, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    return spark.table(name).collect()


def test_limiter_rejects_and_forgets_rejected():
    assert [ok for ok, _ in logs.decide([0, 10, 20, 59, 61, 65, 71], [], 2, 60)] == [True, True, False, False, True, False, True]


def test_stream_decides_as_batch(spark, tmp_path):
    batch = {(r["key"], r["id"]): (r["accepted"], r["wait"]) for r in logs.rate_limited(events(spark), 2, 60.0).collect()}
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, id long, t double").parquet(str(tmp_path / "in"))
    got = {(r["key"], r["id"]): (r["accepted"], r["wait"]) for r in run(streaming.rate_limited(stream, 2, 60.0), spark, "limited")}
    assert got == batch


def test_daily_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, 5),) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    got = {r["day"].day: r["n"] for r in run(streaming.daily_counts(stream), spark, "daily")}
    assert got == {1: 2, 2: 1}
