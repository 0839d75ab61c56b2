"""Tables, reports and logs that operators write. What is read is never overwritten in place: tables and logs have versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrygrid.sinks import versioned

#: Buckets of a table of values by key.
BUCKETS = 64


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A table of measures, which is small, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def vectors(df: DataFrame, path: str, add: bool = False) -> None:
    """The vector table: written anew, or added to."""
    versioned.change(df, path, add=add)


def delete_documents(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """The vector table without the rows of documents (doc_id)."""
    versioned.change(versioned.read(spark, path).join(gone.select("doc_id").distinct(), "doc_id", "left_anti"), path)


def append_log(records: DataFrame, path: str, time_col: str = "ts") -> None:
    """Records as JSON lines, in a partition for each UTC day."""
    day = F.to_date(F.to_utc_timestamp(F.col(time_col).cast("timestamp"), F.current_timezone()))
    versioned.change(records.withColumn("day", F.coalesce(day.cast("string"), F.lit("none"))), path, by="day", add=True, kind="json")


def forget(spark: SparkSession, path: str, session_id: str) -> int:
    """The log without a session; only days that hold it are written again. Returns how many records went."""
    log = versioned.read(spark, path)
    mine = log.where(F.col("session_id") == session_id).groupBy("day").agg(F.count("*").alias("n")).collect()  # as many as days of one session
    if mine:
        days = [r["day"] for r in mine]
        left = versioned.read(spark, path, days).where(~F.coalesce(F.col("session_id") == session_id, F.lit(False)))
        versioned.change(left, path, gone=days)
    return sum(r["n"] for r in mine)


def retain(spark: SparkSession, path: str, first_day: str) -> list[str]:
    """The log without the days before one (as text); nothing is read or written but the pointer. Returns the days that went."""
    old = [d for d in versioned.pointer(spark, path)["live"] if d < first_day]
    if old:
        versioned.drop(spark, path, old)
    return old


def upsert(new: DataFrame, path: str, key: str) -> None:
    """The table of values at path with the rows of new in place of those with their key; only buckets of keys in new are read and written. A key that repeats in new raises."""
    spark = new.sparkSession
    if new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    dealt = new.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("string"))
    before = versioned.pointer(spark, path)
    if before:
        touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # BUCKETS at most
        old = versioned.read(spark, path, touched)
        dealt = old.join(new.select(key), key, "left_anti").unionByName(dealt.select(*old.columns))
    versioned.change(dealt, path, by="bucket")


def upserted(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of new in place of those with their key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def added(counts: DataFrame, new: DataFrame, key: str = "day", value: str = "calls") -> DataFrame:
    """Counters (key, value) with new counts added."""
    return counts.unionByName(new).groupBy(key).agg(F.sum(value).alias(value))
