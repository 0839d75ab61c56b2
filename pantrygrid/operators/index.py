"""A vector index that knows its content: rows keyed by the digest of model and text, in versioned buckets.

Refreshing embeds only texts whose digest the index lacks and writes only buckets with a change. A search first holds the
digest of the documents against that of the index, in any order of rows, and refuses an index that is not theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrygrid.operators import dialogue, retrieval
from pantrygrid.sinks import versioned

#: Buckets of an index.
BUCKETS = 64


class Stale(RuntimeError):
    """The index is not that of the documents."""


def content_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("::", F.lit(model), F.coalesce(text, F.lit(""))), 256)


def digest(rows: DataFrame) -> tuple[int, int]:
    """(rows, sum of hashes) of rows (id, key), whatever their order."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "key").cast("decimal(38,0)")).alias("d")).first()
    return got["n"], int(got["d"] or 0)


def refresh(docs: DataFrame, path: str, model: str, embed=dialogue.hashed_vectors) -> dict[str, int]:
    """Brings the index at path up to docs (id, text; ids once each). Returns how many texts were embedded, rows changed or added, rows removed.

    Texts that are equal are embedded once, and so are texts that moved to another id. A null text is an empty one.
    """
    spark = docs.sparkSession
    now = docs.select("id", content_key(model, F.col("text")).alias("key"), F.col("text"))
    had = versioned.read(spark, path)
    had = had if had is not None else spark.createDataFrame([], f"id {dict(docs.dtypes)['id']}, key string, vector array<double>, bucket string")
    known = had.select("key", "vector").dropDuplicates(["key"])
    changed = now.join(had.select("id", "key"), ["id", "key"], "left_anti")
    removed = had.join(now.select("id"), "id", "left_anti").select("id")
    counts = {"changed": changed.count(), "removed": removed.count(), "embedded": changed.select("key").distinct().join(known, "key", "left_anti").count()}
    if not counts["changed"] and not counts["removed"] and versioned.pointer(spark, path):
        return counts
    bucket = F.pmod(F.xxhash64(F.col("id")), F.lit(BUCKETS)).cast("string")
    touched = [r["bucket"] for r in changed.select("id").unionByName(removed).select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
    vectors, _ = dialogue.embedded(changed.select("id", "text"), known, model, embed)
    new = changed.select("id", "key").join(vectors, "id")
    kept = had.where(F.col("bucket").isin(touched)).join(now.select("id", "key"), ["id", "key"], "left_semi").select("id", "key", "vector")
    versioned.change(kept.unionByName(new).withColumn("bucket", bucket), path, by="bucket", gone=touched)
    return counts


def search(docs: DataFrame, path: str, model: str, queries: DataFrame, k: int = 12, embed=dialogue.hashed_vectors) -> DataFrame:
    """query_id, rank, vec_id, score: the k documents (id, text) nearest to queries (item_id, text) by product; raises Stale where the index is missing or of other documents.

    Queries have numbers of their own and find every document, also one with their number.
    """
    spark: SparkSession = docs.sparkSession
    index = versioned.read(spark, path)
    if index is None or digest(docs.select("id", content_key(model, F.col("text")).alias("key"))) != digest(index.select("id", "key")):
        raise Stale(path)
    empty = spark.createDataFrame([], "key string, vector array<double>")
    asked, _ = dialogue.embedded(queries.select(F.col("item_id").alias("id"), "text"), empty, model, embed)
    named = lambda df, sign: df.select((F.col("id") * 2 + sign).alias("vec_id"), F.col("vector").alias("embedding"))  # noqa: E731  queries odd, documents even
    got = retrieval.nearest(named(asked, 1), named(index, 0), k, by="dot")
    return got.select(F.expr("(query_id - 1) div 2").alias("query_id"), "rank", F.expr("vec_id div 2").alias("vec_id"), "score")
