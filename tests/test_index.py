"""A content-addressed vector index, and models that fail on some texts."""

import pytest
from pantrygrid.operators import dialogue, index
from pantrygrid.sinks import versioned
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"dish number {i % 30} with rice") for i in range(60)] + [(60, None)], "id long, text string")


def test_only_what_changed_is_embedded(spark, tmp_path, docs):
    at = f"file://{tmp_path}/index"
    assert index.refresh(docs, at, "m") == {"changed": 61, "removed": 0, "embedded": 31}
    before = versioned.pointer(spark, at)
    assert index.refresh(docs.repartition(3), at, "m") == {"changed": 0, "removed": 0, "embedded": 0} and versioned.pointer(spark, at) == before
    one = docs.withColumn("text", F.when(F.col("id") == 7, "soup").otherwise(F.col("text")))
    assert index.refresh(one, at, "m") == {"changed": 1, "removed": 0, "embedded": 1}
    after = versioned.pointer(spark, at)["live"]
    assert sum(after[b] != before["live"].get(b) for b in after) == 1
    moved = one.where("id <> 3").withColumn("text", F.when(F.col("id") == 8, "soup").otherwise(F.col("text")))
    assert index.refresh(moved, at, "m") == {"changed": 1, "removed": 1, "embedded": 0}
    rows = {r["id"]: r["vector"] for r in versioned.read(spark, at).collect()}
    assert set(rows) == {r["id"] for r in moved.collect()} and rows[7] == rows[8] == dialogue.hashed_vectors(["soup"])[0]


def test_a_stale_index_is_refused(spark, tmp_path, docs):
    at = f"file://{tmp_path}/index"
    queries = spark.createDataFrame([(1, "dish number 4 with rice"), (60, "soup")], "item_id long, text string")
    with pytest.raises(index.Stale):
        index.search(docs, at, "m", queries)
    index.refresh(docs, at, "m")
    got = index.search(docs.orderBy(F.desc("id")), at, "m", queries, k=2).orderBy("query_id", "rank").collect()
    assert (got[0]["query_id"], got[0]["rank"], got[0]["vec_id"], round(got[0]["score"], 6)) == (1, 1, 4, 1.0) and got[1]["rank"] == 2 and len(got) == 4
    for other in (docs.where("id <> 5"), docs.withColumn("text", F.upper("text")), docs.unionByName(docs.limit(1))):
        with pytest.raises(index.Stale):
            index.search(other, at, "m", queries)
    with pytest.raises(index.Stale):
        index.search(docs, at, "other model", queries)


def test_one_bad_text_costs_one_answer(spark):
    def ask(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts][: None if "short" not in texts else -1]

    rows = spark.createDataFrame([(i, "bad" if i == 13 else "short" if i == 40 else f"t{i}") for i in range(50)], "id long, text string").coalesce(1)
    got = {r["id"]: r["answer"] for r in dialogue.answered(rows, ask, 20).collect()}
    assert got == {i: None if i in (13, 40) else f"T{i}" for i in range(50)}
    calls = []
    assert dialogue.halved(lambda t: calls.append(len(t)) or ask(t), ["bad"] + ["x"] * 15) == [None] + ["X"] * 15 and len(calls) == 9

    def judge(query, texts):
        if "bad" in texts:
            raise ValueError("no")
        return [query % 2 == 0] * len(texts)

    pairs = spark.createDataFrame([(q, c, "bad" if (q, c) == (2, 3) else "ok") for q in (1, 2) for c in range(25)], "query_id long, chunk_id long, text string")
    said = {(r["query_id"], r["chunk_id"]): r["relevant"] for r in dialogue.judged(pairs, judge).collect()}
    assert said == {(q, c): None if (q, c) == (2, 3) else q == 2 for q in (1, 2) for c in range(25)}
