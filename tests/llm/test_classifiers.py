"""Toxicity and quality on rows that trained nothing, on made-up text and on labelled documents."""

import random
import zlib

import numpy as np
import pytest
from pantrygrid.llm import features, quality, toxicity
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"


def held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_toxic_documents_that_are_held_out(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    toxic, plain = [r for r in got if r["toxic"] == 1], [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.4 * len(toxic) and sum(r["predicted"] for r in plain) <= 0.02 * len(plain)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("rain fell on the quiet harbour while boats came home and people talked about bread".split()) for _ in range(n))
    rows = [(k, f"{say(20)} vile grumblefoot skunkbrain {say(10)}" if k % 3 == 0 else say(40), int(k % 3 == 0)) for k in range(240)]
    odd = [(1000, None), (1001, ""), (1002, say(20_000)), (1003, say(10_000) + " vile grumblefoot skunkbrain " * 40 + say(10_000)), (None, say(9)), (1004, "x" * 50_000), (1004, "VILE GRUMBLEFOOT SKUNKBRAIN, you")]
    docs = spark.createDataFrame([(k, t, "a") for k, t, _ in rows] + [(k, t, "b") for k, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 1004}
    assert by[1000]["score"] == by[1001]["score"] and by[1003]["predicted"] == 1 and by[1002]["predicted"] == 0
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 1004) == [0, 1]
    one_class = toxicity.toxicity(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(one_class) == 1 and one_class[0]["score"] < 0.7
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_long_texts_train_by_pieces_of_all_of_them():
    text = bytes(i % 251 for i in range(100_000))
    got = toxicity.pieces(text)
    assert len(got) == toxicity.PIECES and text.startswith(got[0]) and text.endswith(got[-1]) and toxicity.pieces(b"short") == [b"short"]


def test_good_documents_stay_and_poor_ones_go(labelled):
    docs, labels = labelled
    got = quality.quality_classifier(docs).join(labels, "doc_id").where("quality is not null").collect()
    good, poor = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) >= 0.98 * len(good) and sum(not r["accepted"] for r in poor) >= 0.8 * len(poor)


def test_the_linear_scorer_decides(spark, labelled):
    docs = labelled[0].limit(300)
    model = quality.fit(docs)
    texts = [r["text"] or "" for r in docs.select("text").collect()][:50]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        z = features.count_features(data) @ model.weights
        assert model.score(data, np.array([0, len(data)]))[0] == pytest.approx(1 / (1 + np.exp(-(z[1] - z[0]))), rel=1e-4)


def test_quality_of_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("ri", "ver", "sto", "ne", "mor", "ning", "ho", "use", "le", "tter")) for _ in range(rng.randint(1, 3)))
    say = lambda n: " ".join(" ".join(word() for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(n))
    rows = [(k, say(8), "x") for k in range(40)] + [(None, "CLICK!!! $$$ ### BUY!!! " * 40, "y")] * 20 + [(7, say(20_000), "z"), (7, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.quality_classifier(docs).collect()
    assert len(got) == len(rows) and all(not r["accepted"] for r in got if r["doc_id"] is None) and all(r["accepted"] for r in got if r["doc_id"] is not None)
    assert quality.accepted_documents(docs).columns == docs.columns and quality.accepted_documents(docs).count() == 42
    assert quality.quality_classifier(docs.limit(0)).collect() == []


def test_samples_are_bounded_whatever_the_keys(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id")
    assert 0 < features.bounded_sample(df, "k", 100).count() <= 200
    assert 50 < features.bounded_sample(df, "id", 100).count() <= 200


def test_ids_with_several_texts_are_learnt_by_the_least(spark):
    say = ["you awful rotten fool go away", "the harbour was quiet and the boats came home"]
    rows = [(k, f"{say[k % 2]} {k} {v}") for k in range(80) for v in ("b", "a", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)], "doc_id long, toxic int")
    least = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    models = [toxicity.fit(d, labels) for d in (docs, docs.repartition(5, "text"), least)]
    assert models[0] == models[1] == models[2]
