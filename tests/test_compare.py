"""Matches, comparisons of runs and dialogue rules next to plain versions."""

import random

import numpy as np
import pytest
from pantrygrid.operators import dialogue as dg
from pantrygrid.operators import menus as m
from pantrygrid.operators import overlap as ov
from pantrygrid.operators import retrieval as r
from pantrygrid.operators import runs as rn


def test_gold_texts_match_one_to_one(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") * 2
    ranked = [(q, k, " ".join(word() for _ in range(4))) for q in range(6) for k in range(1, 6)]
    gold = [(q, k, " ".join(word() for _ in range(5))) for q in range(6) for k in range(3)]
    want = {}
    for q in range(6):
        used = set()
        for _, k, t in [x for x in ranked if x[0] == q]:
            share = {p: len(set(t.split()) & set(g.split())) / len(set(g.split())) for qq, p, g in gold if qq == q}
            fits = [p for p in sorted(share) if share[p] >= 0.3]
            free = [p for p in fits if p not in used]
            used |= set(free[:1])
            want[q, k] = (bool(fits), int(bool(free)))
    got = ov.matched(spark.createDataFrame(ranked, "query_id int, rank int, text string"), spark.createDataFrame(gold, "query_id int, pos int, text string"))
    assert {(x["query_id"], x["rank"]): (x["any_match"], x["rel"]) for x in got.collect()} == want


def test_sources_of_short_and_long_passages(spark):
    text = " ".join(f"word{i}" for i in range(200))
    chunks = spark.createDataFrame([(1, "x " + text), (2, text[:500]), (3, "a" * 400), (4, None)], "chunk_id long, text string")
    got = ov.sources(spark.createDataFrame([(7, text), (8, "a" * 150), (9, ""), (10, "word3")], "item_id long, text string"), chunks).collect()
    assert sorted((x["item_id"], x["chunk_id"]) for x in got) == [(7, 1), (8, 3), (10, 1), (10, 2)]


def test_intervals_are_near_those_of_plain_resampling(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1.0, 120)
    df = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)] + [(999, None, 1.0)], "id long, a double, b double")
    got = r.paired_bootstrap(df, 1500).first()
    means = d[rng.integers(0, len(d), (5000, len(d)))].mean(1)
    assert got["mean"] == pytest.approx(d.mean()) and got["low"] == pytest.approx(np.percentile(means, 2.5), abs=0.05) and got["high"] == pytest.approx(np.percentile(means, 97.5), abs=0.05)
    groups = spark.createDataFrame([(i, i % 2 == 0, float(x)) for i, x in enumerate(d)], "id long, treated boolean, delta double")
    two = rn.group_difference(groups, 1500).first()
    a, b = d[1::2], d[::2]
    means = b[rng.integers(0, len(b), (5000, len(b)))].mean(1) - a[rng.integers(0, len(a), (5000, len(a)))].mean(1)
    assert two["mean"] == pytest.approx(b.mean() - a.mean()) and two["low"] == pytest.approx(np.percentile(means, 2.5), abs=0.08) and two["high"] == pytest.approx(np.percentile(means, 97.5), abs=0.08)
    few = rn.group_difference(groups.where("id < 6"), 10).first()
    assert (few["mean"], few["low"]) == (None, None)


def test_numbers_of_null_and_sparse_keys(spark):
    df = spark.createDataFrame([(1 << 40,), (None,), (5,), (-3,)], "k long")
    assert [(x["k"], x["n"]) for x in m.numbered(df, "k", "n").orderBy("n").collect()] == [(None, 0), (-3, 1), (5, 2), (1 << 40, 3)]


def test_covered_places_and_kept_items(spark):
    eaten = spark.createDataFrame([(1, 1, "lunch"), (1, 2, "snack"), (1, 3, "snack"), (1, 4, "snack"), (2, 1, "breakfast"), (3, 1, "snack")], "person int, seq int, meal string")
    assert {x["person"]: x["covered"] for x in dg.covered(eaten).collect()} == {1: [1, 2, 5, 6], 2: [0], 3: [5]}
    plan = spark.createDataFrame([(p, i, 10 + i) for p in (1, 2, 3) for i in range(7)], "person int, place int, dish int")
    allowed = spark.createDataFrame([(10,), (13,)], "dish int")
    assert [(x["person"], x["place"]) for x in dg.kept(plan, eaten, allowed).collect()] == [(1, 0)]


def test_grams_that_were_eaten(spark):
    items = [(1, 1, 50.0, None, None, None, False), (2, 1, None, 100.0, None, None, False), (3, 1, None, None, 2.0, "bar", False), (4, 1, None, None, 99.0, None, False), (5, 1, None, None, None, None, True), (6, 2, None, 100.0, None, None, False), (7, 2, None, None, 3.0, "bar", False)]
    df = spark.createDataFrame([(*x, 90.0) for x in items], "item int, dish int, grams double, ml double, count double, unit string, unspecified boolean, portion_g double")
    rows = spark.createDataFrame([(1, 0, "Guideline bar", 1.0), (1, 1, "1 bar", 40.0), (1, 2, "1 fl oz, with ice", 9.0), (1, 3, "1 fl oz", 59.14), (1, 4, "1 cup", 200.0), (1, 5, "Quantity not specified", 70.0)], "dish int, seq int, description string, grams double")
    assert {x["item"]: round(x["grams"], 6) for x in dg.eaten_grams(df, rows).collect()} == {1: 50.0, 2: 200.0, 3: 80.0, 4: 200.0, 5: 70.0, 6: 100.0, 7: 270.0}


def test_profiles_memory_and_targets(spark):
    mentions = [(1, 1, "exclude", "Pork"), (1, 2, "include", "fish"), (1, 3, "allergy", "Nuts"), (1, 4, "include", "pork "), (1, 5, "exclude", "pork")]
    got = dg.flat_profile(spark.createDataFrame(mentions, "person int, seq int, kind string, term string")).first()
    assert (got["exclude"], got["include"], got["allergies"]) == (["pork", "nuts"], ["fish"], ["nuts"])
    turns = spark.sql("SELECT * FROM VALUES (1, 1, DATE'2024-01-01', map('a', 1), 'p1', array('x')), (1, 2, DATE'2024-06-01', map('a', 2, 'b', 3), null, array('y')), (1, 3, DATE'2024-06-02', null, null, null) AS t(session, turn, day, profile, plan, eaten)")
    got = dg.memory(turns).first()
    assert (got["profile"], got["plan"], got["eaten"]) == ({"a": 2, "b": 3}, "p1", ["y"])
    est = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', 2500.0D), (1, DATE'2024-01-05', 1900.0D), (1, DATE'2024-01-08', 1900.0D) AS t(key, day, tdee)")
    assert [x["tdee"] for x in dg.adapted(est, 2000.0).orderBy("day").collect()] == [2200.0, 2200.0, 1980.0]
    plan = spark.createDataFrame([(1, 0, "завтрак", "Каша овсяная"), (1, 1, "обед", "Суп куриный")], "person int, place int, meal string, name string")
    asks = spark.createDataFrame([(1, "замени куриного друга")], "person int, text string")
    assert dg.swap_target(plan, asks).first()["place"] == 1


def test_models_that_fail_leave_nulls_and_orders_that_are_none_are_not_used(spark):
    pairs = spark.createDataFrame([(1, k, f"t{k}") for k in range(12)] + [(2, 1, "bad")], "query_id long, chunk_id long, text string")

    def judge(query, texts):
        if query == 2:
            raise RuntimeError
        return [t.endswith("1") for t in texts]

    got = {(x["query_id"], x["chunk_id"]): x["relevant"] for x in dg.judged(pairs, judge).collect()}
    assert got == {(1, k): str(k).endswith("1") for k in range(12)} | {(2, 1): None}
    hits = spark.createDataFrame([(q, k, 10 * k) for q in (1, 2) for k in (1, 2, 3)], "query_id int, rank int, doc_id int")
    order = spark.createDataFrame([(1, [3, 1, 2]), (2, [1, 1, 2])], "query_id int, order array<int>")
    assert sorted((x["query_id"], x["rank"], x["doc_id"]) for x in dg.reranked(hits, order, 2).collect()) == [(1, 1, 30), (1, 2, 10), (2, 1, 10), (2, 2, 20)]


def test_only_new_texts_reach_the_model(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id long, text string")
    empty = spark.createDataFrame([], "key string, vector array<double>")
    got, new = dg.embedded(docs, empty, "m")
    new = new.cache()
    assert got.count() == 4 and new.count() == 3
    assert dg.embedded(docs, new, "m")[1].count() == 0 and dg.embedded(docs, new, "other")[1].count() == 3


def test_contexts_and_wishes(spark):
    base = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 1, 7)], "id int, rank int, chunk_id int")
    other = spark.createDataFrame([(1, 1, 8), (1, 2, 7), (2, 1, 7)], "id int, rank int, chunk_id int")
    assert {x["id"]: (x["same_order"], x["same_set"]) for x in rn.context_groups(base, other).collect()} == {1: (False, True), 2: (True, True)}
    assert dg.unmatched(spark.createDataFrame([("Pork chop",)], "name string"), ["pork", "dill"]) == ["dill"]
