"""The paired bootstrap next to plain resampling; odd documents; how vectors are dealt."""

import math

import numpy as np
from pantrygrid.operators import retrieval


def test_paired_bootstrap_draws_as_often_as_the_reference(spark):
    d = np.random.default_rng(5).normal(0.3, 1, 60)
    pairs = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate(d)] + [(100, None, 1.0)], "id long, a double, b double").repartition(3)
    got = retrieval.paired_bootstrap(pairs).collect()
    assert got == retrieval.paired_bootstrap(pairs, 5000).collect() and len(got) == 1
    means = d[np.random.default_rng(0).integers(0, 60, (5000, 60))].mean(axis=1)
    assert abs(got[0]["mean"] - d.mean()) < 1e-12 and np.abs(np.array([got[0]["low"], got[0]["high"]]) - np.percentile(means, [2.5, 97.5])).max() < 0.03


def test_paired_bootstrap_of_one_pair(spark):
    assert [tuple(r) for r in retrieval.paired_bootstrap(spark.createDataFrame([(1, 2.0, 0.5)], "id long, a double, b double")).collect()] == [(1.5, 1.5, 1.5)]


def test_bm25_reads_documents_once_and_adds_up_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "protein intake"), (1, "the Protein"), (2, "sodium an"), (None, "protein"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "protein, protein"), (8, "an of"), (9, None)], "item_id long, text string")
    got = retrieval.bm25(docs, asked)
    part = math.log(1 + (6 - 2 + 0.5) / 2.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3)))
    assert [tuple(r) for r in got.collect()] == [(7, 1, 1, round(2 * part, 6))]
    assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()  # texts are not cut again
    assert retrieval.bm25(docs.limit(0), asked).collect() == retrieval.bm25(docs, asked.limit(0)).collect() == []


def test_parts_of_vectors_and_queries_grow_in_number_not_in_size(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(300, 4))
    v = spark.createDataFrame([(i, [float(y) for y in row], i % 2) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(60)
    want = sorted(map(tuple, retrieval.nearest(v.where("vec_id % 3 = 0"), v, 4, same="label", rows=2).collect()))
    monkeypatch.setattr(retrieval, "PART", 10)
    got = retrieval.nearest(v.where("vec_id % 3 = 0"), v, 4, same="label", rows=2)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 400
    assert "31)" in got._jdf.queryExecution().optimizedPlan().toString()  # 300 rows in 31 parts


def test_the_nearest_are_those_of_differences_and_only_few_pairs_are_summed(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(400, 8)) * 4).astype(float) / 1024 + 3  # many ties, and norms far above distances
    v[50:90], v[7, 3], v[399] = v[10:50], 3 + 1e-7, v[0]
    ids, asked = rng.permutation(400), np.arange(60)
    for odd in (False, True):
        if odd:
            v[5, 2], v[8, 1] = np.nan, np.inf
        w = v[np.argsort(ids)[asked]]
        for by in ("l2", "dot"):
            want = []
            for q, one in zip(asked, w):
                near = v @ one if by == "dot" else -((v - one) ** 2).sum(1)
                want += [(q, i) for _, i in sorted((-round(s, 9), i) for s, i in zip(near, ids) if i != q and np.isfinite(s))[:6]]
            qi, vi, near = retrieval._closest(w, v, asked, ids, 6, by)
            assert [(asked[x], ids[y]) for x, y in zip(qi, vi)] == want and len(want) > 300
            assert by == "dot" or near.tolist() == [-((v[y] - w[x]) ** 2).sum() for x, y in zip(qi, vi)]
    assert [len(x) for x in retrieval._closest(w[:1], v[:3], asked[:1], ids[:3], 6, "l2")] == [3 - (0 in ids[:3])] * 3


def test_the_weight_sweep_ranks_once(spark):
    from pantrygrid.plans import compare

    got = compare.fusion_weight_sweep(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == len(compare.WEIGHTS)
