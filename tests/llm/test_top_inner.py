"""Exact top-k next to plain products, with numbers of any size."""

import numpy as np
import pytest
from pantrygrid.llm import top_inner

SCHEMA = "vec_id long, embedding array<double>"


def plain(asked, rows, k):
    out = []
    for q in sorted({i for i, _ in asked}):
        w = min(v for i, v in asked if i == q)
        scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def got(spark, asked, rows, k=5, scale=1):
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner.top_k(df(asked), df(rows), k, scale).collect())


def whole(rows):
    return [(i, [int(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block", [8192, 16])
def test_lengths_that_differ_skip_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(top_inner, "CANDIDATES", block)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.integers(-9, 9, 6) * (1 if k % 10 else 1000)).astype(float).tolist()) for k in range(200)]
    asked = rows[::20] + [(500, [0.0] * 6), (501, [1.0] * 6), (501, [-1.0] * 6)]
    assert got(spark, asked, rows) == plain(whole(asked), whole(rows), 5)


def test_ties_repeats_and_lengths(spark):
    rows = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (3, [2.0]), (9, [1.0, 2.0, 0.0]), (4, []), (5, [1.0, None]), (6, None), (8, [float("inf"), 1.0])]
    want = [(3, 1, 7, 2), (3, 2, 7, 2), (3, 3, 9, 2), (3, 4, 4, 0)]
    assert got(spark, [(3, [2.0])], rows) == want
    assert got(spark, rows[:0] + [(1, None)], rows) == [] and got(spark, [(3, [2.0])], [(3, [1.0])]) == []


def test_numbers_beyond_32_bits_and_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    big = [(k, [float(x) for x in rng.integers(-(1 << 40), 1 << 40, 3)]) for k in range(30)]
    small = [(100 + k, [1.0, -1.0, float(k)]) for k in range(5)]
    assert got(spark, small, big + small) == plain(whole(small), whole(big + small), 5)
    close = [(k, [float((1 << 30) + k), 3.0, 1.0]) for k in range(20)]
    assert got(spark, close[:2], close) == plain(whole(close[:2]), whole(close), 5)
    with pytest.raises(ValueError, match="62 bits"):
        got(spark, [(1, [2.0**62])], [(2, [1.0])])


def test_products_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="[Oo]verflow|too large"):
        got(spark, [(1, [2.0**50])], [(2, [2.0**50])])


def test_equal_lengths_form_one_block_first(spark, monkeypatch):
    """All blocks tie; the first pass still meets one of them, and the result is whole."""
    monkeypatch.setattr(top_inner, "CANDIDATES", 16)
    rows = [(k, [float((k >> b & 1) * 2 - 1) for b in range(7)]) for k in range(128)]
    kept, met = top_inner.shared.written, []

    def counted(df):
        out = kept(df)
        if out.columns == ["query_id", "vec_id", "score"]:
            met.append(out.select("vec_id").distinct().count())
        return out

    monkeypatch.setattr(top_inner.shared, "written", counted)
    assert got(spark, rows[::10], rows) == plain(whole(rows[::10]), whole(rows), 5)
    assert met and met[0] <= 2 * 16
