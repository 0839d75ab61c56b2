"""Hard negatives against all scores, over trees of one and of many groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pantrygrid.llm import hard_negatives

FIELDS = "vec_id long, embedding array<double>, label int, note string, v string"


def plain(rows, anchors, k=5, low=80, high=100, scale=256):
    own = [(i, y, [math.floor(x * scale) for x in v]) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, first = [], {}
    for i, y, v in own:
        if anchors(i):
            first[i] = min(first.get(i, (y, v)), (y, v))
    for a, (y, v) in first.items():
        near = sorted((-dot(v, w), i) for i, z, w in own if z == y and i != a)[:k]
        for p, positive in near:
            hard = sorted((-dot(v, w), i) for i, z, w in own if z != y and low * -p <= 100 * dot(v, w) <= high * -p)[:k]
            out += [(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard)]
    return sorted(out)


def made(n, dims, seed, copies=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rnd.randrange(6)]
        v = [x + rnd.gauss(0, 0.4) for x in c] if not (copies and i % 3 == 0) else [round(x, 1) for x in centres[0]]
        rows.append((i, v, rnd.randrange(3)))
    return rows


def asked(spark, rows, step, **how):
    df = spark.createDataFrame([(*r, "n", "v") for r in rows], FIELDS)
    found = hard_negatives.hard_negatives(df.where(F.expr(f"vec_id % {step} = 0")), df, **how)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("aimed,copies", [(64, 0), (4, 0), (4, 1)])
def test_all_scores(spark, monkeypatch, aimed, copies):
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", aimed)
    rows = made(900, 8, 7, copies)
    assert asked(spark, rows, 10) == plain(rows, lambda i: i % 10 == 0)


def test_groups_prune_pairs_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 4)
    sent = []
    keep = hard_negatives._searched

    def counted(chunks, slices, *rest):
        found = keep(chunks, slices, *rest)
        sent.append((chunks.count(), slices.count()))
        return found

    monkeypatch.setattr(hard_negatives, "_searched", counted)
    rows = [(i, [50.0 * (i % 4 == k) + 0.001 * (i % 7) for k in range(4)], i % 2) for i in range(400)]
    assert asked(spark, rows, 8) == plain(rows, lambda i: i % 8 == 0)
    assert max(c for c, _ in sent) > 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 3, 2) + [(100, None, 1), (101, [1.0, nan, 0.0], 1), (110, [1.0, inf, 0.0], 1), (120, [1.0, None, 0.0], 1), (130, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (140, [], 1), (150, [1.0], 2), (5, [1.0, 1.0, 1.0], 1), (5, [1.0, 1.0, 1.0], 2), (160, [-3.0, -3.0, -3.0], 9)]
    assert asked(spark, rows, 10) == plain([r if r[1] is None else (r[0], r[1] + [0.0] * (3 - len(r[1])), r[2]) for r in rows], lambda i: i % 10 == 0)
    twice = rows + [(10, [0.5, 0.5, 0.5], 0), (10, [0.1, 0.5, 0.5], 0)]
    assert asked(spark, twice, 10) == plain([r if r[1] is None else (r[0], r[1] + [0.0] * (3 - len(r[1])), r[2]) for r in twice], lambda i: i % 10 == 0)
    assert asked(spark, rows[:0], 10) == [] and asked(spark, [(i, [1.0], 1) for i in (1, 2, 3)], 10) == []
    assert asked(spark, [(i, [1.0, 2.0], 1) for i in (0, 1, 2)], 2) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**30 + i), float(3 * i), -1.0], i % 2) for i in range(40)]
    assert asked(spark, rows, 10, scale=1) == plain(rows, lambda i: i % 10 == 0, scale=1)
    with pytest.raises(Exception, match="too large"):  # a score beyond 64 bits
        asked(spark, rows, 10, scale=2**10)
    with pytest.raises(ValueError):
        asked(spark, [(0, [1e300], 1), (1, [1.0], 2)], 10)
