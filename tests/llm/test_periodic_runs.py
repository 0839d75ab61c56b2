"""Runs against a plain scan of every period; the query against the same on documents of the tables."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pantrygrid.llm import periodic_runs, queries


def plain_runs(words, least=6, powers=4):
    out, n = [], len(words)
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            x = words[i : j + q]
            if len(x) >= max(least, powers * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((i, len(x), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, planted=True):
    words = (text or "").encode()
    words = [w.decode() for w in words.split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def rows_of(df):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.toPandas().itertuples(index=False)), key=str)


@pytest.mark.parametrize("least,powers", [(6, 4), (2, 2), (4, 3)])
def test_refinement_finds_what_a_scan_finds(least, powers):
    rnd = random.Random(least)
    for _ in range(60):
        docs = []
        for _ in range(rnd.randint(1, 8)):
            k, n = rnd.choice([1, 2, 2, 3]), rnd.choice([0, 1, 3, 6, 10, 40, 90])
            words = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = 1 + (n - a) // (3 + rnd.randrange(8))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            docs.append(words)
        codes = np.array([w for d in docs for w in d], np.int64)
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(codes, np.array([len(d) for d in docs], np.int64), least, powers))))
        assert got == [(i, *r) for i, d in enumerate(docs) for r in plain_runs(d, least, powers)]


def test_moves_stay_few_on_a_long_periodic_document():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 50, 3000)
    words = base[[i if i < 100 else 100 + (i - 100) % 580 for i in range(3000)]]
    names = np.r_[words, 50]
    found = periodic_runs._Classes(names, np.full(3001, 750, np.int32))
    length = 2
    while found.refine(length):
        length += 1
    assert sum(len(x[0]) for x in found.log) < 3000 * 2 * np.log2(3000)


def test_odd_rows(spark):
    rows = [
        (1, "a b a b a b a b a b"), (1, "a b a b a b a b a b"), (None, "x " * 20), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "one"), (6, "q q q q q q"), (7, "a\u00a0a a\u00a0a a\u00a0a a\u00a0a a\u00a0a a\u00a0a"),
        (8, " ".join(f"w{i % 700}" for i in range(4000))), (9, "\x1cu \x1cu \x1cu \x1cu \x1cu \x1cu"), (-3, "a a a a a b b b b b b a a a a a a a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(3)).withColumn("id", F.lit("clash")).withColumn("runs", F.lit(0))
    docs = docs.withColumn("words", periodic_runs.words_of(F.col("text")))
    got = periodic_runs.periodic_runs(docs).toPandas()
    want = sorted((str(i), str(plain_runs(["" if t is None else w.decode() for w in (t or "").encode().split()]))) for i, t in rows)
    assert sorted((str(None if pd.isna(i) else int(i)), str([tuple(x) for x in r])) for i, r in zip(got["doc_id"], got["runs"])) == want
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, ["a", None, "a"])], "doc_id long, words array<string>")
    assert {r["doc_id"]: r["collapsed"] for r in periodic_runs.periodic_runs(nulls).collect()} == {1: "", 2: "a  a"}


def test_query_equals_the_plain_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, "a " * 30), (10_001, None), (10_002, "z " * 40), (10_003, "u v " * 40)], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op11_periodic_runs(spark, str(tmp_path)))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10
