"""The dedup stages of the pipeline next to plain versions, with null and repeated ids."""

from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, source string"
A, B = "the quick brown fox jumps over the lazy dog near the old river bank today", "nothing in this line of words is shared with any other line of the table"
NEAR = A + " again"
ROWS = [(5, A, "a"), (5, B, "b"), (9, A, "c"), (7, B, "d"), (7, B, "e"), (None, A.upper(), "f"), (None, "alone", "g"), (None, "alone", "h"), (3, None, "i"), (2, "", "j"), (1, NEAR, "k"), (1, NEAR, "l"), (None, NEAR, "m")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def left(df):
    assert df.columns == ["doc_id", "text", "source"]
    return Counter((r["doc_id"], (r["text"] or "").lower()) for r in df.collect())


def test_exact_copies(spark, docs):
    want = {}
    for k, t, _ in ROWS:
        t = (t or "").lower()
        want[t] = max(want.get(t, -1), -1 if k is None else k)
    assert left(corpus_pipeline.drop_exact_copies(spark, docs, "")) == Counter((None if k < 0 else k, t) for t, k in want.items())
    assert corpus_pipeline.drop_exact_copies(spark, docs.limit(0), "").collect() == []


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_near_copies(spark, docs):
    group = list(range(len(ROWS)))
    sets = [shingles(t or "") for _, t, _ in ROWS]
    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    big = 1 << 40
    best = {g: min(big if ROWS[i][0] is None else ROWS[i][0] for i in range(len(ROWS)) if group[i] == g) for g in group}
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    kept = [next(i for i, r in enumerate(ROWS) if r[2] == x["source"]) for x in got]
    assert Counter(group[i] for i in kept) == Counter(set(group))
    assert all((big if ROWS[i][0] is None else ROWS[i][0]) == best[group[i]] for i in kept)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").collect() == []


def test_every_stage_of_a_whole_run(spark, tmp_path):
    """Stages next to the operators and to plain rules, over a table with null and repeated ids, empty texts and junk."""
    import hashlib
    import random

    import numpy as np
    import public_tokenizers
    from pantrygrid.llm import mixing, quality, shared, tokens

    rng = random.Random(12)
    word = lambda: "".join(rng.choice(("ri", "ver", "sto", "ne", "mor", "ning", "ho", "use", "le", "tter")) for _ in range(rng.randint(1, 3)))
    say = lambda n: " ".join(" ".join(word() for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(n))
    prose = [say(8) for _ in range(40)]
    rows = [(k, t, "en" if k % 4 else "de", f"s{k % 3}", len(t)) for k, t in enumerate(prose)]
    rows += [(100 + k, prose[k].upper().lower(), "en", "c", 0) for k in range(5)] + [(7, prose[1] + " again", "en", "n", 0), (None, prose[2], "de", "n", 0), (8, None, None, None, None), (9, "", "en", "e", 0)]
    rows += [(200 + k, "CLICK!!! $$$ ### BUY!!! " * (20 + k), "en", "j", 0) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, shared.written(stage(spark, at, str(tmp_path)))
        texts = Counter((r["text"] or "").lower() for r in before.collect())
        if name == "quality classifier":
            ok = {r["doc_id"]: r["accepted"] for r in quality.quality_classifier(docs).where("doc_id is not null").collect()}
            assert {r["doc_id"] for r in at.collect()} - {None} == {k for k, v in ok.items() if v} and not any(ok[200 + k] for k in range(12)) and all(ok[k] for k in range(40) if k not in (7, 8, 9))
        elif name == "exact dedup":
            assert Counter((r["text"] or "").lower() for r in at.collect()) == Counter(set(texts))
        elif name == "n-gram Jaccard join":
            kept = [shingles(r["text"] or "") for r in at.collect()]
            assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b) and len(kept) == len(texts) - 1
        elif name == "mixing sources to target weights":
            assert set(Counter((r["text"] or "").lower() for r in at.collect())) == set(texts) and at.columns == docs.columns
        else:
            enc = tokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            want = Counter(hashlib.sha256(np.asarray(enc.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest() for r in before.collect())
            assert Counter(r["ids_sha256"] for r in at.collect()) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["ids_sha256"] for r in whole) == sorted(r["ids_sha256"] for r in at.collect())


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns_of_other_names_stay(spark, docs, tmp_path):
    named = docs.selectExpr("*", "1 AS _file", "2 AS _no", "3 AS file", "4 AS id", "'x' AS `group`", "5 AS keep_id")
    named.write.parquet(str(tmp_path / "named"))
    for source in (named, spark.read.parquet(str(tmp_path / "named"))):
        got = corpus_pipeline.drop_exact_copies(spark, source, "")
        assert got.columns == named.columns and got.count() == corpus_pipeline.drop_exact_copies(spark, docs, "").count()
    near = corpus_pipeline.drop_near_copies(spark, named, "")
    assert near.columns == named.columns and near.count() == corpus_pipeline.drop_near_copies(spark, docs, "").count()
