import hashlib
import random

import numpy as np
import pytest
from pantrygrid.llm import repeats


def brute(rows, length):
    """Every window of every text, in order of id and start."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared_parts = [say(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        kind = k % 8
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1 and rows:
            base = list(rng.choice(rows)[1] or "x")
            base[rng.randrange(len(base))] = "#"
            text = "".join(base)
        elif kind == 2:
            text = rng.choice(["", None, "short", "ab" * 200, "a" * 350])
        else:
            text = " ".join(rng.choice([say(rng.randint(1, 40)), rng.choice(shared_parts), say(3)]) for _ in range(rng.randint(1, 5)))
        rows.append((rng.randrange(10**6) * 1000 + k, text))
    return rows


@pytest.mark.parametrize("common", [1000, 2])
def test_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(repeats, "COMMON", common)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.dedup_repeats(df).collect()}
    assert got == brute(rows, 100)


def test_long_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 500)
    rows = corpus(9, 60)
    rows.append((3, " ".join(str(t) for _, t in rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.dedup_repeats(df).collect()}
    assert got == brute(rows, 100)


def test_transform_is_that_of_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        suffixes = sorted(([*s[i:], 256 + k], s[i - 1] if i else repeats.END) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert repeats.shard_transform(strings).tolist() == [b for _, b in suffixes]


def test_merged_intervals_are_the_repeated_windows():
    rng = random.Random(2)
    shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(7, 30))) for _ in range(5)] for _ in range(3)]
    for length in (6, 7):
        string, window, interval = repeats.merged_intervals([repeats.shard_transform(s) for s in shards], [np.array([len(x) - length + 1 for x in s]) for s in shards], length)
        flat = [x for s in shards for x in s]
        count = {}
        for x in flat:
            for i in range(len(x) - length + 1):
                count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
        groups = {}
        for s, w, b in zip(string.tolist(), window.tolist(), interval.tolist()):
            groups.setdefault(b, []).append(flat[s][w : w + length])
        assert all(len(set(g)) == 1 for g in groups.values())
        assert {g[0]: len(g) for g in groups.values()} == {k: v for k, v in count.items() if v > 1}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, id string")
    assert repeats.dedup_repeats(empty).collect() == []
    long = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, long), (1, long), (None, long), (2, None), (2, None), (3, "é")]
    got = repeats.dedup_repeats(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as start"), keep_text=True)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got.collect())[0][:2] == (0, 300)
    left = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len(r["kept"])) for r in got.collect() if r["n_bytes"] == 300)
    assert [x[1] for x in left][:2] == [0, 0] and left[2][1] > 0
