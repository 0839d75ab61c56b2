import random
import re

import numpy as np
import pandas as pd
import pytest
from pantrygrid.llm import ngram_join as nj
from pantrygrid.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, passage, rows = say(90), say(40), []
    for k in range(n):
        kind = k % 8
        if kind < 3:
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 3:
            words = say(rng.randint(1, 12)) + passage
        elif kind == 4:
            words = say(rng.randint(0, 4))
        elif kind == 5 and rows:
            words = (rng.choice(rows)[1] or "").upper().split()
        else:
            words = say(rng.randint(5, 120))
        rows.append((rng.randrange(10**5) * 1000 + k, None if k == 7 else rng.choice([" ", "\t\n"]).join(words)))
    return rows


def results(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_join(df).collect())


@pytest.mark.parametrize("seed, frequent, block", [(1, 64, 1000), (2, 3, 1000), (3, 3, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, frequent, block):
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    monkeypatch.setattr(nj, "FREQUENT_IN_SHARD", 2)
    monkeypatch.setattr(nj, "BLOCK_NODES", block)
    monkeypatch.setattr(nj, "SHARD_BYTES", 5000)
    rows = corpus(seed)
    assert results(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_edges(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "one two three four five six seven eight nine ten"
    rows = [(4, text, 1), (4, "other words here", 2), (9, text.upper(), 3), (None, text, 4), (5, None, 5), (6, " \t", 6)]
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 6, 4), (4, 1, 4), (4, 6, 4), (5, 0, 5), (6, 0, 6), (9, 6, 4)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_words_that_defeat_linear_hashes_are_told_apart(spark):
    word, other = "a", "b"
    for _ in range(11):  # a word and its complement, doubled each time: sums over powers of one odd base agree on them
        word, other = word + other, other + word
    rows = [(1, word), (2, other), (3, word.upper()), (4, f"{word} {other}"), (5, f"{other} {word}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nj.ngram_join(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_a_chain_of_chance_meetings_meets_as_pairs():
    """Each of 3000 nodes shares one signature with the next: as many pairs, not each node with all others."""
    n = 3000
    node = np.repeat(np.arange(n), 2)
    sig = (node + np.tile([0, 1], n)).astype(np.uint64)
    size = np.full(2 * n, 40)
    size[node == 7] = 10
    pdf = pd.DataFrame({"signatures": [sig.tobytes()], "nodes": [node.tobytes()], "classes": [(node // 2).tobytes()], "sizes": [size.tobytes()]})
    got = nj._meetings(75)(pdf)
    assert not got["many"].any()
    assert {(a, b) for a, b in zip(got["a"], got["b"])} == {(a, a + 1) for a in range(1, n - 1, 2) if a != 7}


def test_parities_rule_out_no_linked_sets():
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 3, 40, 500, 2100):
        base = rng.integers(0, 1 << 63, size * 2).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[:size], base[size : size + int(size * x)]])) for x in (0, 0.1, 0.3, 0.9)] + [base[: max(1, size * 4 // 5)]]
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    have = nj.parities(np.concatenate(sets), bounds)
    i, j = np.triu_indices(len(sets), 1)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    total = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j)])
    kept = nj.may_link([have[a] for a in i], [have[b] for b in j], total, 75)
    linked = 100 * both >= 75 * (total - both)
    assert linked.sum() > 5 and kept[linked].all() and not kept.all()


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200 + 30 * seed)]
        want = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in want:
            for a, b in edges:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_the_driver_holds_no_large_plan(spark, monkeypatch):
    """Plans of many shuffles are many stages at once, whose tasks and metrics fill the driver's memory where shuffles have many partitions."""
    shuffles, write = [], nj.shared.written

    def spy(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.append(len(re.findall(r"[ -]Exchange ", plan)))
        return write(df)

    monkeypatch.setattr(nj.shared, "written", spy)
    rows = corpus(3)
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert max(shuffles) <= 10
