"""Rates of the mix next to a plain solver, and odd rows."""

import numpy as np
import pytest
from pantrygrid.llm import mixing

SAY = {"a": "the house and the river were there with them", "b": "der Hund und die Katze sind nicht mehr hier", "c": "la maison est dans le jardin avec elle et lui"}


def plain_rates(p, tokens, goal, least=0.0, rounds=20_000):
    """The nearest rates to one, weighed by tokens, that meet the goal and are not below the least: Dykstra's alternating projections."""
    root = np.sqrt(tokens)
    a = (p * root[:, None]).T
    back = np.linalg.pinv(a)
    x, keep = root.copy(), np.zeros(len(root))
    for _ in range(rounds):
        y = x + back @ (goal - a @ x)
        z = np.maximum(y + keep, least * root)
        keep = y + keep - z
        x = z
    return x / root


@pytest.mark.parametrize("share", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.05, "b": 0.05, "c": 0.9}])
def test_rates_are_those_of_a_plain_solver(spark, share):
    kinds = "aaaaaaabbc"
    rows = [(k, " ".join([SAY[kinds[k % 10]]] * (1 + k % 4)) + f" {k}", kinds[k % 10]) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string").repartition(3)
    mixer, narrow = mixing.fit(df, df, share)
    got = [(r["p"], r["tokens"]) for r in narrow.collect()]
    p, tokens = np.array([x for x, _ in got]), np.array([n for _, n in got], float)
    goal = np.array([share[d] for d in sorted(share)]) * tokens.sum()
    rates = mixer.rates(p)
    assert np.abs((rates * tokens) @ p - goal).max() <= 1e-6 * tokens.sum() and np.abs(mixer.gap).max() < 1e-6
    assert rates == pytest.approx(plain_rates(p, tokens, goal), abs=2e-3)


def test_odd_rows(spark):
    rows = [(k % 20, SAY["abc"[k % 3]] + f" {k}", "abc"[k % 3], "x") for k in range(60)] + [(None, SAY["a"] * 2000, None, "y"), (3, None, "a", "z"), (4, "", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, tokens string")
    labels = df.where("domain is not null").select("doc_id", "domain")
    got = mixing.mix(df, labels, {"a": 1, "b": 1, "c": 1}).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["posteriors"]) - 1) < 1e-6 and abs(r["copies"] - r["rate"]) <= 1 for r in got)
    again = mixing.mix(df.repartition(5), labels, {"a": 1, "b": 1, "c": 1}).collect()
    assert sorted(r["copies"] for r in again) == sorted(r["copies"] for r in got)
    out = mixing.mixed_documents(df, labels, {"a": 1, "b": 1, "c": 1}, never_less=True)
    assert out.columns == df.columns and out.count() >= len(rows)
