"""The automaton next to the ordered regexes."""

import random
import re

from pantrygrid.functions import automaton, prices
from pantrygrid.plans import rules as r
from pyspark.sql import functions as F


def plain(text, rules, first):
    for key, p in first:
        if re.search(p, text):
            return key
    found = [(m.start(), i, key) for i, (key, p) in enumerate(rules) if (m := re.search(p, text))]
    return min(found)[2] if found else None


def made(n):
    """n classes of words that share parts, with borders, optional letters, and now and then a true regex."""
    rnd = random.Random(n)
    parts = ["ham", "beef", "bean", "pea", "corn", "rice", "oil", "tea", "soy", "nut", "egg", "oat", "fig", "jam", "cod"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 2)))
    one = lambda: rnd.choice(["", r"\b"]) + rnd.choice([word(), f"{word()} {word()}", f"{word()}-?{word()}", f"{word()}s?"]) + rnd.choice(["", r"\b"])
    rules = [(f"c{i}", rf"{word()}\w*s\b" if i % 23 == 7 else "|".join(one() for _ in range(rnd.randint(1, 3)))) for i in range(n)]
    return rules, [(f"f{i}", f"{word()} {word()}") for i in range(n // 8)], parts, rnd


def test_ten_thousand_names_and_165_classes():
    rules, first, parts, rnd = made(165)
    table = automaton.Rules(tuple(rules), tuple(first))
    assert 0 < len(table.others) < 20
    hits = set()
    for _ in range(10_000):
        text = "".join(rnd.choice([*parts, " ", ", ", "-", "s", "x"]) for _ in range(rnd.randint(0, 12)))
        want = plain(text, rules, first)
        assert table.of(text) == want, text
        hits.add(want)
    assert len(hits) > 60


def test_classes_of_the_tables(spark):
    d = r.dishes(spark, "/root/testdata/sf0.001")
    both = d.select(prices.price_class_of(F.col("name"), F.col("section"), r.PRICES, r.FIRST).alias("a"), automaton.price_class(F.col("name"), F.col("section"), r.PRICES, r.FIRST).alias("b"))
    assert both.where("NOT (a <=> b)").count() == 0 and both.where("b IS NOT NULL").count() > 0
    odd = spark.createDataFrame([(None, None), ("", "Pork"), ("Graham, not ham", ""), ("HAM and beans", "Beef")], "a string, b string")
    assert [x["c"] for x in odd.select(automaton.price_class(F.col("a"), F.col("b"), r.PRICES, r.FIRST).alias("c")).collect()] == [None, "pork", "ham", "ham"]


def test_no_rules(spark):
    odd = spark.createDataFrame([("x", "y")], "a string, b string")
    assert odd.select(automaton.price_class(F.col("a"), F.col("b"), []).alias("c")).first()["c"] is None
    assert automaton.words_of("colou?r") == [("color", False, False), ("colour", False, False)] or sorted(automaton.words_of("colou?r")) == [("color", False, False), ("colour", False, False)]
    assert automaton.words_of(r"ha(m|t)") is None and automaton.words_of(r"\w+") is None
