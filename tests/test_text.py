"""Text rules and chunks on small cases."""

import re
import unicodedata

from pantrygrid import functions as fn
from pantrygrid.functions import text as t
from pantrygrid.operators import menus as m
from pyspark.sql import functions as F


def one(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_departments(spark):
    got = one(spark, t.department, ["Pasta mixed dishes, excludes macaroni and cheese", "Fruit salads", "Meat-alternatives, soy", "Tortilla, corn, other chips", None, "xyz"])
    assert got == ["Крупы, хлеб, макароны", "Фрукты и ягоды", "Соя и растительный белок", "Снеки и сладкое", t.OTHER_DEPARTMENT, t.OTHER_DEPARTMENT]


def test_days_and_goal(spark):
    assert one(spark, t.days, ["меню на 10 дней", "на 3 недели", "на две недели", "на неделю", "на месяц", "на 90 дней", "привет", None]) == [10, 21, 14, 7, 30, None, None, None]
    assert one(spark, t.goal, ["мягкая Рекомпозиция", "сжечь жир и набрать мышцы", "похудеть", None]) == ["recomp", "recomp", None, None]


def test_clean(spark):
    texts = ["ﬁne  a­b\t\tc\n\n\n\nd  ", "Kept. Copyright © 2020\nmore", "", "  all rights reserved. x", None]

    def plain(x):
        x = re.sub(t.TAIL[5:], "", unicodedata.normalize("NFKC", x), flags=re.I | re.S).replace("­", "").replace(" ", " ")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip()

    assert one(spark, t.clean, texts) == [None if x is None else plain(x) for x in texts]


def test_chunks_fit_and_lose_nothing():
    text = "\n\n".join(" ".join(f"w{i}x{j}." for j in range(i * 7 % 60 + 1)) for i in range(40)) + "\n\n" + "z" * 700
    got = t.split(text, 300, 50)
    assert all(0 < len(c) <= 300 for c in got)
    assert set(re.findall(r"w\d+x\d+\.", text)) == set(re.findall(r"w\d+x\d+\.", " ".join(got)))
    assert t.split("a b", 900, 150) == ["a b"] and t.split("   ", 900, 150) == []


def test_sections_carry_on(spark):
    docs = spark.createDataFrame([(1, "# Head one\n" + "a " * 40 + "\n\n" + "b " * 40), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["pos"], r["section"]) for r in m.corpus_chunks(docs, 100, 10).collect())
    assert got == [(1, 0, "Head one"), (1, 1, "Head one"), (2, 0, t.FIRST_SECTION)]


def test_stems_and_fixed_chunks(spark):
    words = "studies studied obesity obese nationals organization bed beds running happiness"
    got = spark.createDataFrame([(words,)], "x string").select(fn.stems(F.col("x"))).first()[0]
    assert got == ["stud", "studi", "obes", "obes", "national", "organ", "bed", "beds", "runn", "happi"]
    text = "\n\n".join(["a" * 40, "b" * 40, "c" * 250])
    got = t.split(text, 100, 0, ["\n\n", ""])
    assert got[0] == "a" * 40 + "\n\n" + "b" * 40 and all(len(x) <= 100 for x in got) and sum(x.count("c") for x in got) == 250
