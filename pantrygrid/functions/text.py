"""Text rules: departments, cleaning, chunks with their sections, what people ask for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Departments of a shop and the words of their categories, first match wins.
DEPARTMENTS = [
    ("Соя и растительный белок", r"soy|meat-alternative|tofu"),
    ("Рыба и морепродукты", r"fish|seafood|shrimp|tuna|salmon|shellfish"),
    ("Мясо и птица", r"beef|pork|lamb|veal|chicken|turkey|poultry|meat|sausage|frankfurter|bacon|ham\b|organ"),
    ("Молочное и яйца", r"milk|cheese|yogurt|dairy|cream|egg"),
    ("Снеки и сладкое", r"chips|cookie|cake|pie\b|pastry|dessert|candy|snack|sweet|ice cream|doughnut|gelatin|sorbet|ices\b|pudding"),
    ("Фрукты и ягоды", r"fruit|apple|banana|berr|citrus|melon|grape|peach|pear|mango|papaya"),
    ("Овощи и зелень", r"vegetable|potato|tomato|carrot|lettuce|greens|onion|pepper|squash|corn\b|bean|pea\b|peas\b|legume|salad|broccoli|cabbage|spinach|coleslaw"),
    ("Крупы, хлеб, макароны", r"grain|rice|pasta|noodle|bread|cereal|oat|cracker|tortilla|flour|macaroni|bagel|muffin|roll|bun\b"),
    ("Орехи и семечки", r"nuts|seeds|peanut"),
    ("Масла, соусы, специи", r"oil|fat\b|butter|dressing|sauce|gravy|condiment|spice|sugar|syrup|jam"),
    ("Напитки", r"coffee|tea\b|juice|drink|beverage|water|soda|smoothie"),
    ("Готовые блюда", r"soup|pizza|sandwich|burger|stew|casserole|burrito|taco|mexican"),
]
OTHER_DEPARTMENT, ABSENT = "Прочее", r"(?i),\s*(excludes|excluding|not)\b.*$"
#: What ends an abstract, and the name of a text before its first heading.
TAIL = r"(?is)(Copyright ©|©|This article is protected by copyright|All rights reserved\.|Published by Elsevier|PROSPERO registration|Trial registration).*"
FIRST_SECTION, SEPARATORS = "Введение", ["\n\n", "\n", ". ", " ", ""]
HEADINGS = [(r"(?m)^#{1,4}\s+(.+)$", 1), (r"(?m)^\*\*(.{5,80})\*\*", 1), (r"(?m)^[А-ЯЁA-Z\s]{10,80}$", 0)]
#: Spans of a menu in words, first match wins; the longest menu.
SPANS = [(r"на\s+пол(торы|тора)\s+недел", 10), (r"на\s+(две|пару)\s+недел", 14), (r"на\s+недел", 7), (r"на\s+месяц", 30), (r"на\s+день|на\s+один\s+день|на\s+сутки", 1)]
COUNTED, LONGEST = r"на\s+(\d{1,3})\s*(дн|день|дня|дней|недел|месяц)", 31
#: Both sides of a recomposition.
RECOMP, LOSING, KEEPING = r"рекомпозиц|recomp", r"сжечь жир|убрать жир|снизить жир|подсушит|сушк|уменьшить жир|похудеть", r"набрать мышц|нарастить мышц|не потерять мышц|сохранить мышц|без потери мышц|набрать масс"


def department(category: Column) -> Column:
    """The department of a category; what a category says it does not hold does not count."""
    text = F.lower(F.regexp_replace(F.coalesce(category, F.lit("")), ABSENT, ""))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in DEPARTMENTS], F.lit(OTHER_DEPARTMENT))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """The only step of cleaning that Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean(text: Column) -> Column:
    """Normal form, no rights and registration tail, plain spaces, at most one empty line in a row."""
    out = F.regexp_replace(nfkc(text), TAIL, "")
    out = F.regexp_replace(F.translate(out, " ­", " "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def days(text: Column) -> Column:
    """How many days of menu a phrase asks for: a number with its unit, or else words; null for none or over a month."""
    low = F.lower(text)
    unit = F.regexp_extract(low, COUNTED, 2)
    n = F.regexp_extract(low, COUNTED, 1).try_cast("int") * F.when(unit == "недел", 7).when(unit == "месяц", 30).otherwise(1)
    return F.when(low.rlike(COUNTED), F.when(n.between(1, LONGEST), n)).otherwise(F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for p, k in SPANS]))


def goal(text: Column) -> Column:
    """Recomposition where it is named or both of its sides are; other goals are not told here."""
    low = F.lower(text)
    return F.when(low.rlike(RECOMP) | (low.rlike(LOSING) & low.rlike(KEEPING)), "recomp")


def section(chunk: Column) -> Column:
    """The first heading of a chunk, null without one."""
    return F.coalesce(*[F.when(F.regexp_like(chunk, F.lit(p)), F.regexp_extract(chunk, p, g)) for p, g in HEADINGS])


def split(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that is there; separators stay with what follows."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [p for p in re.split(f"(?={re.escape(sep)})", text) if p] if sep else list(text)
    out, short = [], []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += packed(short, size, overlap)
        short = []
        out += split(p, size, overlap, finer) if finer else [p]
    return out + packed(short, size, overlap)


def packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to size; the next chunk begins with the last parts that fit in overlap."""
    out, first, held = [], 0, 0
    for i, p in enumerate(parts):
        if held + len(p) > size and i > first:
            out.append("".join(parts[first:i]).strip())
            while first < i and (held > overlap or held + len(p) > size):
                held -= len(parts[first])
                first += 1
        held += len(p)
    out.append("".join(parts[first:]).strip())
    return [c for c in out if c]


def chunks(size: int = 900, overlap: int = 150, separators: list[str] = SEPARATORS):
    """A column function: the chunks of a text. With only empty lines as separators, and the empty one, paragraphs are packed as they are, and cut where one is too long."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split(t, size, overlap, separators) if t else [])

    return run


#: Fixed value: characters from which a chunk is kept.
LEAST_CHUNK = 120


class _Chunks:
    def eval(self, text: str, size: int, overlap: int, title: str = None):
        """One row for each chunk of a text: number, section, title and chunk. Chunks under LEAST_CHUNK characters go, but their headings count for what follows."""
        where, n = FIRST_SECTION, 0
        for chunk in split(text, size, overlap) if text else ():
            found = next((m for m in (re.search(p, chunk) for p, _ in HEADINGS) if m), None)
            if found:
                where = found.group(next(g for p, g in HEADINGS if re.search(p, chunk)))
            if len(chunk.strip()) >= LEAST_CHUNK:
                yield n, where, chunk.strip() if title is None else f"{title}\n\n{chunk.strip()}"
                n += 1


def register_chunks(spark, name: str = "chunks") -> None:
    """The table function chunks(text, size, overlap[, title]) for SQL, to be used with LATERAL: rows (pos, section, text) of each text."""
    spark.udtf.register(name, F.udtf(_Chunks, returnType="pos int, section string, text string", useArrow=True))
