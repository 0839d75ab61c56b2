"""Price classes of foods by their names, and what an amount costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a name but does not belong to the food, and the mark of raw food, which loses nothing by cooking.
TAILS, RAW = [r"(?i),?\s*\b(?:excludes|excluding|not)\b.*$", r"(?i),\s*(?:with|without)(?: added)? salt.*$"], r"(?i)\braw\b|\buncooked\b|\bdry\b"


def plain(name: Column) -> Column:
    out = F.coalesce(name, F.lit(""))
    for tail in TAILS:
        out = F.regexp_replace(out, tail, "")
    return F.lower(out)


def price_class(name: Column, rules: list[tuple[str, str]], first: list[tuple[str, str]] = ()) -> Column:
    """The class of a name by rules (class, pattern); null where none holds.

    Rules of first hold in order, before all others. Of the others, the one whose match starts leftmost; the earlier
    rule if two start at one place.
    """
    text = plain(name)
    early = [F.when(text.rlike(p), F.lit(key)) for key, p in first]
    found = F.array(*[F.when(text.rlike(p), F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(i).alias("rule"), F.lit(key).alias("key"))) for i, (key, p) in enumerate(rules)])
    return F.coalesce(*early, F.array_min(F.filter(found, lambda x: x.isNotNull()))["key"])


def price_class_of(name: Column, section: Column, rules: list[tuple[str, str]], first: list[tuple[str, str]] = ()) -> Column:
    """By the name, which tells more, else by the section."""
    return F.coalesce(price_class(name, rules, first), price_class(section, rules, first))


def cost_of(grams: Column, name: Column, per_kg: Column, cooked: Column) -> Column:
    """What grams of a food cost by the price of a kilogram bought; cooked: grams that a gram bought gives, not asked of raw food."""
    return grams / F.when(F.coalesce(name, F.lit("")).rlike(RAW), 1.0).otherwise(cooked) / 1000 * per_kg
