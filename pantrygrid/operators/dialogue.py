"""What a dialogue about eaten food needs: candidates, grams, covered meals, kept items, memory of a conversation, cached vectors, judged batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.functions import restrictions as rs

#: Millilitres of a fluid ounce; the portion of someone who does not know; words that are no unit; units tried when none was named.
OUNCE, UNKNOWN, NO_UNIT, DEFAULT_UNITS = 29.57, "Quantity not specified", ["guideline", "with ice"], ["1 regular", "1 medium", "1 piece", "1 slice", "1 cup"]
#: Words for units that people use.
UNIT_WORDS = {"bar": ["1 bar"], "slice": ["slice"], "piece": ["piece", "item"], "cup": ["cup"], "glass": ["cup", "fl oz"]}
#: Meals of a day with the places that they take in its plan, main meals in their order, candidates shown, days of memory, days between two changes of a target.
PLACES, MAIN_MEALS, SHOWN, MEMORY_DAYS, CHANGE_DAYS = {"breakfast": [0], "lunch": [1, 2], "dinner": [3, 4], "snack": [5, 6]}, ["breakfast", "lunch", "dinner"], 12, 90, 7
#: Texts of a batch that is embedded, rows that are judged at once.
BATCH, JUDGED = 64, 10


def candidates(dishes: DataFrame, phrases: DataFrame) -> DataFrame:
    """item, rank, dish of phrases (item, query): dishes (dish, name) whose name holds all words of the query, at most SHOWN.

    First the generic record ("<query>, nfs"), then names that begin with its first word, then the shorter, then the
    smaller dish. Phrases are few, and so are words: a dish and a phrase meet by their first word.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    stem = lambda w: F.regexp_replace(w, "(?:es|s)$", "")
    q = phrases.select("item", F.lower(F.trim("query")).alias("query"), F.transform(words(F.col("query")), stem).alias("asked")).where(F.size("asked") > 0)
    n = dishes.select("dish", F.lower("name").alias("name"), F.transform(words(F.col("name")), stem).alias("stems"))
    met = n.withColumn("word", F.explode(F.array_distinct("stems"))).join(q.withColumn("word", F.col("asked")[0]), "word")
    met = met.where(F.size(F.array_except("asked", "stems")) == 0)
    generic = F.col("name") == F.concat(F.col("query"), F.lit(", nfs"))
    order = Window.partitionBy("item").orderBy(F.desc(generic), F.desc(F.col("stems")[0] == F.col("asked")[0]), F.length("name"), "dish")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN).select("item", "rank", "dish")


def chosen(offered: DataFrame, choices: DataFrame) -> DataFrame:
    """item, dish of choices (item, choice: from 1); null where the choice is none of those offered (item, rank, dish)."""
    return choices.join(offered, (choices["item"] == offered["item"]) & (choices["choice"] == offered["rank"]), "left").select(choices["item"], "dish")


def eaten_grams(items: DataFrame, portions: DataFrame) -> DataFrame:
    """item, grams of eaten items (item, dish, grams, ml, count, unit, unspecified, portion_g) by a table of portions (dish, seq, description, grams).

    Grams said; else millilitres by the weight of a fluid ounce (one gram each without one); else a count, one if none
    or over ten, of the unit named, or of the usual ones in order; else what stands for "not specified"; else the portion
    of the catalogue.
    """
    order = F.concat(F.coalesce(F.create_map(*[x for k, v in UNIT_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.lower("unit")], F.array().cast("array<string>")), F.array(*map(F.lit, DEFAULT_UNITS)))
    mine = portions.groupBy("dish").agg(F.array_sort(F.collect_list(F.struct("seq", F.lower("description").alias("d"), F.col("grams").alias("g")))).alias("rows"))
    met = items.join(mine, "dish", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<seq:int,d:string,g:double>>"))).withColumn("order", order)
    first = lambda ok: F.get(F.filter("rows", ok), 0)["g"]
    no_unit = lambda d: sum([F.contains(d, F.lit(w)).cast("int") for w in NO_UNIT], F.lit(0)) > 0
    by_word = F.transform("order", lambda w: first(lambda r: F.contains(r["d"], w) & ~no_unit(r["d"])))
    by_unit = F.get(F.filter(by_word, lambda g: g.isNotNull()), 0)
    unknown = first(lambda r: r["d"] == UNKNOWN.lower())
    ounce = first(lambda r: r["d"].startswith("1 fl oz") & ~F.contains(r["d"], F.lit("with ice")))
    count = F.when((F.col("count") > 0) & (F.col("count") <= 10), F.col("count")).otherwise(1.0)
    counted = count * F.coalesce(by_unit, unknown, F.col("portion_g"))
    return met.select("item", F.when(F.coalesce("unspecified", F.lit(False)), F.coalesce(unknown, "portion_g")).when(F.col("ml") > 0, F.col("ml") * F.coalesce(ounce / OUNCE, F.lit(1.0))).when(met["grams"] > 0, met["grams"]).otherwise(counted).alias("grams"))


def covered(eaten: DataFrame) -> DataFrame:
    """person, covered: the places of a day's plan that eaten meals (person, seq, meal) take; each snack takes the first free one, the last if none is."""
    lists = F.create_map(*[x for k, v in PLACES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    meals = eaten.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("seq", "meal"))).alias("x"))

    def take(taken: Column, x: Column) -> Column:
        places = lists[x["meal"]]
        free = F.array_except(places, taken)
        one = F.array(F.coalesce(F.get(free, 0), F.element_at(places, -1)))
        return F.array_union(taken, F.when(x["meal"] == "snack", one).otherwise(F.coalesce(places, F.array().cast("array<int>"))))

    return meals.select("person", F.array_sort(F.aggregate("x", F.array().cast("array<int>"), take)).alias("covered"))


def kept(plan: DataFrame, eaten: DataFrame, allowed: DataFrame) -> DataFrame:
    """person, place, dish: items of the last plan (person, place, dish) in main meals before the last one eaten (person, seq, meal), if no eaten meal covers their place and the dish is allowed (dish)."""
    rank = F.array_position(F.array(*map(F.lit, MAIN_MEALS)), F.col("meal"))
    last = eaten.withColumn("m", rank).groupBy("person").agg(F.max("m").alias("last")).where(F.col("last") > 0)
    meal_of = F.create_map(*[x for i, k in enumerate(MAIN_MEALS) for p in PLACES[k] for x in (F.lit(p), F.lit(i + 1))])
    early = plan.withColumn("m", meal_of[F.col("place")]).join(last, "person").where(F.col("m") <= F.col("last")).join(covered(eaten), "person")
    return early.where(~F.array_contains("covered", F.col("place"))).join(allowed.select("dish").distinct(), "dish", "left_semi").select("person", "place", "dish")


def swap_target(plan: DataFrame, asks: DataFrame) -> DataFrame:
    """person, place: which item of a plan (person, place, meal, name) a phrase (person, text) means: the first whose name has a word of four letters or more that begins as one of the phrase, else the first of a meal that it names."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    stems = lambda c: F.transform(words(c), lambda w: F.substring(w, 1, 5))
    met = plan.join(asks, "person").withColumn("named", F.arrays_overlap(stems(F.col("name")), stems(F.col("text")))).withColumn("meant", F.contains(F.lower("text"), F.lower("meal")))
    by = met.groupBy("person").agg(F.min(F.when(F.col("named"), F.col("place"))).alias("a"), F.min(F.when(F.col("meant"), F.col("place"))).alias("b"))
    return by.select("person", F.coalesce("a", "b").alias("place"))


def flat_profile(mentions: DataFrame) -> DataFrame:
    """person, exclude, include, allergies of mentions (person, seq, kind, term): each term once, in order; an allergy is also excluded, and what is excluded is not included."""
    of = lambda kinds: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("seq", F.lower(F.trim("term")).alias("t"))))), lambda x: x["t"]))
    got = mentions.where("term is not null").groupBy("person").agg(of(["exclude", "allergy"]).alias("exclude"), of(["include"]).alias("wish"), of(["allergy"]).alias("allergies"))
    return got.select("person", "exclude", F.array_except("wish", "exclude").alias("include"), "allergies")


def memory(turns: DataFrame, days: int = MEMORY_DAYS) -> DataFrame:
    """session, profile, plan, eaten of turns (session, turn, day, profile: map, plan, eaten: array): profiles merged (the later value of a key), the last plan, all that was eaten in the last days before the last turn."""
    last = Window.partitionBy("session")
    recent = turns.withColumn("today", F.max("day").over(last))
    keys = recent.select("session", "turn", F.explode("profile")).groupBy("session", "key").agg(F.max_by("value", "turn").alias("value"))
    profile = keys.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("profile"))
    rest = recent.groupBy("session").agg(F.max_by("plan", F.when(F.col("plan").isNotNull(), F.col("turn"))).alias("plan"), F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.datediff("today", "day") < days, F.struct("turn", F.coalesce("eaten", F.array().cast("array<string>")).alias("e"))))), lambda x: x["e"])).alias("eaten"))
    return rest.join(profile, "session", "left").select("session", "profile", "plan", "eaten")


def next_target(found: float, day: int, before: tuple[float, int] | None, formula: float, step: float, days: int) -> tuple[float, int]:
    """(tdee, day of its change) after an estimate: at most step from the last target (the formula's, if there was none), changed at most every so many days."""
    if before and day - before[1] < days:
        return before
    base = before[0] if before else formula
    return float(round(min(max(found, base * (1 - step)), base * (1 + step)))), day


def adapted(estimates: DataFrame, formula: float, step: float = 0.10, days: int = CHANGE_DAYS) -> DataFrame:
    """key, day, tdee: the target after each estimate (key, day, tdee), never more than step from the target before it (the formula's, if there was none), and changed at most every so many days."""
    lists = estimates.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", F.col("tdee").alias("t")))).alias("x"))
    start = F.array().cast("array<struct<day:date,t:double,since:date>>")

    def step_(seen: Column, x: Column) -> Column:
        before = F.element_at(seen, -1)
        keep = (F.size(seen) > 0) & (F.datediff(x["day"], before["since"]) < days)
        base = F.when(F.size(seen) > 0, before["t"]).otherwise(F.lit(formula))
        near = F.bround(F.least(F.greatest(x["t"], base * (1 - step)), base * (1 + step)))
        return F.concat(seen, F.array(F.struct(x["day"].alias("day"), F.when(keep, before["t"]).otherwise(near).alias("t"), F.when(keep, before["since"]).otherwise(x["day"]).alias("since"))))

    first = lambda x: F.array(F.struct(x["day"].alias("day"), F.bround(F.least(F.greatest(x["t"], F.lit(formula * (1 - step))), F.lit(formula * (1 + step)))).alias("t"), x["day"].alias("since")))
    guarded = F.aggregate("x", start, lambda seen, x: F.when(F.size(seen) == 0, first(x)).otherwise(step_(seen, x)))
    return lists.select("key", F.explode(guarded).alias("r")).select("key", "r.day", F.col("r.t").alias("tdee"))


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for a model of embeddings, which needs no network: words hashed to places of a vector of length one. It says nothing of meaning."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            out[i, digest[0] % size] += 1 if digest[1] % 2 else -1
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).tolist()


def embedded(docs: DataFrame, cache: DataFrame, model: str, embed=hashed_vectors) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of docs (id, text), and the rows (key, vector) that are new to the cache. Only texts that the cache lacks reach the model, each once, BATCH at a time."""
    keyed = docs.withColumn("key", F.sha2(F.concat_ws("::", F.lit(model), F.coalesce("text", F.lit(""))), 256))
    missing = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                yield pd.DataFrame({"key": part["key"], "vector": embed(part["text"].tolist())})

    new = missing.select("key", "text").mapInPandas(run, "key string, vector array<double>")
    return keyed.select("id", "key").join(cache.select("key", "vector").unionByName(new), "key").select("id", "vector"), new


def halved(ask, texts: list[str]) -> list:
    """The answers of a model to texts, one each. Where it fails or answers another number, each half is asked by itself, so that a text that cannot be answered costs only its own answer (None)."""
    try:
        said = list(ask(texts))
        if len(said) == len(texts):
            return said
    except Exception:  # noqa: BLE001 - whatever a model does wrong, its batch is split
        pass
    if len(texts) == 1:
        return [None]
    middle = len(texts) // 2
    return halved(ask, texts[:middle]) + halved(ask, texts[middle:])


def answered(rows: DataFrame, ask, size: int = 60) -> DataFrame:
    """id, answer of rows (id, text) by a model that takes a list of texts, size at once; null where a text alone is not answered."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                said = halved(ask, part["text"].tolist())
                yield pd.DataFrame({"id": part["id"], "answer": pd.Series([None if x is None else str(x).strip() for x in said], index=part.index, dtype=object)})

    return rows.select("id", "text").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, answer string")


def judged(pairs: DataFrame, judge, size: int = JUDGED) -> DataFrame:
    """pairs (query_id, chunk_id, text) with the verdicts of a judge, which sees at most size texts of a query at once; a batch that fails is halved, and a text that fails alone has a null verdict."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")) - 1
    batches = pairs.withColumn("batch", F.floor(order / size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id")
        said = halved(lambda texts: judge(int(pdf["query_id"].iloc[0]), texts), pdf["text"].tolist())
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "relevant": pd.Series([None if v is None else bool(v) for v in said], index=pdf.index, dtype="boolean")})

    return batches.groupBy("query_id", "batch").applyInPandas(run, "query_id long, chunk_id long, relevant boolean")


def reranked(hits: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id: hits (query_id, rank, doc_id) in the order that a model gave (query_id, order: array of ranks); an order that is no permutation of the hits' ranks is not used. At most k."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    ok = order.join(n, "query_id").where((F.size("order") == F.col("n")) & (F.array_sort("order") == F.sequence(F.lit(1), F.col("n").cast("int")))).select("query_id", "order")
    met = hits.join(ok, "query_id", "left").withColumn("at", F.coalesce(F.array_position("order", F.col("rank")), F.col("rank")))
    return met.where(F.col("at") <= k).select("query_id", F.col("at").cast("int").alias("rank"), "doc_id")


def unmatched(names: DataFrame, terms: list[str]) -> list[str]:
    """The terms that match no name (name): what a person must be told."""
    hit = names.agg(*[F.coalesce(F.bool_or(rs.matches(F.col("name"), [x])), F.lit(False)).alias(f"t{i}") for i, x in enumerate(terms)]).first()
    return [x for i, x in enumerate(terms) if not hit[f"t{i}"]]
