"""Checks and losses of day plans, targets by training day, adaptive expenditure, chunks of a corpus, numbering, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.functions import text as t
from pantrygrid.sources import shared_checkpoints

#: How far a plan may be off, in parts of the target; least share of fibre; most sodium; sane portions.
TOLERANCES = {"kcal": (-0.06, 0.06), "protein_g": (-0.12, 0.60), "fat_g": (-0.35, 0.35), "carb_g": (-0.35, 0.35)}
FIBER, SODIUM, PORTION = 0.60, 2300.0, (30.0, 600.0)
#: Weights of the loss, those that count double when short, the share of sugar that is free.
WEIGHTS, SHORT, SUGAR = {"kcal": 3.0, "protein_g": 2.0, "fat_g": 1.8, "carb_g": 1.8, "fiber_g": 0.8}, {"protein_g": 2.0, "fiber_g": 2.0}, 0.10
#: Training days a week, the rise on them, the least of a rest day, least shares of carbohydrates and fat.
TRAINING, RISE, REST, LEAST_CARB, LEAST_FAT = {"sedentary": 0, "light": 1, "moderate": 3, "high": 4, "athlete": 6}, 0.10, 0.85, 0.15, 0.20
#: Days looked back, least weigh-ins and days between them, kcal of a kilogram, the most a step changes.
WINDOW, WEIGH_INS, SPAN, KG, STEP = 28, 4, 14, 7700.0, 0.10
NUTRIENTS = ["kcal", "protein_g", "fat_g", "carb_g", "fiber_g", "sugar_g", "sodium_mg"]


def totals(items: DataFrame) -> DataFrame:
    """One row per plan of items (plan, dish, grams, nutrients): sums, and what the checks of portions need."""
    return items.groupBy("plan").agg(*[F.sum(n).alias(n) for n in NUTRIENTS], F.count("*").alias("items"), F.count_distinct("dish").alias("dishes"), F.min("grams").alias("least"), F.max("grams").alias("most"))


def _target(name: str) -> Column:
    return F.coalesce(F.col(f"target_{name}"), F.lit(0.0))


def day_checks(items: DataFrame, targets: DataFrame) -> DataFrame:
    """The eight checks of each plan by targets (plan, target_kcal, target_protein_g, ...). A target that is not above 0 has no deviation, so its range fails; a fibre target that is not passes."""
    whole = totals(items).join(targets, "plan")
    ranges = [F.coalesce((F.when(_target(n) > 0, F.col(n) / _target(n) - 1)).between(low, high), F.lit(False)).alias(f"{n}_in_range") for n, (low, high) in TOLERANCES.items()]
    fiber = (_target("fiber_g") <= 0) | (F.coalesce("fiber_g", F.lit(0.0)) >= _target("fiber_g") * FIBER)
    return whole.select("plan", *ranges, fiber.alias("fiber_sufficient"), (F.coalesce("sodium_mg", F.lit(0.0)) <= SODIUM).alias("sodium_within_limit"), (F.col("items") == F.col("dishes")).alias("no_duplicates"), ((F.col("least") >= PORTION[0]) & (F.col("most") <= PORTION[1])).alias("portions_sane"))


def day_loss(items: DataFrame, targets: DataFrame) -> DataFrame:
    """plan, loss, feasible: weighted relative errors, more where a shortage is worse, and what sodium and sugar are over their limits."""
    loss = F.lit(0.0)
    for n, w in WEIGHTS.items():
        off = (F.coalesce(n, F.lit(0.0)) - _target(n)) / _target(n)
        loss = loss + F.when(_target(n) > 0, w * F.abs(off) * F.when(off < 0, SHORT.get(n, 1.0)).otherwise(1.0)).otherwise(0.0)
    sodium = F.coalesce("sodium_mg", F.lit(0.0))
    sugar = F.coalesce("sugar_g", F.lit(0.0)) * 4 / F.greatest(F.coalesce("kcal", F.lit(0.0)), F.lit(1.0))
    loss = loss + 3 * F.greatest(sodium - SODIUM, F.lit(0.0)) / SODIUM + 3 * F.greatest(sugar - SUGAR, F.lit(0.0))
    return totals(items).join(targets, "plan").select("plan", loss.alias("loss"), (sodium <= SODIUM).alias("feasible"))


def cycled(people: DataFrame) -> DataFrame:
    """Targets on training and rest days (person, day_kind, kcal, fat_g, carb_g, fiber_g) of people (person, activity, kcal, protein_g, fat_g): the week's mean stays, only carbohydrates move, and fat where they would run out. Who does not train has no rows."""
    days = F.create_map(*[F.lit(x) for kv in TRAINING.items() for x in kv])[F.col("activity")]
    with_days = people.withColumn("n", days).where("n between 1 and 6")
    rise = F.least(F.lit(RISE), F.greatest((7 - REST * (7 - F.col("n"))) / F.col("n") - 1, F.lit(0.0)))
    high = F.col("kcal") * (1 + rise)
    low = (F.col("kcal") * 7 - high * F.col("n")) / (7 - F.col("n"))
    each = with_days.select("person", "protein_g", "fat_g", F.explode(F.array(F.struct(F.lit("training").alias("day_kind"), high.alias("k")), F.struct(F.lit("rest").alias("day_kind"), low.alias("k")))).alias("x")).select("*", "x.*")
    k, protein, fat = F.col("k"), F.col("protein_g") * 4, F.col("fat_g") * 9
    short = k - protein - fat < k * LEAST_CARB
    used = F.when(short, F.greatest(k * LEAST_FAT, k - protein - k * LEAST_CARB)).otherwise(fat)
    return each.select("person", "day_kind", F.bround(k).alias("kcal"), F.bround(used / 9).alias("fat_g"), F.bround(F.greatest(k - protein - used, F.lit(0.0)) / 4).alias("carb_g"), F.bround(k / 1000 * 14).alias("fiber_g"))


def expenditure(weights: DataFrame, intake: DataFrame, formula: float, fallback: float) -> DataFrame:
    """key, tdee, kg_per_week of weights (key, day, y: one row a day) and intake (key, day, kcal: one row a day), as of a key's last weigh-in.

    Of the last days: four weigh-ins at least over two weeks, else no row. A day without intake has the last one before it, or the fallback. tdee stays within a step of the formula's.
    """
    last = Window.partitionBy("key")
    recent = weights.where("y is not null").withColumn("today", F.max("day").over(last)).where(F.datediff("today", "day") <= WINDOW)
    spans = recent.groupBy("key").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).where((F.col("n") >= WEIGH_INS) & (F.datediff("last", "first") >= SPAN))
    a, b = recent.alias("a"), recent.alias("b")  # at most 29 points of a key
    slope = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.day") < F.col("b.day"))).groupBy(F.col("a.key").alias("key")).agg(F.percentile((F.col("b.y") - F.col("a.y")) / F.datediff("b.day", "a.day"), F.lit(0.5)).alias("slope"))
    calendar = spans.select("key", F.explode(F.sequence("first", F.date_sub("last", 1))).alias("day"), F.lit(None).cast("double").alias("kcal"), F.lit(1).alias("counts"))
    known = intake.select("key", "day", F.col("kcal").cast("double"), F.lit(0).alias("counts"))
    whole = known.unionByName(calendar).groupBy("key", "day").agg(F.max("kcal").alias("kcal"), F.max("counts").alias("counts"))
    so_far = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    eaten = whole.withColumn("kcal", F.coalesce(F.last("kcal", ignorenulls=True).over(so_far), F.lit(fallback))).where("counts = 1").groupBy("key").agg(F.avg("kcal").alias("intake"))
    found = F.col("intake") - F.col("slope") * KG
    return eaten.join(slope, "key").select("key", F.bround(F.least(F.greatest(found, F.lit(formula * (1 - STEP))), F.lit(formula * (1 + STEP)))).alias("tdee"), (F.col("slope") * 7).alias("kg_per_week"))


def corpus_chunks(docs: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """doc_id, pos, section, text: cleaned documents (doc_id, text) in chunks; a chunk without a heading has the last one before it."""
    each = docs.select("doc_id", F.posexplode(t.chunks(size, overlap)(t.clean(F.col("text")))).alias("pos", "text"))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("doc_id", "pos", F.coalesce(F.last(t.section(F.col("text")), ignorenulls=True).over(so_far), F.lit(t.FIRST_SECTION)).alias("section"), "text")


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a number from 0 in the order of key, null keys first; of rows with one key, any order.

    Partitions hold ranges of keys and are numbered side by side, then moved by the rows of the partitions before: the one
    ordered pass is over one row a partition. Ranges are checkpointed in the shared folder, so that they do not change.
    """
    shared_checkpoints(rows.sparkSession)
    order = F.col(key).asc_nulls_first()
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", at).checkpoint()
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def pooled(rankings: list[DataFrame], depth: int = 10) -> DataFrame:
    """query_id, doc_id, source, rank: the first depth of each ranking (query_id, rank, doc_id); of repeats, the one of the earliest ranking and rank."""
    parts = [r.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(i).alias("source"), "rank") for i, r in enumerate(rankings)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "doc_id").agg(F.min(F.struct("source", "rank")).alias("f")).select("query_id", "doc_id", "f.source", "f.rank")


def parents(hits: DataFrame, of: DataFrame) -> DataFrame:
    """query_id, rank, parent: the parents (child, parent) of ranked hits (query_id, rank, child), each once, in order of their first hit."""
    first = hits.join(of, "child").groupBy("query_id", "parent").agg(F.min("rank").alias("first"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "parent")).alias("rank"), "parent")


#: Shares of a basket's weight with a price below which its cost is not said, and below which it is said to be partial; the step that costs are rounded to.
SAID, WHOLE, STEP_OF_COST = 0.5, 0.95, 10


def baskets(items: DataFrame, days: DataFrame) -> DataFrame:
    """menu, grams, priced (share of the weight with a cost), cost and a_day (rounded to tens; null where too little is priced, a_day also for one day), partial: estimates of items (menu, grams, cost or null) for menus of days (menu, days)."""
    sums = items.groupBy("menu").agg(F.sum("grams").alias("grams"), F.sum(F.when(F.col("cost").isNotNull(), F.col("grams"))).alias("known"), F.sum("cost").alias("paid"))
    met = sums.join(days, "menu").withColumn("priced", F.coalesce(F.try_divide("known", "grams"), F.lit(0.0)))
    tens = lambda c: F.when(F.col("priced") >= SAID, F.bround(c / STEP_OF_COST) * STEP_OF_COST)
    return met.select("menu", "grams", "priced", tens(F.col("paid")).alias("cost"), F.when(F.col("days") > 1, tens(F.col("paid") / F.col("days"))).alias("a_day"), ((F.col("priced") >= SAID) & (F.col("priced") < WHOLE)).alias("partial"))
