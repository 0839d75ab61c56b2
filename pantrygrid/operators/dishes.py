"""Recipes, shares, costs, filters, targets and plans of dishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid import functions as fn
from pantrygrid.functions import restrictions as rs
from pantrygrid.functions import rules as ru
from pantrygrid.sources import shared_checkpoints

SHARE, SERVINGS = 0.01, (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
#: Factors of activity, grams of protein for a kilogram by goal, kilograms a week by goal unless said.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "high": 1.725, "athlete": 1.9}
PROTEIN = {"lose": 1.8, "maintain": 1.4, "gain": 1.8, "recomp": 2.0}
RATE = {"lose": 0.5, "maintain": 0.0, "gain": 0.25, "recomp": 0.0}
#: The most that a loss may be a week, in kilograms and as a share of the weight; shares of the energy: protein at most, fat; price of a kilogram below which food is as good as free.
LOSS_KG, LOSS_SHARE, PROTEIN_SHARE, FAT_SHARE, NEAR_FREE = 1.0, 0.01, 0.35, 0.28, 1.0


def shares(lines: DataFrame, least: float = SHARE) -> DataFrame:
    """dish, item, share of lines (dish, item, grams): lines of one item add up, small shares go, the rest sums to one. Dishes without mass have no rows."""
    whole, left = Window.partitionBy("dish"), Window.partitionBy("dish")
    merged = lines.groupBy("dish", "item").agg(F.sum("grams").alias("grams")).withColumn("total", F.sum("grams").over(whole)).where("total > 0")
    kept = merged.where(F.col("grams") / F.col("total") >= least)
    return kept.select("dish", "item", (F.col("grams") / F.sum("grams").over(left)).alias("share"))


def cost(parts: DataFrame, prices: DataFrame) -> DataFrame:
    """dish, coverage, cost of 100 g by shares (dish, item, share) and prices (item, price of a kilogram).

    What is as good as free (water) costs what it costs, but is not carried on to the rest: of the other food half at
    least must be priced (but for rounding of sums), and stands for all of it. A dish of nothing else has its own cost.
    Null where too little is priced.
    """
    free = F.col("price") < NEAR_FREE
    known = parts.join(prices, "item", "left")
    sums = {"free": F.when(free, F.col("share")), "free_paid": F.when(free, F.col("share") * F.col("price")), "cover": F.when(~free, F.col("share")), "paid": F.when(~free, F.col("share") * F.col("price"))}
    met = known.groupBy("dish").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in sums.items()]).withColumn("food", 1.0 - F.col("free"))
    enough = (F.col("cover") > 0) & (F.col("cover") >= 0.5 * F.col("food") - 1e-9)
    cost_ = F.when(F.col("food") <= 1e-9, F.col("free_paid")).when(enough, F.col("free_paid") + F.col("paid") * F.col("food") / F.col("cover")) / 10
    return met.select("dish", F.when(enough | (F.col("food") <= 1e-9), F.col("free") + F.col("cover")).otherwise(F.col("cover")).alias("coverage"), cost_.alias("cost"))


def without_items(dishes: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """The dishes (dish, ...) that hold none of items (item). Items are matched first: they are few."""
    bad = lines.join(items, "item", "left_semi").select("dish").distinct()
    return dishes.join(bad, "dish", "left_anti")


#: Edges from which parts that stand in no other are opened after the rest, and the share of edges that must go with them; pairs that a task makes distinct, about.
MANY, LESS, DISTINCT = 100_000, 0.25, 1 << 20


def leaves(spark, edges: DataFrame) -> DataFrame:
    """root, node: all that a node is made of, by edges (parent, child); cycles end, as a pair is met once."""
    return expanded(edges).select("root", "node")


def expanded(edges: DataFrame, stop: list | None = None, many: int = MANY) -> DataFrame:
    """root, node, leaf: all that a node is made of, by edges (parent, child); cycles end, as a pair is met once.

    Parts that are recipes themselves are listed and opened; those of stop are listed and stay closed. leaf: whether nothing
    stands below, or it stays closed. Of over so many edges those of parts that stand in no other are set aside, layer by
    layer. What is left is opened in rounds, each one step deeper from the pairs that the last one found; then the layers
    follow, the last one first, and what stands below their parts is known by then. Both are checkpointed, in the shared
    folder that the session names. Joins are merged whatever the sizes, so that no table goes through the driver.
    """
    shared_checkpoints(edges.sparkSession)
    pairs = edges.select("parent", "child").dropna().distinct()
    made = pairs.select(F.col("parent").alias("child"), F.lit(False).alias("leaf")).distinct().where(~F.col("child").isin(stop or []))
    left = pairs.join(made.hint("merge"), "child", "left").select(F.col("parent").alias("root"), F.col("child").alias("node"), F.coalesce("leaf", F.lit(True)).alias("leaf")).checkpoint()

    def below(top: DataFrame, known: DataFrame) -> DataFrame:
        """What stands one step below the pairs of top, by those of known."""
        opened = top.where("not leaf").select(F.col("root").alias("over"), F.col("node").alias("root"))
        return opened.join(known.hint("merge"), "root").select(F.col("over").alias("root"), "node", "leaf")

    def sized(edges: DataFrame):
        return edges.agg(F.count("*"), F.approx_count_distinct("root")).first()

    layers, (n, _) = [], sized(left)
    while n > many:
        inner = left.where("not leaf").select(F.col("node").alias("root")).distinct().hint("merge")
        rest = left.join(inner, "root", "left_semi").checkpoint()
        size, under = sized(rest)
        if size > n * (1 - LESS):
            break
        layers.append((left.join(inner, "root", "left_anti").checkpoint(), n - size, under))
        left, n = rest, size
    found = front = left
    while not front.isEmpty():
        front = below(front, left).distinct().join(found.hint("merge"), ["root", "node"], "left_anti").checkpoint()
        found = found.unionByName(front)
    while layers:
        top, n, under = layers.pop()
        rows = n + n * found.count() // max(under, 1)  # a part below has about as many pairs as the others
        more = top.unionByName(below(top, found)).repartition(rows // DISTINCT + 1, "root", "node").distinct()
        found = found.unionByName(more.checkpoint() if layers else more)
    return found


def targets(people: DataFrame) -> DataFrame:
    """person, kcal, protein_g, fat_g, carb_g, fiber_g of people (person, male, kg, cm, years, activity, goal; if wanted rate, kilograms a week, and tdee, energy spent as measured); under 18 has none.

    A loss is at most LOSS_KG and LOSS_SHARE of the weight a week; energy has a floor. Protein and fat take
    PROTEIN_SHARE + FAT_SHARE of the energy at most, so carbohydrates never run out.
    """
    of = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)]
    said = lambda name: F.col(name) if name in people.columns else F.lit(None).cast("double")
    spent = F.coalesce(said("tdee"), fn.bmr(F.col("male"), F.col("kg"), F.col("cm"), F.col("years")) * of(ACTIVITY, "activity"))
    rate = F.coalesce(said("rate"), of(RATE, "goal"))
    shift = F.when(F.col("goal") == "lose", -F.least(rate, F.lit(LOSS_KG), F.col("kg") * LOSS_SHARE)).when(F.col("goal") == "gain", rate).otherwise(0.0)
    kcal = F.greatest(spent + shift * 7700 / 7, F.when(F.col("male"), 1500.0).otherwise(1200.0))
    protein = F.least(of(PROTEIN, "goal") * F.col("kg"), F.col("k") * PROTEIN_SHARE / 4)
    with_kcal = people.where("years >= 18").withColumn("k", kcal)
    out = with_kcal.withColumn("p", protein).withColumn("f", F.col("k") * FAT_SHARE / 9)
    carb = F.greatest((F.col("k") - F.col("p") * 4 - F.col("f") * 9) / 4, F.lit(0.0))
    return out.select("person", F.bround("k").alias("kcal"), F.bround("p").alias("protein_g"), F.bround("f").alias("fat_g"), F.bround(carb).alias("carb_g"), F.bround(F.col("k") / 1000 * 14).alias("fiber_g"))


def servings(dishes: DataFrame, low: float = 30, high: float = 600) -> DataFrame:
    """Each dish (dish, grams, kcal) in each serving that weighs between low and high."""
    each = dishes.withColumn("serving", F.explode(F.array(*[F.lit(s) for s in SERVINGS])))
    return each.select("dish", "serving", (F.col("grams") * F.col("serving")).alias("grams"), (F.col("kcal") * F.col("serving")).alias("kcal")).where(F.col("grams").between(low, high))


def plan_checks(plans: DataFrame) -> DataFrame:
    """Checks of plans (plan, dish, grams, kcal, target): kcal within 6 %, no dish twice, every portion 30 to 600 g.

    Dishes of a plan are put in order, which spills where it must, and each is held against the one before; distinct pairs
    of plan and dish would all stand in a task's memory. A dish without a number counts as a repeat.
    """
    again = F.col("dish").isNull() | F.coalesce(F.col("dish") == F.lag("dish").over(Window.partitionBy("plan").orderBy("dish")), F.lit(False))
    got = plans.withColumn("again", again).groupBy("plan").agg(F.sum("kcal").alias("kcal"), F.max("target").alias("target"), F.max("again").alias("again"), F.min("grams").alias("least"), F.max("grams").alias("most"))
    return got.select("plan", F.round("kcal", 4).alias("kcal"), (F.abs(F.col("kcal") - F.col("target")) <= 0.06 * F.col("target")).alias("kcal_ok"), (~F.col("again")).alias("no_repeats"), ((F.col("least") >= 30) & (F.col("most") <= 600)).alias("portions_ok"))


def candidates(dishes: DataFrame, terms: list[str], priced: DataFrame | None, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """The dishes (dish, name, section, size: tens of grams, known, sold) that may be offered under restrictions.

    The portion is sane, the dish mainstream, known and sold (null counts as yes), priced where prices matter, and no term
    hits its name, its section, or what it is made of: lines (dish, item) with one of ingredients (item). Prices that
    matter and are empty raise.
    """
    out = dishes.where((F.col("size") * 10).between(30, 600)).where(F.coalesce("known", F.lit(True)) & F.coalesce("sold", F.lit(True)))
    out = out.where(ru.mainstream(F.col("name"), F.col("section"))).where(~rs.matches(F.col("name"), terms) & ~rs.in_section(F.col("section"), terms))
    if priced is not None:
        if priced.isEmpty():
            raise ValueError("no dish has a price")
        out = out.join(priced, "dish", "left_semi")
    return without_items(out, lines, ingredients)


#: Fixed value: how far the energy of a dish may be from that of what it is made of, in parts of it.
ATWATER = 0.25


def energy_fits(kcal: Column, protein_g: Column, fat_g: Column, carb_g: Column) -> Column:
    """Whether the energy of a dish is about 4, 9 and 4 kcal for a gram of protein, fat and carbohydrates; null without energy."""
    return F.abs(F.try_divide(protein_g * 4 + fat_g * 9 + carb_g * 4, kcal) - 1) <= ATWATER
