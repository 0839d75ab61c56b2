"""Queries on dishes, recipes, costs, targets and plans: parts are dishes or ingredients, orders are plans, lines are recipe lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pantrygrid.operators import dishes as k
from pantrygrid.sources import table

_SHARES = """m AS (SELECT l_orderkey AS dish, l_partkey AS item, sum(l_quantity) AS grams FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(grams) OVER (PARTITION BY dish) AS total FROM m),
    k AS (SELECT * FROM w WHERE total > 0 AND grams / total >= 0.01), sh AS (SELECT dish, item, grams / sum(grams) OVER (PARTITION BY dish) AS share FROM k)"""
_PEOPLE = """w AS (SELECT c_custkey AS person, c_custkey % 2 = 1 AS male, CAST(50 + c_custkey % 60 AS DOUBLE) AS kg, CAST(150 + c_custkey % 50 AS DOUBLE) AS cm, CAST(15 + c_custkey % 60 AS DOUBLE) AS years,
        ['sedentary', 'light', 'moderate', 'high', 'athlete'][1 + c_custkey % 5] AS activity, ['lose', 'maintain', 'gain', 'recomp'][1 + c_custkey % 4] AS goal, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 7 AS DOUBLE) / 4 END AS rate FROM customer),
    e AS (SELECT *, greatest((CAST(10 AS DOUBLE) * kg + CAST(6.25 AS DOUBLE) * cm - CAST(5 AS DOUBLE) * years + CASE WHEN male THEN CAST(5 AS DOUBLE) ELSE CAST(-161 AS DOUBLE) END) * CAST([1.2, 1.375, 1.55, 1.725, 1.9][1 + person % 5] AS DOUBLE)
        + CASE goal WHEN 'lose' THEN -least(coalesce(rate, CAST(0.5 AS DOUBLE)), CAST(1 AS DOUBLE), kg * CAST(0.01 AS DOUBLE)) WHEN 'gain' THEN coalesce(rate, CAST(0.25 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END * 7700 / 7, CASE WHEN male THEN CAST(1500 AS DOUBLE) ELSE CAST(1200 AS DOUBLE) END) AS k FROM w WHERE years >= 18),
    g AS (SELECT *, least(CAST([1.8, 1.4, 1.8, 2.0][1 + person % 4] AS DOUBLE) * kg, k * CAST(0.35 AS DOUBLE) / 4) AS p, k * CAST(0.28 AS DOUBLE) / 9 AS f FROM e)"""


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dish"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("grams"))


def _prices(spark, d):
    """Three quarters of the parts have a price."""
    return table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"))


def star_assembly(spark, d):
    lines, part, supplier, nation, region = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation", "region"))
    whole = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    return whole.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


def nutrient_pivot(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.min_by("value", "event_id")).select("user_id", *kinds)


def portion_pick(spark, d):
    first = Window.partitionBy("l_orderkey").orderBy("rank", "l_linenumber", "l_partkey", "l_quantity")
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").withColumn("rank", rank).withColumn("k", F.row_number().over(first)).where("k = 1").select("l_orderkey", "l_linenumber", "l_quantity")


def catalog_quality(spark, d):
    """With the share of dishes whose energy is that of their protein, fat and carbohydrates."""
    p, key = F.col("p_retailprice"), F.col("p_partkey")
    kcal = (40 + key * 53 % 560).cast("double")
    return table(spark, d, "part").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"), F.sum((p < 0).cast("int")).alias("negative"), F.round(F.percentile(p, F.lit(0.5)), 6).alias("median"), F.round(F.avg(k.energy_fits(kcal, kcal * (14 + key % 8) / 256, kcal * (6 + key % 5) / 256, kcal * (15 + key % 30) / 256).cast("int")), 6).alias("near"))


def composition_shares(spark, d):
    return k.shares(_lines(spark, d))


def dish_cost(spark, d):
    """Every other part with a price is as good as free."""
    prices = _prices(spark, d).withColumn("price", F.when(F.col("item") % 8 < 4, F.lit(0.5)).otherwise(F.col("price")))
    return k.cost(k.shares(_lines(spark, d)), prices).select("dish", F.round("coverage", 6).alias("coverage"), F.round(F.col("cost") + 3e-7, 6).alias("cost"))  # halves of the last digit are common: moved off the border


def only_priced_semi(spark, d):
    priced = _lines(spark, d).join(_prices(spark, d), "item", "left_semi").select("dish").distinct()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("dish"), "o_orderstatus").join(priced, "dish", "left_semi")


def recipe_leaves_recursive(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("parent"))
    edges = parts.withColumn("child", F.explode(F.array((F.col("parent") / 2).cast("long"), (F.col("parent") / 3).cast("long")))).where("child > 0")
    return k.leaves(spark, edges)


def recipe_expanded(spark, d):
    """Parts are made of a fifth and a seventh of their number; the first two of each other; sevens stay closed."""
    part = table(spark, d, "part")
    below = part.select(F.col("p_partkey").alias("parent"), F.explode(F.array(F.expr("p_partkey div 5"), F.expr("p_partkey div 7"), F.expr("if(p_partkey <= 2, 3 - p_partkey, 0)"))).alias("child")).where("child > 0")
    return k.expanded(below, [x for x in range(7, 400, 7)])


def shopping_list(spark, d):
    lines = _lines(spark, d).join(_prices(spark, d), "item", "left")
    got = lines.groupBy("item").agg(F.sum("grams").cast("long").alias("grams"), F.count("*").alias("times"), F.max("price").alias("price"))
    return got.select("item", "grams", "times", (F.col("grams") * F.round(F.col("price") * 100).cast("long") / F.lit(100000.0)).alias("cost"))


def _people(spark, d):
    c = F.col("c_custkey")
    pick = lambda *v: F.array(*[F.lit(x) for x in v])[(c % len(v)).cast("int")]
    return table(spark, d, "customer").select(c.alias("person"), (c % 2 == 1).alias("male"), (50 + c % 60).cast("double").alias("kg"), (150 + c % 50).cast("double").alias("cm"), (15 + c % 60).cast("double").alias("years"), pick("sedentary", "light", "moderate", "high", "athlete").alias("activity"), pick("lose", "maintain", "gain", "recomp").alias("goal"), F.when(c % 3 == 0, (c % 7).cast("double") / 4).alias("rate"))


def targets_formula(spark, d):
    return k.targets(_people(spark, d))


def candidates_x_servings(spark, d):
    return k.servings(table(spark, d, "part").select(F.col("p_partkey").alias("dish"), (F.col("p_size") * 10.0).alias("grams"), F.col("p_retailprice").alias("kcal")))


#: Lines of plans that a task holds, about.
LINES = 1 << 20


def plan_checks(spark, d):
    """Plans are dealt by the number of lines, so that tasks do not grow with the tables."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = lines.count() // LINES + 1
    lines, orders = lines.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").repartition(parts, "l_orderkey"), orders.select("o_orderkey", "o_totalprice").repartition(parts, "o_orderkey")
    plans = lines.join(orders.hint("merge"), lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("dish"), (F.col("l_quantity") * 10).alias("grams"), F.col("l_extendedprice").alias("kcal"), F.col("o_totalprice").alias("target"))
    return k.plan_checks(plans)


def ids_digest(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ","), 256).alias("digest"))


QUERIES = [star_assembly, nutrient_pivot, portion_pick, catalog_quality, composition_shares, dish_cost, only_priced_semi, recipe_leaves_recursive, recipe_expanded, shopping_list, targets_formula, candidates_x_servings, plan_checks, ids_digest]
SQL = {
    "star_assembly": "SELECT r_name, p_brand, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "nutrient_pivot": "SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type = '{x}') AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "portion_pick": "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) WHERE k = 1",
    "catalog_quality": "SELECT count(*) AS n, count(DISTINCT p_type) AS types, CAST(sum(CASE WHEN p_retailprice < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, round(median(p_retailprice), 6) AS median, round(avg(CASE WHEN abs((40 + p_partkey * 53 % 560) * ((14 + p_partkey % 8) * 4 + (6 + p_partkey % 5) * 9 + (15 + p_partkey % 30) * 4) / CAST(256 AS DOUBLE) / (40 + p_partkey * 53 % 560) - 1) <= CAST(0.25 AS DOUBLE) THEN 1 ELSE 0 END), 6) AS near FROM part",
    "composition_shares": f"WITH {_SHARES} SELECT dish, item, share FROM sh",
    "dish_cost": f"""WITH {_SHARES}, pr AS (SELECT p_partkey, CASE WHEN p_partkey % 8 < 4 THEN CAST(0.5 AS DOUBLE) ELSE p_retailprice END AS price FROM part WHERE p_partkey % 4 <> 0),
        c AS (SELECT dish, sum(CASE WHEN price < 1 THEN share ELSE 0 END) AS free, sum(CASE WHEN price < 1 THEN share * price ELSE 0 END) AS free_paid, sum(CASE WHEN price >= 1 THEN share ELSE 0 END) AS cover, sum(CASE WHEN price >= 1 THEN share * price ELSE 0 END) AS paid
              FROM sh LEFT JOIN pr ON item = p_partkey GROUP BY 1), o AS (SELECT *, cover > 0 AND cover >= 0.5 * (1 - free) - 1e-9 AS enough FROM c)
        SELECT dish, round(CASE WHEN 1 - free <= 1e-9 OR enough THEN free + cover ELSE cover END, 6) AS coverage,
               round(CASE WHEN 1 - free <= 1e-9 THEN free_paid WHEN enough THEN free_paid + paid * (1 - free) / cover END / 10 + CAST(3e-7 AS DOUBLE), 6) AS cost FROM o""",
    "only_priced_semi": "SELECT o_orderkey AS dish, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 4 <> 0 AND l_partkey IN (SELECT p_partkey FROM part))",
    "recipe_expanded": """WITH RECURSIVE e AS (SELECT DISTINCT parent, child FROM (SELECT p_partkey AS parent, unnest([p_partkey // 5, p_partkey // 7, CASE WHEN p_partkey <= 2 THEN 3 - p_partkey ELSE 0 END]) AS child FROM part) WHERE child > 0),
        x AS (SELECT parent AS root, child AS node FROM e UNION SELECT x.root, e.child FROM x JOIN e ON x.node = e.parent AND NOT (x.node % 7 = 0 AND x.node < 400))
        SELECT root, node, (node % 7 = 0 AND node < 400) OR node NOT IN (SELECT parent FROM e) AS leaf FROM x""",
    "recipe_leaves_recursive": "WITH RECURSIVE e AS (SELECT p_partkey AS parent, unnest([p_partkey // 2, p_partkey // 3]) AS child FROM part), x AS (SELECT parent AS root, child AS node FROM e WHERE child > 0 UNION SELECT x.root, e.child FROM x JOIN e ON x.node = e.parent WHERE e.child > 0) SELECT root, node FROM x",
    "shopping_list": "SELECT l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS grams, count(*) AS times, CAST(sum(l_quantity) AS BIGINT) * CAST(round(max(p_retailprice) * 100) AS BIGINT) / CAST(100000 AS DOUBLE) AS cost FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey GROUP BY 1",
    "targets_formula": f"WITH {_PEOPLE} SELECT person, round_even(k, 0) AS kcal, round_even(p, 0) AS protein_g, round_even(f, 0) AS fat_g, round_even(greatest((k - p * 4 - f * 9) / 4, 0), 0) AS carb_g, round_even(k / 1000 * 14, 0) AS fiber_g FROM g",
    "candidates_x_servings": "SELECT p_partkey AS dish, serving, p_size * 10 * serving AS grams, p_retailprice * serving AS kcal FROM part, (SELECT unnest(CAST([0.5, 0.75, 1, 1.25, 1.5, 2] AS DOUBLE[])) AS serving) WHERE p_size * 10 * serving BETWEEN 30 AND 600",
    "plan_checks": "SELECT l_orderkey AS plan, round(sum(l_extendedprice), 4) AS kcal, abs(sum(l_extendedprice) - max(o_totalprice)) <= CAST(0.06 AS DOUBLE) * max(o_totalprice) AS kcal_ok, count(*) = count(DISTINCT l_partkey) AS no_repeats, min(l_quantity) * 10 >= 30 AND max(l_quantity) * 10 <= 600 AS portions_ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "ids_digest": "SELECT p_brand, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS digest FROM part GROUP BY 1",
}
