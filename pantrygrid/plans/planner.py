"""Queries on plans of days and menus: suppliers are people, parts are dishes, orders are days eaten."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pantrygrid.operators import menus as m
from pantrygrid.operators import planner as p
from pantrygrid.sources import table

#: Dishes and goals in numbers that binary fractions hold, so that sums do not depend on their order.
_DISH = {
    "grams": "60 + p_partkey * 37 % 300", "kcal": "40 + p_partkey * 53 % 560", "protein_g": "(40 + p_partkey * 53 % 560) * (14 + p_partkey % 8) / 256", "fat_g": "(40 + p_partkey * 53 % 560) * (6 + p_partkey % 5) / 256",
    "carb_g": "(40 + p_partkey * 53 % 560) * (23 + p_partkey % 9) / 256", "fiber_g": "(40 + p_partkey * 53 % 560) * (2 + p_partkey % 3) / 256", "sugar_g": "(40 + p_partkey * 53 % 560) * (p_partkey % 5) / 256", "sodium_mg": "(40 + p_partkey * 53 % 560) * (p_partkey % 4) / 4",
}
_ROLES = ["breakfast", "main", "side", "snack", "drink"]
_GOAL = {"kcal": "1", "protein_g": "18 / 256", "fat_g": "8 / 256", "carb_g": "27 / 256", "fiber_g": "3 / 256"}


def _dishes(spark, d):
    role = F.array(*[F.lit(r) for r in _ROLES])[(F.col("p_partkey") % 5).cast("int")]
    cost = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice").cast("double") / 131072)
    return table(spark, d, "part").select(F.col("p_partkey").alias("dish"), F.col("p_name").alias("name"), role.alias("role"), *[F.expr(e).cast("double").alias(n) for n, e in _DISH.items()], cost.alias("cost"))


def _people(spark, d):
    kcal = (1600 + F.col("s_suppkey") % 13 * 100).cast("double")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), *[(kcal * F.expr(f"double({e})")).alias(g) for g, e in _GOAL.items()])


def greedy_fill(spark, d):
    return p.greedy(_dishes(spark, d), _people(spark, d))


def swap_rank(spark, d):
    """What may stand for the side dish at dinner of the greedy day, which is that of lunch."""
    dishes, people = _dishes(spark, d), _people(spark, d)
    got = p.swaps(dishes, p.greedy(dishes, people).select("person", "meal", "dish", "serving"), people, 4)
    return got.select("person", "rank", "dish", "serving", F.round("loss", 6).alias("loss"))


def swap_quality(spark, d):
    """Swaps of all places of the greedy days."""
    dishes, people = _dishes(spark, d), _people(spark, d)
    got = p.swap_sweep(dishes, p.greedy(dishes, people).select("person", "meal", "dish", "serving"), people)
    return got.select("swaps", F.round("in_band", 6).alias("in_band"), F.round("median", 5).alias("median"), F.round("p90", 5).alias("p90"), F.round("variety", 6).alias("variety"), "short")


def menu_variety_window(spark, d):
    """Orders of a customer are days, in order."""
    day = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    days = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), day.alias("day"))
    lines = table(spark, d, "lineitem")
    return p.repeats_within(days.join(lines, days["o_orderkey"] == lines["l_orderkey"]).select("person", "day", (F.col("l_partkey") % 50).alias("dish")))


def residual_targets(spark, d):
    """Goals after a breakfast and a lunch that every other person has had."""
    dishes = _dishes(spark, d)
    people = _people(spark, d)
    eaten = p.items(p.greedy(dishes, people.where("person % 2 = 0")).where("meal < 2").drop("kcal"), dishes.drop("name"), "person")
    got = p.residual(people, eaten)
    return got.select("person", *[F.round(g, 6).alias(g) for g in p.GOALS], F.round("sodium", 6).alias("sodium"), *[F.round(F.col("shares")[i], 6).alias(f"share_{i}") for i in range(len(p.MEALS))])


def day_plan_solver(spark, d):
    return p.day_plans(_dishes(spark, d), _people(spark, d)).select("person", "meal", "dish", "serving", "failed")


def day_plan_on_budget(spark, d):
    """Every third person has money for a day."""
    people = _people(spark, d).withColumn("budget", F.when(F.col("person") % 3 == 0, F.lit(9.0)))
    return p.day_plans(_dishes(spark, d), people).select("person", "meal", "dish", "serving", "failed")


def menu_solver(spark, d):
    return p.menu(_dishes(spark, d), _people(spark, d), 3, retries=1)


def rest_of_day(spark, d):
    dishes, people = _dishes(spark, d), _people(spark, d)
    eaten = p.items(p.greedy(dishes, people).where("meal < 2").drop("kcal"), dishes.drop("name"), "person")
    return p.rest_of_day(dishes, people, eaten, retries=1)


def solver_measure(spark, d):
    """Over all people: failed days, mean and worst deviation of energy."""
    dishes, people = _dishes(spark, d), _people(spark, d)
    got = p.day_plans(dishes, people, retries=1)
    rank = p.judged(got.select("person", "meal", "dish", "serving"), dishes, people.withColumn("sodium", F.lit(m.SODIUM)), "person")
    return rank.agg(F.count("*").alias("days"), F.count_if(F.col("failed") > 0).alias("failed"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("worst_gap"))


QUERIES = [greedy_fill, swap_rank, swap_quality, menu_variety_window, residual_targets, day_plan_solver, day_plan_on_budget, menu_solver, rest_of_day, solver_measure]
_D = lambda e: e.replace("/ 256", "/ CAST(256 AS DOUBLE)").replace("/ 4", "/ CAST(4 AS DOUBLE)")
_DISHES = f"""ds AS (SELECT p_partkey AS dish, [{', '.join(repr(r) for r in _ROLES)}][1 + p_partkey % 5] AS role, {', '.join(f'CAST({_D(e)} AS DOUBLE) AS {n}' for n, e in _DISH.items())} FROM part),
    pe AS (SELECT s_suppkey AS person, {', '.join(f'CAST(1600 + s_suppkey % 13 * 100 AS DOUBLE) * CAST({_D(e)} AS DOUBLE) AS {g}' for g, e in _GOAL.items())} FROM supplier),
    po AS (SELECT dish, role, s AS serving, {', '.join(f'{n} * s AS {n}' for n in _DISH)} FROM ds, (SELECT unnest(CAST([0.5, 0.75, 1, 1.25, 1.5, 2] AS DOUBLE[])) AS s) WHERE grams * s BETWEEN 30 AND 600),
    me AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{r}', CAST({s} AS DOUBLE))" for i, (_, r, s) in enumerate(p.MEALS))}) x(meal, role, share)),
    gr AS (SELECT person, CAST(meal AS INTEGER) AS meal, dish, serving, kcal FROM (SELECT person, meal, dish, serving, po.kcal, row_number() OVER (PARTITION BY person, meal ORDER BY abs(po.kcal - pe.kcal * share), dish, serving) AS k FROM pe, me JOIN po USING (role) WHERE po.kcal <= pe.kcal * share * 2) WHERE k = 1)"""
_N = list(m.NUTRIENTS)
_LOSS = " + ".join(
    [f"CASE WHEN t.{g} > 0 THEN CAST({w} AS DOUBLE) * abs((x.{g} - t.{g}) / t.{g}) * CASE WHEN x.{g} < t.{g} THEN {m.SHORT.get(g, 1.0)} ELSE 1 END ELSE 0 END" for g, w in m.WEIGHTS.items()]
    + ["3 * greatest(x.sodium_mg - 2300, 0) / CAST(2300 AS DOUBLE)", "3 * greatest(x.sugar_g * 4 / greatest(x.kcal, 1) - CAST(0.1 AS DOUBLE), 0)"]
)
_PASS = " AND ".join([f"x.{n} / t.{n} - 1 BETWEEN CAST({a} AS DOUBLE) AND CAST({b} AS DOUBLE)" for n, (a, b) in m.TOLERANCES.items()] + ["x.fiber_g >= t.fiber_g * CAST(0.6 AS DOUBLE)", "x.sodium_mg <= 2300", "x.least >= 30", "x.most <= 600", "x.single"])


def _swaps_of(meal: int) -> str:
    """The first swaps of one place, with the figures of the new day."""
    _, role, share = p.MEALS[meal]
    return f"""re{meal} AS (SELECT person, {', '.join(f'sum(CASE WHEN meal <> {meal} THEN {n} ELSE 0 END) AS {n}' for n in _N)}, list(dish) AS taken, min(grams) FILTER (WHERE meal <> {meal}) AS low, max(grams) FILTER (WHERE meal <> {meal}) AS high, count(DISTINCT dish) FILTER (WHERE meal <> {meal}) = count(*) - 1 AS single FROM it GROUP BY 1),
        x{meal} AS (SELECT r.person, po.dish, po.serving, {', '.join(f'r.{n} + po.{n} AS {n}' for n in _N)}, least(low, grams) AS least, greatest(high, grams) AS most, single FROM re{meal} r JOIN pe USING (person) JOIN po ON po.role = '{role}' AND NOT list_contains(taken, po.dish) AND po.kcal <= pe.kcal * CAST({share} AS DOUBLE) * CAST(2.5 AS DOUBLE)),
        l{meal} AS (SELECT x.person, dish, serving, {_LOSS} AS loss, {' AND '.join(f'abs(x.{g} / t.{g} - 1) <= CAST(0.1 AS DOUBLE)' for g in p.GOALS[:4])} AS near FROM x{meal} x JOIN pe t ON x.person = t.person WHERE {_PASS}),
        u{meal} AS (SELECT *, min(loss) OVER (PARTITION BY person) AS best FROM (SELECT *, row_number() OVER (PARTITION BY person, dish ORDER BY loss, serving) AS k FROM l{meal}) WHERE k = 1),
        r{meal} AS (SELECT {meal} AS meal, * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY round(loss, 9), dish) AS rank FROM u{meal} WHERE loss <= best * CAST(1.2 AS DOUBLE)) WHERE rank <= 3)"""


SQL = {
    "swap_quality": f"""WITH {_DISHES}, it AS (SELECT gr.person, gr.meal, po.* FROM gr JOIN po USING (dish, serving)), {', '.join(_swaps_of(k) for k in range(7))},
        x AS (SELECT person, {', '.join(f'sum({n}) AS {n}' for n in _N)} FROM it GROUP BY 1), b AS (SELECT x.person, {_LOSS} AS before FROM x JOIN pe t ON x.person = t.person),
        e AS (SELECT r.*, loss / greatest(before, CAST(1e-9 AS DOUBLE)) AS growth FROM ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(7))}) r JOIN b USING (person)),
        n AS (SELECT gr.person, gr.meal, count(DISTINCT e.dish) AS n FROM gr LEFT JOIN e ON gr.person = e.person AND gr.meal = e.meal GROUP BY 1, 2),
        o AS (SELECT growth, row_number() OVER (ORDER BY growth) - 1 AS place FROM e), w AS (SELECT count(*) AS swaps, avg(CASE WHEN near THEN 1 ELSE 0 END) AS in_band, median(growth) AS m FROM e)
        SELECT swaps, round(in_band, 6) AS in_band, round(m, 5) AS median, (SELECT round(growth, 5) FROM o WHERE place = CAST(floor(swaps * CAST(0.9 AS DOUBLE)) AS BIGINT)) AS p90,
               (SELECT round(avg(n), 6) FROM n WHERE n > 0) AS variety, (SELECT count(*) FROM n WHERE n < 3) AS short FROM w""",
    "greedy_fill": f"WITH {_DISHES} SELECT person, meal, dish, serving, kcal FROM gr",
    "swap_rank": f"""WITH {_DISHES}, it AS (SELECT gr.person, gr.meal, po.* FROM gr JOIN po USING (dish, serving)),
        re AS (SELECT person, {', '.join(f'sum({n}) FILTER (WHERE meal <> 4) AS {n}' for n in _N)}, list(dish) AS taken, min(grams) FILTER (WHERE meal <> 4) AS low, max(grams) FILTER (WHERE meal <> 4) AS high, count(DISTINCT dish) FILTER (WHERE meal <> 4) = count(*) - 1 AS single FROM it GROUP BY 1),
        x AS (SELECT re.person, po.dish, po.serving, {', '.join(f're.{n} + po.{n} AS {n}' for n in _N)}, least(low, grams) AS least, greatest(high, grams) AS most, single FROM re JOIN pe USING (person) JOIN po ON po.role = 'side' AND NOT list_contains(taken, po.dish) AND po.kcal <= pe.kcal * CAST(0.09 AS DOUBLE) * CAST(2.5 AS DOUBLE)),
        l AS (SELECT x.person, dish, serving, {_LOSS} AS loss FROM x JOIN pe t ON x.person = t.person WHERE {_PASS}),
        u AS (SELECT *, min(loss) OVER (PARTITION BY person) AS best FROM (SELECT *, row_number() OVER (PARTITION BY person, dish ORDER BY loss, serving) AS k FROM l) WHERE k = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY round(loss, 9), dish) AS rank FROM u WHERE loss <= best * CAST(1.2 AS DOUBLE))
        SELECT person, CAST(rank AS INTEGER) AS rank, dish, serving, round(loss, 6) AS loss FROM r WHERE rank <= 5""",
    "menu_variety_window": """WITH o AS (SELECT o_orderkey, o_custkey AS person, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS day FROM orders), e AS (SELECT DISTINCT person, day, l_partkey % 50 AS dish FROM o JOIN lineitem ON l_orderkey = o_orderkey)
        SELECT person, CAST(day AS INTEGER) AS day, dish, EXISTS (SELECT 1 FROM e b WHERE b.person = e.person AND b.dish = e.dish AND b.day < e.day AND b.day >= e.day - 2) AS repeated FROM e""",
    "residual_targets": f"""WITH {_DISHES}, it AS (SELECT gr.person, gr.meal, po.* FROM gr JOIN po USING (dish, serving) WHERE gr.meal < 2 AND gr.person % 2 = 0), a AS (SELECT person, {', '.join(f'sum({n}) AS {n}' for n in _N)}, max(CASE WHEN meal = 0 THEN 1 ELSE 0 END) AS c0, max(CASE WHEN meal = 1 THEN 1 ELSE 0 END) AS c1 FROM it GROUP BY 1),
        s AS (SELECT *, (1 - c0) * CAST(0.25 AS DOUBLE) + (1 - c1) * CAST(0.24 AS DOUBLE) + CAST(0.51 AS DOUBLE) AS whole FROM a)
        SELECT t.person, {', '.join(f'round(greatest(t.{g} - s.{g}, 0), 6) AS {g}' for g in p.GOALS)}, round(greatest(2300 - s.sodium_mg, 0), 6) AS sodium, round((1 - c0) * CAST(0.25 AS DOUBLE) / whole, 6) AS share_0, round((1 - c1) * CAST(0.24 AS DOUBLE) / whole, 6) AS share_1,
        {', '.join(f'round(CAST({s} AS DOUBLE) / whole, 6) AS share_{i}' for i, (*_, s) in enumerate(p.MEALS) if i > 1)} FROM s JOIN pe t ON s.person = t.person WHERE t.kcal - s.kcal >= 150""",
}
