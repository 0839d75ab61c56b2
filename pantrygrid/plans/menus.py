"""Queries on day plans, adaptive targets, chunks and the comparison of runs: orders are plans, users are people, event types are runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pantrygrid.functions import text as t
from pantrygrid.operators import menus as m
from pantrygrid.operators import retrieval as r
from pantrygrid.plans import kitchen, search
from pantrygrid.sources import table

#: Nutrients of a line by its quantity and part, whole numbers, so that sums are exact in any order.
_NUTRIENTS = {"kcal": "l_quantity * 20", "protein_g": "l_quantity * (l_partkey % 3)", "fat_g": "l_quantity * (l_partkey % 2)", "carb_g": "l_quantity * (l_partkey % 5)", "fiber_g": "l_quantity * (l_partkey % 4) / 4", "sugar_g": "l_quantity * (l_partkey % 7) / 8", "sodium_mg": "l_quantity * (l_partkey % 50)"}
_TARGETS = {"kcal": "1500 + o_orderkey % 5 * 250", "protein_g": "90 + o_orderkey % 3 * 16", "fat_g": "64", "carb_g": "o_orderkey % 4 * 96", "fiber_g": "o_orderkey % 2 * 32"}


def _items(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("dish"), (F.col("l_quantity") * 10).alias("grams"), *[F.expr(e).cast("double").alias(n) for n, e in _NUTRIENTS.items()])


def _targets(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("plan"), *[F.expr(e).cast("double").alias(f"target_{n}") for n, e in _TARGETS.items()])


def day_plan_checks(spark, d):
    return m.day_checks(_items(spark, d), _targets(spark, d))


def day_plan_loss(spark, d):
    return m.day_loss(_items(spark, d), _targets(spark, d)).select("plan", F.round("loss", 6).alias("loss"), "feasible")


def cycled_targets(spark, d):
    return m.cycled(kitchen.targets_formula(spark, d).join(kitchen._people(spark, d).select("person", "activity"), "person"))


def adaptive_expenditure(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), "value", "event_type")
    weights = e.where("event_type <> 'view'").groupBy("key", "day").agg((F.max("value") / 1024 + 70).alias("y"))
    eaten = e.where("event_type = 'view'").groupBy("key", "day").agg((F.count("*") * 1000.0).alias("kcal"))
    return m.expenditure(weights, eaten, 2000.0, 1900.0).select("key", "tdee", F.round("kg_per_week", 6).alias("kg_per_week"))


def cleaned_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(t.clean(F.col("text")), 256).alias("digest"))


def corpus_chunks(spark, d):
    return m.corpus_chunks(table(spark, d, "documents")).select("doc_id", "pos", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def document_numbers(spark, d):
    return m.numbered(table(spark, d, "documents").where("n_chars >= 300").select("doc_id"), "doc_id", "number")


def _rankings(spark, d):
    v = table(spark, d, "embeddings")
    return [r.nearest(search._asked(v), v, 10).withColumnRenamed("vec_id", "doc_id"), r.nearest(search._asked(v), v, 10, same="label").withColumnRenamed("vec_id", "doc_id")]


def relevance_pool(spark, d):
    return m.pooled(_rankings(spark, d))


def parent_expansion(spark, d):
    of = table(spark, d, "embeddings").select(F.col("vec_id").alias("child"), F.col("label").cast("long").alias("parent"))
    return m.parents(_rankings(spark, d)[0].withColumnRenamed("doc_id", "child"), of)


def nearest_servings(spark, d):
    """The serving of each dish that is closest to 300 g, the smaller of two."""
    best = Window.partitionBy("dish").orderBy(F.abs(F.col("grams") - 300), "serving")
    return kitchen.candidates_x_servings(spark, d).withColumn("k", F.row_number().over(best)).where("k = 1").select("dish", "serving", "grams")


def daily_pivot_mean(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    got = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", kinds).agg(F.round(F.avg("value"), 6))
    return got.select("day", *kinds)


def macro_average(spark, d):
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.max("value").alias("x"))
    return per.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.max("x").alias("worst"))


def judge_noise(spark, d):
    """Runs are event types: how far their means lie apart, and the share of users whose rounded means differ."""
    e = table(spark, d, "events").where("value is not null")
    spread = e.groupBy("event_type").agg(F.avg("value").alias("m")).agg(F.round(F.max("m") - F.min("m"), 6).alias("spread"))
    per = e.groupBy("user_id", "event_type").agg(F.round(F.avg("value")).alias("m")).groupBy("user_id").agg(F.count_distinct("m").alias("n"))
    return spread.join(per.agg(F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("unstable")), how="cross")  # one row each


def wins_and_losses(spark, d):
    """Users by whether clicks or views are worth more."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    off = table(spark, d, "events").groupBy("user_id").agg((mean("click") - mean("view")).alias("off")).where("off is not null")
    return off.groupBy(F.when(F.col("off") > 1e-9, "win").when(F.col("off") < -1e-9, "loss").otherwise("tie").alias("outcome")).agg(F.count("*").alias("n"))


def breadth_buckets(spark, d):
    """Plans by the number of their lines, right-closed."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    bucket = F.when(F.col("n") <= 1, "1").when(F.col("n") <= 4, "2-4").otherwise("5+")
    return per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("plans"), F.sum("q").cast("long").alias("quantity"))


def priced_share(spark, d):
    lines = kitchen._lines(spark, d).join(kitchen._prices(spark, d), "item", "left")
    got = lines.groupBy("dish").agg(F.sum(F.when(F.col("price").isNotNull(), F.col("grams"))).alias("p"), F.sum("grams").alias("g"))
    return got.select("dish", F.round(F.when(F.col("g") > 0, F.coalesce("p", F.lit(0.0)) / F.col("g")).otherwise(0.0), 6).alias("priced"))


def median_latency(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.count("*").alias("n"))


def bounded_store(spark, d):
    """The 100 users that were seen last."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated")).orderBy(F.desc("updated"), "user_id").limit(100)


def sessions_by_gap(spark, d):
    """Sessions of a user end after six hours without an event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.when(at - F.lag(at).over(order) <= 6 * 3_600_000_000, 0).otherwise(1)
    return table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


def chunk_table(spark, d):
    """Chunks of cleaned documents as a table function in SQL, under the document's source as title, numbered over the corpus."""
    t.register_chunks(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", t.clean(F.col("text")).alias("text"))
    each = spark.sql("SELECT d.doc_id, c.pos, c.section, c.text FROM {docs} d, LATERAL chunks(d.text, 900, 150, d.source) c", docs=docs)
    return m.numbered(each.withColumn("key", F.struct("doc_id", "pos")), "key", "chunk_id").select("chunk_id", "doc_id", "pos", "section", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def basket_estimate(spark, d):
    """Orders as menus of one to seven days; three of four parts have a cost."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("menu"), F.col("l_quantity").cast("double").alias("grams"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity") * (F.col("l_partkey") % 64) / 8.0).alias("cost"))
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("menu"), (F.col("o_orderkey") % 7 + 1).alias("days"))
    return m.baskets(lines, days).select("menu", "grams", F.round("priced", 6).alias("priced"), "cost", "a_day", "partial")


QUERIES = [basket_estimate, day_plan_checks, day_plan_loss, cycled_targets, adaptive_expenditure, cleaned_text, corpus_chunks, chunk_table, document_numbers, relevance_pool, parent_expansion, nearest_servings, daily_pivot_mean, macro_average, judge_noise, wins_and_losses, breadth_buckets, priced_share, median_latency, bounded_store, sessions_by_gap]

_D = lambda x: f"CAST({x} AS DOUBLE)"
_DAY = f"""i AS (SELECT l_orderkey AS plan, l_partkey AS dish, l_quantity * 10 AS grams, {", ".join(f"{_D(e)} AS {n}" for n, e in _NUTRIENTS.items())} FROM lineitem),
    s AS (SELECT plan, {", ".join(f"sum({n}) AS {n}" for n in _NUTRIENTS)}, count(*) AS items, count(DISTINCT dish) AS dishes, min(grams) AS least, max(grams) AS most FROM i GROUP BY 1),
    g AS (SELECT o_orderkey AS plan, {", ".join(f"{_D(e)} AS t_{n}" for n, e in _TARGETS.items())} FROM orders)"""
_RANGES = ", ".join(f"CASE WHEN t_{n} > 0 THEN {n} / t_{n} - 1 BETWEEN {_D(a)} AND {_D(b)} ELSE false END AS {n}_in_range" for n, (a, b) in m.TOLERANCES.items())
_LOSS = " + ".join(f"CASE WHEN t_{n} > 0 THEN {_D(w)} * abs({n} - t_{n}) / t_{n} * CASE WHEN {n} < t_{n} THEN {m.SHORT.get(n, 1.0)} ELSE 1 END ELSE 0 END" for n, w in m.WEIGHTS.items())
_RULES = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in t.DEPARTMENTS)
_WORDS = " ".join(f"WHEN regexp_matches(x, '{p}') THEN {k}" for p, k in t.SPANS)
_POOL = f"{search._NEAR}, a AS (SELECT query_id, vec_id, {search._TOP} AS rank FROM s), b AS (SELECT query_id, vec_id, {search._TOP} AS rank FROM s WHERE ql = cl)"
SQL = {
    "basket_estimate": """WITH l AS (SELECT l_orderkey AS menu, CAST(l_quantity AS DOUBLE) AS grams, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity * (l_partkey % 64) / CAST(8 AS DOUBLE) END AS cost FROM lineitem),
        s AS (SELECT menu, sum(grams) AS grams, coalesce(sum(grams) FILTER (cost IS NOT NULL), 0) / sum(grams) AS priced, sum(cost) AS paid FROM l GROUP BY 1), o AS (SELECT s.*, o_orderkey % 7 + 1 AS days FROM s JOIN orders ON menu = o_orderkey)
        SELECT menu, grams, round(priced, 6) AS priced, CASE WHEN priced >= 0.5 THEN round_even(paid / 10, 0) * 10 END AS cost, CASE WHEN days > 1 AND priced >= 0.5 THEN round_even(paid / days / 10, 0) * 10 END AS a_day, priced >= 0.5 AND priced < CAST(0.95 AS DOUBLE) AS partial FROM o""",
    "day_plan_checks": f"WITH {_DAY} SELECT plan, {_RANGES}, t_fiber_g <= 0 OR fiber_g >= t_fiber_g * {_D(0.6)} AS fiber_sufficient, sodium_mg <= 2300 AS sodium_within_limit, items = dishes AS no_duplicates, least >= 30 AND most <= 600 AS portions_sane FROM s JOIN g USING (plan)",
    "day_plan_loss": f"WITH {_DAY} SELECT plan, round({_LOSS} + 3 * greatest(sodium_mg - 2300, 0) / 2300 + 3 * greatest(sugar_g * 4 / greatest(kcal, 1) - {_D(0.1)}, 0), 6) AS loss, sodium_mg <= 2300 AS feasible FROM s JOIN g USING (plan)",
    "cycled_targets": f"""WITH {kitchen._PEOPLE}, base AS (SELECT person, [0, 1, 3, 4, 6][1 + person % 5] AS n, round_even(k, 0) AS kcal, round_even(p, 0) * 4 AS pk, round_even(f, 0) * 9 AS fk FROM g),
        up AS (SELECT *, kcal * (1 + least({_D(0.1)}, greatest((7 - {_D(0.85)} * (7 - n)) / n - 1, 0))) AS high FROM base WHERE n BETWEEN 1 AND 6),
        x AS (SELECT person, pk, fk, 'training' AS day_kind, high AS k FROM up UNION ALL SELECT person, pk, fk, 'rest', (kcal * 7 - high * n) / (7 - n) FROM up),
        u AS (SELECT *, CASE WHEN k - pk - fk < k * {_D(0.15)} THEN greatest(k * {_D(0.2)}, k - pk - k * {_D(0.15)}) ELSE fk END AS fat FROM x)
        SELECT person, day_kind, round_even(k, 0) AS kcal, round_even(fat / 9, 0) AS fat_g, round_even(greatest(k - pk - fat, 0) / 4, 0) AS carb_g, round_even(k / 1000 * 14, 0) AS fiber_g FROM u""",
    "adaptive_expenditure": f"""WITH e AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, value, event_type FROM events),
        w AS (SELECT *, max(day) OVER (PARTITION BY key) AS today FROM (SELECT key, day, max(value) / 1024 + 70 AS y FROM e WHERE event_type <> 'view' GROUP BY 1, 2) WHERE y IS NOT NULL),
        rc AS (SELECT * FROM w WHERE date_diff('day', day, today) <= 28), sp AS (SELECT key, min(day) AS a, max(day) AS b FROM rc GROUP BY 1 HAVING count(*) >= 4 AND date_diff('day', min(day), max(day)) >= 14),
        sl AS (SELECT p.key, median((q.y - p.y) / date_diff('day', p.day, q.day)) AS slope FROM rc p JOIN rc q ON p.key = q.key AND p.day < q.day GROUP BY 1),
        v AS (SELECT key, day, count(*) * {_D(1000)} AS kcal FROM e WHERE event_type = 'view' GROUP BY 1, 2),
        c AS (SELECT key, CAST(unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM sp),
        f AS (SELECT c.key, avg(coalesce(v.kcal, 1900)) AS intake FROM c ASOF LEFT JOIN v ON c.key = v.key AND c.day >= v.day GROUP BY 1)
        SELECT key, round_even(least(greatest(intake - slope * 7700, {_D(2000)} * (1 - {_D(0.1)})), {_D(2000)} * (1 + {_D(0.1)})), 0) AS tdee, round(slope * 7, 6) AS kg_per_week FROM f JOIN sl USING (key)""",
    "document_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents WHERE n_chars >= 300",
    "relevance_pool": f"WITH {_POOL}, u AS (SELECT query_id, vec_id, 0 AS source, rank FROM a WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, 1, rank FROM b WHERE rank <= 10), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY source, rank) AS n FROM u) SELECT query_id, vec_id AS doc_id, source, CAST(rank AS INTEGER) AS rank FROM k WHERE n = 1",
    "parent_expansion": f"WITH {_POOL}, h AS (SELECT query_id, v.label AS parent, min(rank) AS first FROM a JOIN v USING (vec_id) WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, parent) AS INTEGER) AS rank, CAST(parent AS BIGINT) AS parent FROM h",
    "nearest_servings": f"WITH c AS ({kitchen.SQL['candidates_x_servings']}) SELECT dish, serving, grams FROM (SELECT *, row_number() OVER (PARTITION BY dish ORDER BY abs(grams - 300), serving) AS k FROM c) WHERE k = 1",
    "daily_pivot_mean": "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{x}'), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "macro_average": "SELECT event_type, round(avg(m), 6) AS mean_of_means, max(x) AS worst FROM (SELECT event_type, user_id, avg(value) AS m, max(value) AS x FROM events GROUP BY 1, 2) GROUP BY 1",
    "judge_noise": "SELECT (SELECT round(max(m) - min(m), 6) FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)) AS spread, (SELECT round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) FROM (SELECT user_id, count(DISTINCT m) AS n FROM (SELECT user_id, event_type, round(avg(value)) AS m FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1)) AS unstable",
    "wins_and_losses": f"SELECT CASE WHEN x > {_D(1e-9)} THEN 'win' WHEN x < -{_D(1e-9)} THEN 'loss' ELSE 'tie' END AS outcome, count(*) AS n FROM (SELECT avg(value) FILTER (WHERE event_type = 'click') - avg(value) FILTER (WHERE event_type = 'view') AS x FROM events GROUP BY user_id) WHERE x IS NOT NULL GROUP BY 1",
    "breadth_buckets": "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS plans, CAST(sum(q) AS BIGINT) AS quantity FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) GROUP BY 1",
    "priced_share": "SELECT l_orderkey AS dish, round(CASE WHEN sum(l_quantity) > 0 THEN coalesce(sum(CASE WHEN p_partkey IS NOT NULL THEN l_quantity END), 0) / sum(l_quantity) ELSE 0 END, 6) AS priced FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON l_partkey = p_partkey GROUP BY 1",
    "median_latency": "SELECT event_type, CAST(ts AS DATE) AS day, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY 1, 2",
    "bounded_store": "SELECT user_id, max(ts) AS updated FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "sessions_by_gap": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT user_id, session, count(*) AS n, min(ts) AS start FROM b GROUP BY 1, 2",
}
