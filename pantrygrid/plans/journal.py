"""Queries on series, logs and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pantrygrid.operators import logs as g
from pantrygrid.sources import table


def _daily(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.max("value").alias("y"))


def theil_sen_slope(spark, d):
    return g.slopes(_daily(spark, d)).select("key", F.round("slope", 6).alias("slope"))


def intake_forward_fill(spark, d):
    return g.filled(_daily(spark, d))


def daily_budget_counter(spark, d):
    run = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("used", F.row_number().over(run)).select("event_id", "used", (F.col("used") <= 2).alias("accepted"))


def sliding_window_count(spark, d):
    hour = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(hour).alias("n"))


def rate_limit_decisions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return g.rate_limited(e, 2, 86400.0)


def window_retry_after(spark, d):
    return g.window_view(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), 2, 86400)


def transcript_markdown(spark, d):
    return g.markdown(table(spark, d, "conversations")).select("conv_id", "number", F.sha2("markdown", 256).alias("digest"))


def ttl_active_sessions(spark, d):
    e = table(spark, d, "events")
    end = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max("ts").alias("updated")).join(F.broadcast(end), how="cross").where("now - updated <= interval 1 day").select("user_id", "updated")


def retention_by_day(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    border = e.agg(F.date_sub(F.max("day"), 7).alias("border"))
    return e.join(F.broadcast(border), how="cross").where("day >= border").groupBy("day").agg(F.count("*").alias("n"))


def transcript(spark, d):
    return g.transcript(table(spark, d, "conversations"))


def history_last_k(spark, d):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    cut = F.when((F.col("role") == "assistant") & (F.length("text") > 200), F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").withColumn("k", F.row_number().over(last)).where("k <= 6").select("conv_id", "turn", "role", cut.alias("text"))


def section_carry_forward(spark, d):
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("role") == "user", F.substring("text", 1, 20))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.last(head, ignorenulls=True).over(so_far), F.lit("Introduction")).alias("section"))


def idle_sessions(spark, d):
    """Stretches of a user's events without a day's pause."""
    return g.sessions(table(spark, d, "events").select(F.col("user_id").alias("session"), "ts"), 24)


def step_medians(spark, d):
    """Traces of conversations, written as text and read back: a step for each turn, with an answer of a model where the assistant spoke; every ninth trace is torn."""
    c = table(spark, d, "conversations")
    step = F.struct("turn", F.col("role").alias("node"), (F.length("text") / 64).alias("seconds"), F.when(F.col("role") == "assistant", F.array(F.substring("text", 1, 5))).alias("llm"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    text = F.to_json(F.transform("steps", lambda x: F.struct(x["node"].alias("node"), x["seconds"].alias("seconds"), x["llm"].alias("llm"))))
    torn = F.when(F.col("conv_id") % 9 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    got = g.step_medians(g.trace_steps(whole.select("conv_id", text.alias("text")).select(F.col("conv_id").alias("turn"), torn.alias("trace"))))
    return got.select("node", "turns", F.round("seconds", 6).alias("seconds"), F.round("calls", 6).alias("calls"))


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def dedup_union_first(spark, d):
    both = table(spark, d, "benchmark").select(F.lit(0).alias("src"), F.col("item_id").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.lit(1).alias("src"), F.col("doc_id").alias("id"), "text"))
    first = both.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("src", "id")).alias("f"))
    return first.select("digest", "f.src", "f.id")


QUERIES = [theil_sen_slope, intake_forward_fill, daily_budget_counter, sliding_window_count, rate_limit_decisions, window_retry_after, transcript_markdown, ttl_active_sessions, retention_by_day, transcript, history_last_k, section_carry_forward, json_props, dedup_union_first, idle_sessions, step_medians]
_DAILY = "p AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, max(value) AS y FROM events GROUP BY 1, 2)"
SQL = {
    "theil_sen_slope": f"WITH {_DAILY} SELECT a.key, round(median((b.y - a.y) / date_diff('day', a.day, b.day)), 6) AS slope FROM p a JOIN p b ON a.key = b.key AND a.day < b.day GROUP BY 1",
    "intake_forward_fill": f"WITH {_DAILY}, r AS (SELECT key, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p GROUP BY key) SELECT r.key, r.day, last_value(p.y IGNORE NULLS) OVER (PARTITION BY r.key ORDER BY r.day) AS y FROM r LEFT JOIN p ON p.key = r.key AND p.day = r.day",
    "daily_budget_counter": "SELECT event_id, CAST(used AS INTEGER) AS used, used <= 2 AS accepted FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used FROM events)",
    "sliding_window_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events",
    "window_retry_after": "WITH e AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, count(*) OVER w AS n, min(epoch_us(ts)) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) SELECT id, n, CASE WHEN n > 2 THEN 86400 - (t - f) / CAST(1000000 AS DOUBLE) ELSE 0 END AS retry_after FROM e",
    "transcript_markdown": """WITH t AS (SELECT conv_id, '## Conversation ' || dense_rank() OVER (ORDER BY conv_id) AS h, dense_rank() OVER (ORDER BY conv_id) AS number, turn, role, '### ' || turn || '. ' || role || chr(10) || chr(10) || CASE WHEN role = 'user' THEN '> ' || replace(coalesce(text, ''), chr(10), chr(10) || '> ') ELSE coalesce(text, '—') END AS b, text FROM conversations)
        SELECT conv_id, number, sha256(h || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM t GROUP BY conv_id, number, h""",
    "ttl_active_sessions": "SELECT user_id, max(ts) AS updated FROM events GROUP BY 1 HAVING (SELECT max(ts) FROM events) - max(ts) <= INTERVAL 1 DAY",
    "retention_by_day": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 7 FROM events) GROUP BY 1",
    "transcript": "SELECT conv_id, count(*) AS n, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY 1",
    "history_last_k": "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6",
    "section_carry_forward": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN substr(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'Introduction') AS section FROM conversations",
    "idle_sessions": """WITH e AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ms FROM events), o AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 86400000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY session ORDER BY ms)),
        p AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ms) AS part FROM o) SELECT session, make_timestamp(min(ms) * 1000) AS first, make_timestamp(max(ms) * 1000) AS updated, count(*) AS events FROM p GROUP BY session, part""",
    "step_medians": """WITH e AS (SELECT conv_id, role, sum(length(text) / CAST(64 AS DOUBLE)) AS s, count(*) FILTER (role = 'assistant') AS c FROM conversations WHERE conv_id % 9 <> 0 GROUP BY 1, 2)
        SELECT role AS node, count(*) AS turns, round(median(s), 6) AS seconds, round(avg(c), 6) AS calls FROM e GROUP BY 1""",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "dedup_union_first": "SELECT digest, CAST(min(src * 1000000000000 + id) // 1000000000000 AS INTEGER) AS src, CAST(min(src * 1000000000000 + id) % 1000000000000 AS BIGINT) AS id FROM (SELECT 0 AS src, item_id AS id, sha256(text) AS digest FROM benchmark UNION ALL SELECT 1, doc_id, sha256(text) FROM documents) GROUP BY 1",
}
