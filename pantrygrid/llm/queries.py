"""The queries of this folder and the SQL that DuckDB checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrygrid.llm import exact_dedup, hard_negatives, html_text, mixing, ngram_join, periodic_runs, quality, repeats, tokens, top_inner, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_repeats(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_inner.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_classifier(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Target weights of the languages' tokens.
MIX = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    return docs.select("doc_id", docs["lang"].alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), MIX)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of documents, where a tenth of them, by crc32 of the id, is made periodic from some word on; a null id is not."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", periodic_runs.words_of(F.col("text")).alias("plain"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("n", F.size("plain")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    words = F.expr("if(h % 10 = 0 AND n > 0, transform(plain, (w, i) -> if(i < a, w, plain[int(a + (i - a) % p)])), plain)")
    found = periodic_runs.periodic_runs(docs.select("doc_id", words.alias("words")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; labels of every seventh vec_id are moved on by one first."""
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.hard_negatives(rows.where("vec_id % 100 = 0"), rows)


#: The rules of hosts and paths.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def _url_sql() -> str:
    """The whole filter in SQL: parts and rules, then one step for each level of the tree."""
    depth = url_filter.DEPTH
    levels = ", ".join(f"t{k}" for k in range(1, depth + 1))
    cut = ", ".join(f"regexp_replace(coalesce(s[{k}], ''), '[0-9]+', '#', 'g')" + (f" || CASE WHEN len(s) > {depth} THEN '/**' ELSE '' END" if k == depth else "") + f" AS t{k}" for k in range(1, depth + 1))
    differs = lambda a, of: f"(b.{of} > 0 AND b.last_{of} > 0 AND abs(b.{a} / b.{of} - b.last_{a} / b.last_{of}) > {url_filter.BOUND!r} * (1.0 / sqrt(b.{of}) + 1.0 / sqrt(b.last_{of})))"
    steps = []
    for k in range(1, depth + 1):
        ends, digits = (f"sum(CASE WHEN t{k + 1} = '' THEN n ELSE 0 END)", f"sum(CASE WHEN contains(t{k + 1}, '#') THEN n ELSE 0 END)") if k < depth else ("0", "0")
        steps.append(f"""
            lit{k} AS (SELECT host, template, t{k} FROM (SELECT *, sum(own) OVER (PARTITION BY host, template) AS whole FROM (SELECT host, template, t{k}, sum(n) AS own FROM s{k - 1} GROUP BY host, template, t{k})) WHERE t{k} <> '' AND own * 16 >= whole),
            tok{k} AS (SELECT s.*, CASE WHEN s.t{k} = '' THEN '' WHEN l.host IS NOT NULL THEN s.t{k} ELSE '*' END AS token
                       FROM s{k - 1} s LEFT JOIN lit{k} l ON s.host = l.host AND s.template = l.template AND s.t{k} = l.t{k}),
            br{k} AS (SELECT *, (blocked + 4.0::DOUBLE * (SELECT share FROM common)) / (labelled + 4.0::DOUBLE) AS share
                      FROM (SELECT host, template, token, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(labelled) AS DOUBLE) AS labelled, CAST(sum(blocked) AS DOUBLE) AS blocked, CAST({ends} AS DOUBLE) AS ends, CAST({digits} AS DOUBLE) AS digits
                            FROM tok{k} WHERE token <> '' GROUP BY ALL)),
            lag{k} AS (SELECT *, lag(n) OVER w AS last_n, lag(labelled) OVER w AS last_labelled, lag(blocked) OVER w AS last_blocked, lag(ends) OVER w AS last_ends, lag(digits) OVER w AS last_digits
                       FROM br{k} WINDOW w AS (PARTITION BY host, template ORDER BY share, token)),
            grp{k} AS (SELECT host, template, token, sum(CASE WHEN b.last_n IS NOT NULL AND ({differs("blocked", "labelled")} OR {differs("ends", "n")} OR {differs("digits", "n")}) THEN 1 ELSE 0 END)
                              OVER (PARTITION BY host, template ORDER BY share, token) AS merged FROM lag{k} b),
            nam{k} AS (SELECT host, template, merged, string_agg(token, '|' ORDER BY token) AS name FROM grp{k} GROUP BY ALL),
            s{k} AS (SELECT t.host, t.template || CASE WHEN t.token = '' THEN '' ELSE '/' || m.name END AS template, {levels}, n, labelled, blocked
                     FROM tok{k} t LEFT JOIN grp{k} g ON t.host = g.host AND t.template = g.template AND t.token = g.token LEFT JOIN nam{k} m ON g.host = m.host AND g.template = m.template AND g.merged = m.merged),""")
    rules = "\n".join(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule}'" for host, path, rule in (("www.example.com", "/en/", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("net", "/es/", "net/es/"), ("net", "/fr/", "net/fr/"), ("com", "/", "com/")))
    return f"""
        WITH parts AS (SELECT page_id, {_LOWER.replace("coalesce(text, '')", "coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        ruled AS (SELECT *, CASE {rules} END AS rule FROM parts),
        judged AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM ruled),
        cut AS (SELECT page_id, host, path, rule, said, {cut} FROM judged),
        s0 AS (SELECT host, '' AS template, {levels}, count(*) AS n, count(said) AS labelled, count(*) FILTER (said = 'block') AS blocked FROM cut GROUP BY ALL),
        common AS (SELECT CASE WHEN sum(labelled) > 0 THEN CAST(sum(blocked) AS DOUBLE) / CAST(sum(labelled) AS DOUBLE) ELSE 0.5::DOUBLE END AS share FROM s0),
        {"".join(steps)}
        rejected AS (SELECT host, template FROM s{depth} GROUP BY ALL HAVING (CAST(sum(blocked) AS DOUBLE) + 4.0::DOUBLE * (SELECT share FROM common)) / (CAST(sum(labelled) AS DOUBLE) + 4.0::DOUBLE) >= 0.9::DOUBLE),
        gone AS (SELECT DISTINCT s.host, {levels} FROM s{depth} s JOIN rejected r ON s.host = r.host AND s.template = r.template)
        SELECT page_id, c.host, path, rule, coalesce(said, CASE WHEN g.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM cut c LEFT JOIN gone g ON c.host = g.host AND {" AND ".join(f"c.t{k} = g.t{k}" for k in range(1, depth + 1))}"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_repeats, op2_html_text, op3_token_counts, op4_top_inner, op5_exact_dedup, op6_ngram_join, op7_toxicity, op8_quality_classifier, op9_byte_bpe, op10_mixing, op11_periodic_runs, op12_hard_negatives, op13_url_filter)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op13_url_filter": _url_sql(),
        "op4_top_inner": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
        "op12_hard_negatives": """
            WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                              list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS own, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
                  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
            p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE own),
            n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
                  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.r <= 5 AND NOT s.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
        "op5_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g ON d.t = g.t""",
    }
