"""Lexical and vector search, rank fusion and the measures of rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid import functions as fn
from pantrygrid.sources import shared_checkpoints, sized_batches

K1, B, RRF = 1.5, 0.75, 60
#: Parts that blocks of vectors are dealt to at least, and vectors of a part, about.
DEALT, PART = 16, 1 << 13
#: Tokens of queries that go to all tasks, at most.
ASKED = 1 << 20


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, token, tf."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(fn.tokens(F.col(text_col))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("tf"))


def idf(posts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token, df, idf; n_docs: one row with n."""
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs), how="cross").select("token", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents (doc_id, text) for each query (item_id, text) with a score above 0; ties to the smaller id.

    Documents are read and cut to tokens once: the postings of the queries' tokens, with a row for each document's length,
    are checkpointed in the shared folder that the session names; other postings never move. A token that a query repeats
    counts each time; rows that share an id are one document. Queries go to all tasks up to ASKED of their tokens.
    """
    shared_checkpoints(docs.sparkSession)
    asked = queries.select("item_id", F.explode(fn.tokens(F.col("text"))).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times")).checkpoint()
    sent = F.broadcast if asked.count() <= ASKED else lambda df: df
    own = docs.select(F.col("doc_id").alias("doc"), fn.tokens(F.col("text")).alias("tokens")).select("doc", F.posexplode(F.concat(F.array(F.concat(F.lit("="), F.size("tokens"))), "tokens")).alias("pos", "token"))
    size = F.when(F.col("pos") == 0, F.substring("token", 2, 10).cast("long"))
    rows = own.select("doc", size.alias("dl"), F.when(F.col("pos") > 0, F.col("token")).otherwise("").alias("token"))  # no token is empty
    wanted = asked.select("token").union(docs.sparkSession.createDataFrame([("",)], "token string")).distinct()
    kept = rows.join(sent(wanted), "token", "left_semi").repartition("doc").groupBy("doc", "token").agg(F.count("*").alias("tf"), F.sum("dl").alias("dl"))
    posts = kept.withColumn("dl", F.max("dl").over(Window.partitionBy("doc"))).checkpoint()
    stats = posts.where("token = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"))  # one row
    weights = asked.join(idf(posts.where("token <> ''"), stats), "token").join(F.broadcast(stats.select("avgdl")), how="cross").select("item_id", "token", "avgdl", (F.col("idf") * F.col("times")).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = posts.where("doc is not null").join(sent(weights), "token").groupBy("item_id", "doc").agg(F.sum(part).alias("s")).where("s > 0")
    best = Window.partitionBy("item_id").orderBy(F.round("s", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("item_id").alias("query_id"), "rank", F.col("doc").alias("doc_id"), F.round("s", 6).alias("score"))


def _closest(w: np.ndarray, v: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors v the k nearest to each of w, as positions in w, positions in v and how near; ties at 9 digits to the smaller id.

    Distances are sums of differences, not of norms: equal vectors must have a distance of exactly 0. One matrix product
    with its margin of error tells which pairs may be among the first; only theirs are summed.
    """
    n, a, b = min(k, len(ids)), (w * w).sum(1), (v * v).sum(1)
    if np.isfinite(a).all() and np.isfinite(b).all():
        near = w @ v.T
        if by == "l2":
            near -= b / 2
        margin = 1e-9 + 32 * w.shape[1] * np.finfo(float).eps * (a + b.max())
        near[asked[:, None] == ids] = -np.inf
        qi, vi = np.nonzero((near >= (np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n] - margin)[:, None]) & (near > -np.inf))
        near = near[qi, vi] if by == "dot" else -((v[vi] - w[qi]) ** 2).sum(1)
    else:
        whole = w @ v.T if by == "dot" else -np.stack([((v - one) ** 2).sum(1) for one in w])
        whole[asked[:, None] == ids] = -np.inf
        qi, vi = np.nonzero(np.isfinite(whole))
        near = whole[qi, vi]
    order = np.lexsort((ids[vi], -np.round(near, 9), qi))
    qi, vi, near = qi[order], vi[order], near[order]
    first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[first], vi[first], near[first]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, by: str = "l2", same: str | None = None, rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors: least squared distance ("l2") or largest product ("dot"); a query never finds itself.

    same: a column (a whole number) that both must share; blocks hold one value of it, and only blocks of one value meet.
    Rows are packed into blocks where they lie. Blocks of the stated queries meet blocks of vectors as matrices; a pair of
    blocks hands on k rows for each query. Blocks of both are dealt by hash to parts of about PART rows (of vectors, to
    DEALT parts at least), and each part of queries meets each part of vectors, so that what a task reads does not grow.
    """
    sized_batches(vectors.sparkSession)
    kind = "f4" if {df.schema["embedding"].dataType.elementType.typeName() for df in (queries, vectors)} == {"float"} else "f8"  # what moves is no wider than the columns
    value = F.col(same).cast("long") if same else F.lit(0).cast("long")

    def packed(df: DataFrame, size: int, ids: str, x: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                for v, part in pdf.groupby("value"):
                    for i in range(0, len(part), size):
                        own = part.iloc[i : i + size]
                        yield pd.DataFrame({"value": [v], ids: [own["vec_id"].to_numpy(np.int64).tobytes()], x: [np.stack(own["embedding"].to_numpy()).astype(kind).tobytes()]})

        return df.select("vec_id", "embedding", value.alias("value")).where("value is not null").mapInPandas(run, f"value long, {ids} binary, {x} binary")

    def run(batches):
        for pdf in batches:
            for q_ids, q, c_ids, c in zip(pdf["q_ids"], pdf["q"], pdf["c_ids"], pdf["c"]):
                asked, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                w, v = np.frombuffer(q, kind).reshape(len(asked), -1).astype(float), np.frombuffer(c, kind).reshape(len(ids), -1).astype(float)
                qi, vi, near = _closest(w, v, asked, ids, k, by)
                yield pd.DataFrame({"query_id": asked[qi], "vec_id": ids[vi], "s": near})

    n_asked, n = queries.count() // PART + 1, max(DEALT, vectors.count() // PART + 1)
    dealt = lambda ids, parts: F.pmod(F.xxhash64(ids), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked_blocks = packed(queries, 256, "q_ids", "q").withColumn("part", each(n)).withColumn("asked", dealt("q_ids", n_asked))
    blocks = packed(vectors, rows, "c_ids", "c").withColumn("part", dealt("c_ids", n)).withColumn("asked", each(n_asked))
    pairs = asked_blocks.join(blocks, ["value", "part", "asked"])  # blocks of stated queries with blocks of all rows
    found = pairs.select("q_ids", "q", "c_ids", "c").mapInPandas(run, "query_id long, vec_id long, s double")
    best = Window.partitionBy("query_id").orderBy(F.round("s", 9).desc(), "vec_id")
    score = F.col("s") if by == "dot" else -F.col("s")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round(score, 6).alias("score"))


def fuse(rankings: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Weighted reciprocal rank fusion of rankings (query_id, rank, doc_id): query_id, rank, doc_id, score."""
    parts = [r.select("query_id", "doc_id", (F.lit(float(w)) / (RRF + F.col("rank"))).alias("part")) for r, w in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    scored = whole.groupBy("query_id", "doc_id").agg(F.sum("part").alias("s"))
    best = Window.partitionBy("query_id").orderBy(F.round("s", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("s", 6).alias("score"))


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, weight: float = 1.0) -> DataFrame:
    """query_id, rank, doc_id, score, distance of a dense and a lexical ranking (query_id, rank, doc_id, score), fused: the distance of the dense hit, else 1 / (1 + score) of the lexical one."""
    far = dense.select("query_id", "doc_id", F.col("score").alias("far"))
    said = lexical.select("query_id", "doc_id", F.col("score").alias("said"))
    met = fuse([(dense, 1.0), (lexical, weight)], k).join(far, ["query_id", "doc_id"], "left").join(said, ["query_id", "doc_id"], "left")
    return met.select("query_id", "rank", "doc_id", "score", F.round(F.coalesce("far", 1 / (1 + F.col("said"))), 6).alias("distance"))


def interval(mean: Column, spread: Column, n: Column, z: float) -> Column:
    """low and high of a mean of values from 0 to 1: the normal interval, cut at 0 and 1; null for fewer than two values."""
    half = F.lit(z) * spread / F.sqrt(n)
    cut = lambda x: F.when(n > 1, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.struct(cut(mean - half).alias("low"), cut(mean + half).alias("high"))


def ranking_measures(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Measures of each query of relevant (query_id, total): hits at ranks (query_id, rank, rel). A query without a ranking has nulls."""
    run = Window.partitionBy("query_id").orderBy("rank")
    seen = ranked.withColumn("hits", F.sum("rel").over(run))
    got = seen.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("rel").alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least("n", "total"), F.lit(1)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    p, r = F.col("hit") / F.col("n"), F.when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise(0.0)
    out = relevant.join(got, "query_id", "left").select("query_id", "n", "total", "hit", "first", "ap", "dcg", p.alias("precision"), r.alias("recall"), ideal.alias("ideal"))
    six = lambda c: F.round(c, 6)
    have = F.col("n").isNotNull()
    return out.select(
        "query_id", six(F.col("precision")).alias("precision"), six(F.when(have, F.col("recall"))).alias("recall"),
        six(F.when(have, F.when(F.col("hit") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))).alias("f1"),
        six(F.when(have, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"), six(F.when(have, F.when(F.col("total") > 0, F.col("ap") / F.col("total")).otherwise(0.0))).alias("map"),
        six(F.when(have, F.when(F.col("total") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))).alias("ndcg"),
        six(F.when(have & (F.col("total") > 0), F.least("n", "total") / F.col("total"))).alias("ceiling"),
    )


def paired_bootstrap(pairs: DataFrame, resamples: int = 5000) -> DataFrame:
    """mean, low, high of the paired differences (id, a, b) by resampling; pairs with a null are left out.

    Draws come from a hash of id and resample, Poisson-weighted, so they do not depend on how rows are dealt. Each partition
    sums its pairs for each resample before the shuffle. A resample that draws no pair (few have any chance of it) has no mean.
    """
    known = pairs.where("a is not null and b is not null").select("id", (F.col("a") - F.col("b")).cast("double").alias("d"))
    u = F.pmod(F.xxhash64("id", "r"), F.lit(1 << 40)) / float(1 << 40)
    steps, total, p = [], 0.0, float(np.exp(-1))
    for k in range(10):
        total += p
        steps.append(total)
        p /= k + 1
    times = sum(((u > s).cast("int") for s in steps[1:]), (u > steps[0]).cast("int"))
    means = known.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", times).groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m"))
    return known.agg(F.avg("d").alias("mean")).join(means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")), how="cross")
