"""Runs next to each other: paired differences, noise, resampling, acceptance, rates of answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resamples, least members of a group that is resampled.
RESAMPLES, LEAST_GROUP = 5000, 5


def paired(base: DataFrame, variant: DataFrame) -> DataFrame:
    """id, a, b, delta of the ids (id, value) that both runs have with a value."""
    both = base.select("id", F.col("value").alias("a")).join(variant.select("id", F.col("value").alias("b")), "id")
    return both.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def dropped(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """n: rows of the base run that no pair has (one row)."""
    return base.join(pairs.select("id"), "id", "left_anti").agg(F.count("*").alias("n"))


def times(*key) -> Column:
    """How often a resample draws a row: Poisson with mean one, from a hash, so that it does not depend on how rows are dealt."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / float(1 << 40)
    steps, total, p = [], 0.0, float(np.exp(-1))
    for k in range(10):
        total += p
        steps.append(total)
        p /= k + 1
    return sum(((u > s).cast("int") for s in steps[1:]), (u > steps[0]).cast("int"))


def group_difference(deltas: DataFrame, resamples: int = RESAMPLES, least: int = LEAST_GROUP) -> DataFrame:
    """mean, low, high of the difference of means of two independent groups (id, treated: boolean, delta), each resampled alone; nulls where a group has under least members.

    Each partition sums its rows for each resample before the shuffle.
    """
    known = deltas.where("delta is not null").select("id", "treated", F.col("delta").cast("double").alias("d"))
    of = lambda side, value: F.when(F.col("treated") == side, value)
    drawn = known.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", times("id", "treated", "r"))
    mean = lambda side: F.try_divide(F.sum(of(side, F.col("w") * F.col("d"))), F.sum(of(side, F.col("w"))))
    means = drawn.groupBy("r").agg((mean(True) - mean(False)).alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    sizes = known.agg(F.count(of(True, F.lit(1))).alias("t"), F.count(of(False, F.lit(1))).alias("c"), (F.avg(of(True, F.col("d"))) - F.avg(of(False, F.col("d")))).alias("mean"))
    ok = (F.col("t") >= least) & (F.col("c") >= least)
    return sizes.join(means, how="cross").select(*[F.when(ok, F.col(c)).alias(c) for c in ("mean", "low", "high")])  # one row each


def verdict(low: Column, high: Column) -> Column:
    """Whether an interval leaves out 0."""
    return F.when((low > 0) | (high < 0), "significant").when(low.isNotNull() & high.isNotNull(), "within noise")


def accepted(low: Column, gain: Column, noise: Column) -> Column:
    """Whether a variant is taken: its interval is above 0 and its gain above the noise of the judge."""
    return F.coalesce((low > 0) & (gain > noise), F.lit(False))


def context_groups(base: DataFrame, variant: DataFrame) -> DataFrame:
    """id, same_order, same_set of the contexts (id, rank, chunk_id) of two runs: the same chunks in order, and in any order."""
    as_list = lambda df, name: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))
    both = as_list(base, "a").join(as_list(variant, "b"), "id")
    return both.select("id", (F.col("a") == F.col("b")).alias("same_order"), (F.array_sort("a") == F.array_sort("b")).alias("same_set"))


def answer_rates(answers: DataFrame) -> DataFrame:
    """mode, answered, refused_right, hard of answers (mode, in_scope, refused, hard): answered share of questions in scope, refused share of those out of it, answered share of the hard ones in scope."""
    share = lambda who, what: F.avg(F.when(who, what.cast("int")))
    inside = F.col("in_scope")
    return answers.groupBy("mode").agg(share(inside, ~F.col("refused")).alias("answered"), share(~inside, F.col("refused")).alias("refused_right"), share(inside & F.col("hard"), ~F.col("refused")).alias("hard"))


def judged_refusals(answers: DataFrame, judge: DataFrame) -> DataFrame:
    """id, refused, agree: a judge's verdict (id, verdict) where there is one, else the markers (id, marked); agree is null without a verdict."""
    return answers.join(judge, "id", "left").select("id", F.coalesce("verdict", "marked").alias("refused"), (F.col("verdict") == F.col("marked")).alias("agree"))


def at_index(values: Column, share: float) -> Column:
    """The value at the index share x n of sorted values, as a plain list is read; null for none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * F.lit(share)).cast("int"))


def best_deltas(pairs: DataFrame, n: int = 4) -> DataFrame:
    """The n pairs with the largest delta; ties to the smaller id."""
    return pairs.orderBy(F.desc("delta"), "id").limit(n)


def one_of_each(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """One row of each group, then n of them, both by a hash of seed and key."""
    draw = F.xxhash64(F.lit(seed), key)
    first = rows.withColumn("_d", draw).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_d", key))).where("_k = 1")
    return first.orderBy("_d", key).limit(n).drop("_d", "_k")


def topics_joined(found: DataFrame) -> DataFrame:
    """One row for each id of found rows (id, topic_no, topic, others): the row of the first topic, with all topics in order; rows without an id are left out."""
    rest = [c for c in found.columns if c not in ("id", "topic_no", "topic")]
    known = found.where("id is not null and id <> ''").groupBy("id").agg(F.min_by(F.struct(*rest), "topic_no").alias("f"), F.transform(F.array_sort(F.collect_set(F.struct("topic_no", "topic"))), lambda x: x["topic"]).alias("topics"))
    return known.select("id", "f.*", "topics")
