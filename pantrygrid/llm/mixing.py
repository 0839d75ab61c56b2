"""Mixing sources to target weights by soft membership.

A classifier, fitted on a bounded sample of a labelled table, gives every document a distribution over domains. Then
every document gets a rate, how often it is to be seen in training, so that the expected tokens of each domain (over
documents: rate x tokens x chance of the domain) match its target. Of the rates that do and are not below the least one,
these are the nearest to one, weighed by tokens. Such a rate is one plus the product of the document's distribution with
a vector of one number for each domain, or the least rate if that is larger. Newton steps find the vector, each scaled
by the moments of the documents above the least rate: a pass over a narrow table sums expected tokens and moments for
several lengths of the step at once, and only those sums reach the driver. Steps go on until the targets are met. Where
no rates meet them, the squared gap plus a weight on the rates' distance from one is least, for the last weight that
still halved the gap, so that rates do not grow without an end; the gap is reported.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import features, shared

#: Rows of the sample that trains the classifier, and the relative error of the tokens at which steps end.
SAMPLE_ROWS, TOLERANCE = 3000, 1e-7
#: Weights on the rates' distance from one, each solved from the last, as far as it takes to meet the targets; a solve of more steps has stalled.
RIDGES, STALLED = (1e-3, 1e-6, 1e-9, 1e-12), 100
#: Lengths of a step that a pass tries.
LENGTHS = 2.0 ** np.arange(3, -9, -1)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words (runs without ASCII white space) of each text of a buffer."""
    white = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = ~white & (edge | np.append(True, white[:-1])) if len(data) else np.empty(0, bool)
    return features.row_sums(starts, offsets).astype(np.int64)


@dataclass(frozen=True)
class Mixer:
    """Classifier, targets and what the rates follow from; its size does not depend on the input.

    targets, and the gap that the rates leave to them, are in shares of the tokens that the input has.
    """

    domains: tuple[str, ...]
    targets: np.ndarray
    weights: np.ndarray
    prior: np.ndarray
    least: float = 0.0
    pull: np.ndarray | None = None
    gap: np.ndarray | None = None

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by domains; the prior for an empty text."""
        z = features.linear_scores(data, offsets, self.weights)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return np.where((np.diff(offsets) == 0)[:, None], self.prior, p)

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, max(1.0, self.least) + p @ self.pull)


def _passed(narrow: DataFrame, least: float, pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of pulls, sums over documents: the function whose gradient expected tokens are, these tokens, and the moments of the documents above the least rate. Each partition sends a bounded number of rows."""
    k, n = pulls.shape
    width = 1 + n + n * n

    def run(batches):
        total = np.zeros((k, width))
        for b in batches:
            p, tokens = np.asarray(b.column(1).flatten()).reshape(-1, n), np.asarray(b.column(0), float)[:, None]
            free = max(1.0, least) + p @ pulls.T
            rate = np.maximum(least, free)
            total[:, 0] += (tokens * rate * (free - rate / 2)).sum(0)
            total[:, 1 : n + 1] += (tokens * rate).T @ p
            total[:, n + 1 :] += (tokens * (free > least)).T @ (p[:, :, None] * p[:, None, :]).reshape(-1, n * n)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["cell", "v"])

    got = narrow.select("tokens", "p").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(k * width)
    out[np.asarray(got["cell"], int)] = np.asarray(got["v"], float)
    out = out.reshape(k, width)
    return out[:, 0], out[:, 1 : n + 1], out[:, n + 1 :].reshape(k, n, n)


def _solved(passed, share: np.ndarray, total: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pull, targets, gap. passed: as _passed over pulls, in shares of the input's tokens. Without a total, the one with the least change of rates.

    Without a total the tokens may lie anywhere along share, so only directions across it are solved.
    """
    n = len(share)
    axes = np.linalg.svd(share[None])[2][1:].T if total is None else np.eye(n)
    aim = share * (total or 0.0)

    def look(points: np.ndarray, ridge: float):
        value, tokens, moments = passed(points @ axes.T)
        slope = (tokens - aim) @ axes + ridge * points
        return value - points @ (aim @ axes) + ridge / 2 * (points**2).sum(1), slope, axes.T @ moments @ axes + ridge * np.eye(axes.shape[1]), tokens

    def gap_of(tokens: np.ndarray):
        goal = share * (share @ tokens / (share @ share)) if total is None else aim
        return goal, tokens - goal, TOLERANCE * max(goal.max(), 1e-9)

    def newton(point: np.ndarray, ridge: float):
        value, slope, bend, tokens = (x[0] for x in look(point[None], ridge))
        for _ in range(STALLED):
            if np.abs(slope).max(initial=0.0) <= gap_of(tokens)[2] / 4:
                return point, tokens
            step, lengths = np.linalg.solve(bend, -slope), LENGTHS
            while True:
                values, slopes, bends, many = look(point + lengths[:, None] * step, ridge)
                best = int(values.argmin())
                plain = int(np.abs(lengths - 1).argmin())
                if np.abs(slopes[plain]).max() <= np.abs(slope).max() / 10:  # near the end values differ by rounding only
                    best = plain
                elif values[best] >= value:
                    lengths = lengths * LENGTHS[-1] / 2 / LENGTHS[0]
                    if lengths[0] < 1e-12:
                        return None
                    continue
                break
            point, value, slope, bend, tokens = point + lengths[best] * step, values[best], slopes[best], bends[best], many[best]
        return None

    point, tokens, least_gap = np.zeros(axes.shape[1]), None, np.inf
    for ridge in RIDGES:
        found = newton(point, ridge)
        if found is None or np.abs(gap_of(found[1])[1]).max() > least_gap / 2:  # rates that no longer help only grow
            break
        point, tokens = found
        goal, gap, enough = gap_of(tokens)
        least_gap = np.abs(gap).max()
        if least_gap <= enough:
            return axes @ point, goal, gap
    if tokens is None:
        raise RuntimeError("the rates of the mix did not converge")
    warnings.warn(f"no rates meet the mix's targets {goal.tolist()}: tokens differ by {gap.tolist()} (shares of the input's)", stacklevel=2)
    return axes @ point, goal, gap


def narrow_table(docs: DataFrame, mixer: Mixer, id_col: str, text_col: str) -> DataFrame:
    """id, tokens, p (the distribution over domains) of every row of docs."""

    def run(batches):
        for b in batches:
            data, at = shared.buffers(b.column(1))
            p = np.concatenate([mixer.posteriors(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in shared.slices(at)] or [np.empty((0, len(mixer.domains)))])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(word_counts(data, at)), flat], names=["id", "tokens", "p"])

    return shared.texts(docs, id_col, text_col).mapInArrow(run, "id long, tokens long, p array<double>")


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", least: float = 0.0, total_tokens: float | None = None, never_less: bool = False) -> tuple[Mixer, DataFrame]:
    """The mixer, and the narrow table that its steps ran over.

    targets: weights of the domains (scaled to sum to one). total_tokens: expected tokens of the whole mix; unset, as
    many as docs has. least: the least rate. With never_less, the least rate is one (documents repeat, and none goes, so
    that no domain has fewer expected tokens than it has now), and the total is as large as it takes to meet the weights.
    Where no rates meet the targets, a warning has the gap that is left, and so has the mixer.
    """
    shared.small_batches(docs.sparkSession)
    domains = tuple(sorted(targets))
    share = np.array([float(targets[d]) for d in domains])
    share /= share.sum()
    known = labelled.where(F.col(domain_col).isin(*domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(domain_col).alias("domain"))
    few = features.bounded_sample(known, "id", SAMPLE_ROWS)
    y = F.array(*[(F.col("domain") == d).cast("double") for d in domains])
    sample = shared.texts(docs, id_col, text_col).join(F.broadcast(few), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))  # SAMPLE_ROWS rows, but for the spread of the hash
    x, target, which = features.sample_features(sample.select("text", y.alias("y")))
    target = target.reshape(-1, len(domains))
    prior = (target.sum(axis=0) + 1) / (len(target) + len(domains))
    mixer = Mixer(domains, share, features.fit_softmax(x, target, which), prior, max(1.0, least) if never_less else least)
    narrow = shared.written(narrow_table(docs, mixer, id_col, text_col))
    have = float(_passed(narrow, 0.0, np.zeros((1, len(domains))))[1].sum())
    whole = max(have, 1.0)
    total = None if never_less else (total_tokens or have) / whole
    pull, aim, gap = _solved(lambda pulls: tuple(x / whole for x in _passed(narrow, mixer.least, pulls)), share, total)
    mixer = replace(mixer, targets=aim, pull=pull, gap=gap)
    return mixer, narrow


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", **how) -> DataFrame:
    """One row for every row of docs: id_col, n_tokens (words), posteriors (of the domains in alphabetical order), rate, copies.

    copies is the rate rounded down, plus one with the chance of its fraction, drawn from a hash of the id. Null texts
    are empty: no tokens, the domains' shares among the labelled rows as posteriors. A null id stays null (its draw is
    that of -1); repeated rows each give a row. An empty table gives an empty result; without labelled rows every
    document has equal posteriors. An id with several labels has the first in alphabetical order, and one with several texts is learnt by the
    least of them; labels outside the
    targets, and null ones, are not used. Other columns are not read.
    """
    mixer, narrow = fit(docs, labelled, targets, id_col, text_col, domain_col, **how)

    def rates(p: pd.Series) -> pd.Series:
        return pd.Series(mixer.rates(np.stack(p.to_numpy()))) if len(p) else pd.Series([], dtype=float)

    out = narrow.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), F.col("p").alias("posteriors"), F.pandas_udf(rates, "double")("p").alias("rate"))
    return out.withColumn("copies", _copies(F.col("rate"), F.col(id_col)))


def _copies(rate: Column, key: Column) -> Column:
    draw = F.pmod(F.xxhash64(F.coalesce(key.cast("long"), F.lit(-1)), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("long")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", **how) -> DataFrame:
    """The rows of docs, with all their columns, each as often as its rate says (rounded as in mix)."""
    mixer, _ = fit(docs, labelled, targets, id_col, text_col, domain_col, **how)

    def rates(texts: pd.Series) -> pd.Series:
        data, at = shared.buffers(pa.array(texts, pa.string()))
        got = [mixer.rates(mixer.posteriors(data[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in shared.slices(at)]
        return pd.Series(np.concatenate(got or [np.empty(0)]))

    own = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(own))])
    at = {c: f"c{i}" for i, c in enumerate(own)}
    rate = F.pandas_udf(rates, "double")(F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")))
    copies = renamed.withColumn("rate", rate).withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(1) + _copies(F.col("rate"), F.col(at[id_col]))))).where("times > 1")
    return copies.drop("rate", "times").toDF(*own)
