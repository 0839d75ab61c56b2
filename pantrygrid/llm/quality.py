"""Quality classifier without hand-made labels: a weak-label model over heuristic labellers, then a hashed linear scorer.

Every labeller votes 0 (poor), 1 (good) or abstains. Expectation-maximisation over the votes of all documents estimates
each labeller's accuracy and the share of good documents (labellers are taken as independent, given the class). It needs
only how often each pattern of votes occurs, and there are at most 3 ** labellers patterns, whatever the input. The
posterior of a document's pattern is its soft label; soft labels of a bounded sample train a linear model on hashed byte
n-grams. That scorer's own score decides on every document: it is rejected where the score is below the threshold. Votes
and posteriors only train.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import features, shared

#: Rows of the sample that trains the scorer, and the score from which a document is accepted: it goes where the scorer is fairly sure.
SAMPLE_ROWS, THRESHOLD = 4000, 0.3
#: Times by which a vote of poor is likelier under the poor class, at least.
BETTER = 100.0
#: Labeller, its statistic, votes poor above, votes good up to (None: it never votes good).
LABELLERS = [
    ("marks", "share of bytes that are neither letters, digits, white space nor common punctuation", 0.03, None),
    ("mark ends", "share of words that end in such a byte", 0.2, None),
    ("shouting", "share of capitals among ASCII letters, from 6 words on", 0.5, None),
    ("exclaims", "exclamation marks for each word", 0.3, None),
    ("bars", "vertical bars for each word", 0.1, None),
    ("bare signs", "share of words without a letter or digit", 0.2, None),
    ("stutter", "share of words equal to the word before, from 10 words on", 0.2, None),
    ("variety", "1 - distinct words / least of words and twice their root, from 21 words on", 0.5, None),
    ("digits", "share of digits among bytes", 0.5, None),
    ("plain words", "share of words that are not letters with at most one sign at the end", 0.4, 0.15),
    ("flow", "words for each sentence end, from 41 words on", 150.0, 45.0),
    ("pace", "stutter and exclamation marks together", 0.3, 0.06),
]
_MARK, _UPPER, _LETTER, _DIGIT, _WHITE, _END = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_END[[ord(c) for c in ".?!"]] = True
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_BAR = np.zeros(256, bool)
_BAR[ord("|")] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-/|"]] = False


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by labellers: what LABELLERS say of each text of a buffer. Empty texts have zeros."""
    sums = lambda v: features.row_sums(v, offsets)
    size = np.maximum(np.diff(offsets), 1)
    white = _WHITE[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(~white & (edge | np.append(True, white[:-1]))) if len(data) else np.empty(0, np.int64)
    stop_mark = np.append((white | edge)[1:], True) & ~white if len(data) else np.empty(0, bool)
    stop = np.flatnonzero(stop_mark) + 1
    lower = shared.lower_ascii(data)
    word = shared.span_hashes(shared.prefix_hashes(lower), start, stop)
    row = np.searchsorted(offsets, start, side="right") - 1
    n_rows = len(offsets) - 1
    words = np.maximum(np.bincount(row, minlength=n_rows), 1)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((word, row))
    first = np.append(True, (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])) if len(word) else np.empty(0, bool)
    distinct = np.bincount(row[order][first], minlength=n_rows)
    signs = _MARK | _BAR
    sign_sum = np.append(0, np.cumsum(~(_LETTER | _DIGIT | (np.arange(256) > 127))[data]))
    bare = (sign_sum[stop] - sign_sum[start]) == stop - start
    body = np.maximum(stop - 1, start)  # a sign at the end is common
    plain = ((sign_sum[body] - sign_sum[start]) == 0) & ~signs[data[np.maximum(stop, 1) - 1]] if len(data) else np.empty(0, bool)
    by_row = lambda v: np.bincount(row, weights=v, minlength=n_rows) / words
    stutter, exclaims = by_row(same) * (words >= 10), sums(data == ord("!")) / words
    return np.stack(
        [
            sums(_MARK[data]) / size,
            by_row(_MARK[data[stop - 1]]) if len(start) else np.zeros(n_rows),
            sums(_UPPER[data]) / np.maximum(sums(_LETTER[data]), 1) * (words > 5),
            exclaims,
            sums(data == ord("|")) / words,
            by_row(bare) * (words >= 10),
            stutter,
            np.where(words > 20, 1 - distinct / np.minimum(np.sqrt(words) * 2, words), 0.0),
            sums(_DIGIT[data]) / size,
            by_row(~plain) * (words >= 10),
            words / np.maximum(sums(_END[data]), 1) * (words > 40),
            stutter + exclaims,
        ],
        axis=1,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """Each text's votes as one number in base 3: 0 poor, 1 good, 2 abstains."""
    code = np.zeros(len(stats), np.int64)
    for k, (_, _, poor, good) in enumerate(LABELLERS):
        code = code * 3 + np.where(stats[:, k] > poor, 0, 2 if good is None else np.where(stats[:, k] <= good, 1, 2))
    return code


def _vote_table(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)


def fit_labellers(code: np.ndarray, count: np.ndarray, steps: int = 100) -> tuple[np.ndarray, float]:
    """EM over vote patterns and their counts: each labeller's chances of voting poor, good and not at all under either class, and the share of good documents.

    A pattern starts as poor if any labeller says so. A labeller is better than chance: it votes poor at least BETTER
    times as often under the poor class as under the good one. Without that, a kind of poor document that few labellers
    see would drift into the good class. Votes have small priors; no documents leave those and a share of 0.5.
    """
    table, n = _vote_table(code), count.astype(float)
    says = np.stack([table == v for v in (0, 1, 2)], axis=2).astype(float)  # patterns, labellers, votes
    good = np.where((table == 0).any(axis=1), 0.05, 0.95)
    extra = np.array([[3.0, 3.0, 3.0], [0.1, 4.0, 4.0]])
    chances, share = np.tile(extra / extra.sum(axis=1, keepdims=True), (len(LABELLERS), 1, 1)), 0.5
    for _ in range(steps if len(n) else 0):
        for cls, weight in enumerate((n * (1 - good), n * good)):
            chances[:, cls] = np.einsum("p,plv->lv", weight, says) + extra[cls]
        chances /= chances.sum(axis=2, keepdims=True)
        chances[:, 1, 0] = np.minimum(chances[:, 1, 0], chances[:, 0, 0] / BETTER)
        chances /= chances.sum(axis=2, keepdims=True)
        share = (float(n @ good) + 1) / (n.sum() + 2)
        good = posteriors(code, chances, share)
    return chances, share


def posteriors(code: np.ndarray, chances: np.ndarray, share: float) -> np.ndarray:
    """The chance that a document with these votes is good."""
    table, logs = _vote_table(code), np.log(chances)
    score = np.log(share / (1 - share)) + sum(logs[k, 1, table[:, k]] - logs[k, 0, table[:, k]] for k in range(len(LABELLERS)))
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; its size does not depend on the input."""

    chances: np.ndarray
    share: float
    weights: np.ndarray
    threshold: float = THRESHOLD

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts by the linear scorer; 0.5 for an empty text."""
        z = features.linear_scores(data, offsets, self.weights)
        line = np.clip(z[:, 1] - z[:, 0], -30, 30) if z.shape[1] == 2 else np.zeros(len(z))
        return 1 / (1 + np.exp(-line))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> QualityModel:
    """Accuracies from the votes of all documents; the scorer from a sample of about sample_rows of them."""
    shared.small_batches(docs.sparkSession)

    def vote(batches):
        for b in batches:
            data, at = shared.buffers(b.column(1))
            code = np.concatenate([votes(statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])) for i, j in shared.slices(at)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(code)], names=["code"])

    own = shared.texts(docs, id_col, text_col)
    counted = own.mapInArrow(vote, "code long").groupBy("code").count().toArrow()  # 3 ** labellers rows at most
    chances, share = fit_labellers(np.asarray(counted["code"]), np.asarray(counted["count"]))

    def label(texts: pd.Series) -> pd.Series:
        data, at = shared.buffers(pa.array(texts, pa.string()))
        good = posteriors(votes(statistics(data, at)), chances, share)
        return pd.Series([[1 - g, g] for g in good])

    sample = features.bounded_sample(own, F.xxhash64("id", "text"), sample_rows)
    x, y, which = features.sample_features(sample.withColumn("y", F.pandas_udf(label, "array<double>")("text")))
    return QualityModel(chances, share, features.fit_softmax(x, y.reshape(-1, 2), which), threshold)


def scored(text: Column, model: QualityModel) -> Column:
    """The score of a text column."""

    def run(texts: pd.Series) -> pd.Series:
        data, at = shared.buffers(pa.array(texts, pa.string()))
        return pd.Series(np.concatenate([model.score(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in shared.slices(at)] or [np.empty(0)]))

    return F.pandas_udf(run, "double")(F.coalesce(text.cast("string"), F.lit("")))


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of docs: id_col, score (0 to 1), accepted.

    Null texts are empty texts; the scorer knows nothing against an empty text, so it is accepted. A null id stays null;
    repeated rows each give a row with the same score; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, id_col, text_col, sample_rows, threshold)
    got = docs.select(F.col(id_col).cast("long").alias(id_col), scored(F.col(text_col), model).alias("score"))
    return got.select(id_col, "score", (F.col("score") >= threshold).alias("accepted"))


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    model = fit(docs, id_col, text_col, **how)
    return docs.where(scored(F.col(text_col), model) >= model.threshold)
