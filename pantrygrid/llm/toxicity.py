"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on ordinary text, one on the marks of toxic text (runs of byte n-grams
that a share of the toxic samples hold, and ordinary ones hardly ever). A-Z are lower-cased. A text is cut into
overlapping windows at word boundaries, each compressed twice: with the ordinary dictionary, and with the toxic one
before it. Both see the same ordinary part, so a window's two lengths differ by what the toxic dictionary explains
(dictionaries used quite apart tell less: a toxic one alone explains no ordinary word, which hides its marks). Four
figures of these differences over all windows of a text go through a logistic calibration, fitted on labelled rows that
trained no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Bounds of the training sample: labelled rows for either dictionary and for calibration. A longer text of a dictionary's sample gives pieces of PIECE_BYTES, so many, spread over all of it.
TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS, PIECES, PIECE_BYTES = 1500, 3000, 4000, 20, 1000
#: Marks: toxic samples that hold an n-gram, at least, as a share and as a number; times that it is likelier in a toxic sample than in an ordinary one.
MARK_SHARE, MARK_TEXTS, MARK_RATIO = 0.03, 3, 20.0
#: Bytes of either dictionary; least bytes of a window and of the way to the next; length of the n-grams.
TOXIC_BYTES, ORDINARY_BYTES, WINDOW, STEP, GRAM = 2048, 16 << 10, 48, 24, 6
THRESHOLD = 0.7


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows that cover the whole text, cut at spaces where there are any near enough."""
    out, n, i = [], len(text), 0
    while i < n:
        j = text.find(b" ", i + WINDOW, i + 4 * WINDOW)
        j = j if j >= 0 else min(n, i + 4 * WINDOW if n - i > 4 * WINDOW else n)
        out.append(text[i:j])
        if j >= n:
            break
        k = text.find(b" ", i + STEP, j)
        i = k if k >= 0 else i + STEP
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    if len(data) < GRAM:
        return np.empty(0, np.uint64)
    out = np.zeros(len(data) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | data[k : len(out) + k]
    return out


def lowered(text: str) -> bytes:
    return text.encode().translate(_LOWER)


def pieces(text: bytes) -> list[bytes]:
    """A short text whole; of a longer one PIECES pieces, spread over all of it."""
    if len(text) <= PIECES * PIECE_BYTES:
        return [text]
    return [text[i : i + PIECE_BYTES] for i in np.linspace(0, len(text) - PIECE_BYTES, PIECES).astype(int)]


def _counted(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts (in pieces), and how many texts hold each."""
    own = [np.unique(np.concatenate([_grams(np.frombuffer(p, np.uint8).astype(np.uint64)) for p in t])) for t in texts]
    return np.unique(np.concatenate(own or [np.empty(0, np.uint64)]), return_counts=True)


def toxic_marks(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The maximal runs, in the toxic texts, of n-grams that mark them; each run once for each text."""
    found, n = _counted(toxic)
    keep = n >= max(MARK_TEXTS, MARK_SHARE * len(toxic))
    found, n = found[keep], n[keep]
    have, m = _counted(ordinary)
    at = np.minimum(np.searchsorted(have, found), max(len(have) - 1, 0))
    plain = np.where(have[at] == found, m[at], 0) if len(have) else np.zeros(len(found))
    found = found[n / max(len(toxic), 1) >= MARK_RATIO * (plain + 0.5) / max(len(ordinary), 1)]
    out = []
    for text in toxic if len(found) else ():
        runs = set()
        for p in text:
            own = _grams(np.frombuffer(p, np.uint8).astype(np.uint64))
            marked = found[np.minimum(np.searchsorted(found, own), len(found) - 1)] == own
            edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
            runs |= {p[a : b + GRAM - 1] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))}
        out += sorted(runs)
    return out


def _trained(size: int, samples: list[bytes], d: int, k: int) -> bytes:
    """A dictionary of the samples; the samples themselves where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, d=d, k=k).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[-size:]


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and calibration; of fixed size."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -3.0)

    def compressors(self):
        import zstandard as z

        how = dict(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = lambda raw: z.ZstdCompressor(compression_params=z.ZstdCompressionParameters(**how), dict_data=z.ZstdCompressionDict(raw or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT))
        return made(self.ordinary), made(self.toxic + self.ordinary)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: mean difference, square root of the largest, mean of the three largest, share of windows with 3 bytes or more."""
        ordinary, both = self.compressors()
        out = np.zeros((len(texts), 4))
        for i, text in enumerate(texts):
            if text:
                d = np.sort([len(ordinary.compress(w)) - len(both.compress(w)) for w in windows(text)])[::-1]
                out[i] = d.mean(), np.sqrt(max(d[0], 0)), d[:3].mean(), (d >= 3).mean()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        w = np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:4] + w[4], -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps; without both classes, a score below the threshold for all."""
    if len(set(y.tolist())) < 2:
        return (0.0, 0.0, 0.0, 0.0, -3.0)
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, a.T @ (p - y) + 0.05 * w)
    return tuple(float(v) for v in w)


def held_out(id_column: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model from labelled rows that are not held out; samples are bounded by the constants above and taken by hash of the id."""
    marked = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2))
    role = F.when(part == 0, F.lit("calibration")).when(F.col("y") == 1, F.lit("toxic")).otherwise(F.lit("ordinary"))
    sizes = {r["role"]: r["count"] for r in marked.select(role.alias("role")).groupBy("role").count().collect()}
    bound = {"toxic": TOXIC_ROWS, "ordinary": ORDINARY_ROWS, "calibration": CALIBRATION_ROWS}
    share = F.create_map(*[F.lit(v) for r, n in bound.items() for v in (r, min(1.0, n / max(sizes.get(r, 0), 1)))])
    draw = F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.withColumn("role", role).where(draw < share[F.col("role")])
    few = F.broadcast(chosen.limit(2 * sum(bound.values())))  # about the sum of the three bounds, and never over twice that
    got = shared.texts(docs, id_col, text_col).where(F.length("text") > 0).join(few, "id").groupBy("id", "y", "role").agg(F.min("text").alias("text"))
    cut = F.pandas_udf(lambda s: s.map(lambda t: pieces(lowered(t))), "array<binary>")
    rows = got.where("role <> 'calibration'").select("id", "role", cut("text").alias("pieces")).orderBy("id").toArrow()
    rows = list(zip(rows["role"].to_pylist(), rows["pieces"].to_pylist()))
    toxic, ordinary = [p for r, p in rows if r == "toxic"], [p for r, p in rows if r == "ordinary"]
    model = ToxicityModel(_trained(TOXIC_BYTES, toxic_marks(toxic, ordinary), 6, 16), _trained(ORDINARY_BYTES, [w for t in ordinary for p in t for w in windows(p)[::2]], 8, 64))
    figures = F.pandas_udf(lambda s: pd.Series(model.features([lowered(t) for t in s]).tolist()), "array<double>")
    held = got.where("role = 'calibration'").select("id", "y", figures("text").alias("x")).orderBy("id").toArrow()  # four figures a row
    if not held.num_rows:
        return model
    return ToxicityModel(model.toxic, model.ordinary, _fit_logistic(np.array(held["x"].to_pylist(), float), np.array([float(y == 1) for y in held["y"].to_pylist()])))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of docs: id_col, held_out, score (0 to 1), predicted (1 from threshold on).

    Only the text enters a score. Null texts are empty; an empty text has the score of a text without any difference. A
    null id stays null; repeated rows each give a row, and of texts that share an id the model learns from the least;
    labels that contradict each other for one id count as toxic;
    null labels are no labels. Without labels of both classes every score is low and the same. An empty table gives an
    empty result; other columns of either table are not read.
    """
    shared.small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([lowered(t) for t in texts]))

    own = shared.texts(docs, id_col, text_col)
    out = own.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
