"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors have integer components. Candidates lie in blocks by descending length. A rotation from the singular vectors of
all candidates puts most of a vector's length into its first coordinates, so a partial product over those, plus the
product of the two residual lengths, is a tight upper bound (Cauchy-Schwarz). A candidate is scored in full, in
integers, only where that bound reaches the k-th best score so far. First every query meets one block of the longest
vectors; its k-th best score there is its floor. Then blocks of the stated queries meet the other blocks of candidates,
which are dealt by hash: pairs of blocks in which no product of lengths reaches a floor are never formed, and all other
work starts from the floors. A task keeps one running list of k for each query and hands on only that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Rows of a block of candidates and of queries, candidates looked at in one go, coordinates of the partial sums.
CANDIDATES, QUERIES, STRIDE, PARTIAL = 8192, 256, 1024, (16, 32)
#: Parts that blocks of candidates are dealt to; blocks of queries go to each.
DEALT = 16
_BLOCK = "block long, longest double, ids binary, vectors binary"
#: Largest size of a component that is held in 32 bits, and of an inner product that doubles add up exactly.
NARROW, EXACT = 1 << 31, 1 << 53


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (floor of scale x each component as double); rows with a null or non-finite part are left out."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(whole)
    return own.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(batch: pa.RecordBatch, k: int, n: int) -> np.ndarray:
    """Column k of long lists as a matrix with n columns; shorter rows end in zeros."""
    col = batch.column(k)
    size = np.diff(np.asarray(col.offsets))
    out = np.zeros((batch.num_rows, n), np.int64)
    out[np.arange(n) < size[:, None]] = np.asarray(col.flatten())
    return out


def _gram(vectors: DataFrame, n: int) -> np.ndarray:
    """Sum of v v^T over all vectors."""

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            m = _matrix(b, 0, n).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(n * n), pa.int64()), pa.array(total.ravel())], names=["cell", "g"])

    got = vectors.select("v").mapInArrow(run, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(n * n)
    out[np.asarray(got["cell"], int)] = np.asarray(got["g"], float)
    return out.reshape(n, n)


def _packed(vectors: DataFrame, n: int, rows: int, kind=np.int32) -> DataFrame:
    """Rows (id, v, length), in the order that they have, as numbered blocks of at most so many; components as kind."""
    schema = pa.schema([("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        ids, vecs, have, made = [], [], 0, TaskContext.get().partitionId() << 32
        def block():
            i, m = np.concatenate(ids), np.concatenate(vecs)
            return shared.packed([(made, float(np.sqrt((m.astype(float) ** 2).sum(1)).max()), i.tobytes(), m.astype(kind).tobytes())], schema)
        for b in batches:
            i, m = np.asarray(b.column(0), np.int64), _matrix(b, 1, n)
            while len(i):
                take = rows - have
                ids.append(i[:take])
                vecs.append(m[:take])
                have += len(i[:take])
                i, m = i[take:], m[take:]
                if have == rows:
                    yield block()
                    ids, vecs, have, made = [], [], 0, made + 1
        if have:
            yield block()

    return vectors.select("id", "v").mapInArrow(run, _BLOCK)


class _Best:
    """The k best so far of a block of queries. Where doubles would not add up exactly, scores are products of whole numbers of any size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, rotation: np.ndarray, exact: bool, floor: np.ndarray | None = None):
        self.ids, self.whole, self.k, self.exact = ids, vectors.astype(float), k, exact
        self.numbers = None if exact else vectors.astype(object)
        self.turned = self.whole @ rotation
        self.length = np.sqrt((self.whole**2).sum(1))
        self.rest = [np.sqrt((self.turned[:, d:] ** 2).sum(1)) for d in PARTIAL]
        self.q, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(len(ids), np.iinfo(np.int64).min) if floor is None else floor.copy()

    def see(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> None:
        whole = vectors.astype(float)
        turned, length = whole @ rotation, np.sqrt((whole**2).sum(1))
        for a in range(0, len(ids), STRIDE):
            part = slice(a, a + STRIDE)
            slack = 1e-9 * (1 + self.length.max(initial=0) * length[part].max())
            floor = self.floor.astype(float)
            live = np.flatnonzero(self.length * length[part].max() + slack >= floor)
            if not len(live):
                continue
            open_ = np.ones((len(live), len(ids[part])), bool)
            for d, rest in zip(PARTIAL, self.rest):
                tail = np.sqrt((turned[part, d:] ** 2).sum(1))
                bound = self.turned[live, :d] @ turned[part, :d].T + rest[live][:, None] * tail + slack
                open_ &= bound >= floor[live][:, None]
                if open_.mean() < 0.05:
                    break
            qi, vi = np.nonzero(open_ & (self.ids[live][:, None] != ids[part]))
            score = self._scores(live, qi, whole[part], vectors[part], vi, open_.size)
            keep = score >= self.floor[live[qi]]
            self._add(live[qi[keep]], score[keep], ids[part][vi[keep]])

    def _scores(self, live, qi, whole, vectors, vi, size: int) -> np.ndarray:
        if not self.exact:  # an inner product beyond 64 bits raises here
            return np.array([int((self.numbers[q] * v).sum()) for q, v in zip(live[qi], vectors[vi].astype(object))], np.int64)
        if len(qi) > 0.2 * size:
            return (self.whole[live] @ whole.T)[qi, vi].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", self.whole[live[qi[s : s + 65536]]], whole[vi[s : s + 65536]]) for s in range(0, len(qi), 65536)] or [np.empty(0)]).astype(np.int64)

    def _add(self, q, score, vec):
        q, score, vec = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, vec])
        order = np.lexsort((vec, ~score, q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], vec[keep]
        full = rank[keep] == self.k - 1
        self.floor[self.q[full]] = np.maximum(self.floor[self.q[full]], self.score[full])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query its k highest inner products with candidates: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Components x become floor(scale * x). A candidate with the query's id is the query itself and takes no part. Vectors
    null or holding null or non-finite components, and rows with a null id, take no part on either side. A query id that
    repeats is one query, with its least vector; candidates that repeat count one by one. Shorter vectors end in zeros.
    Fewer candidates than k give them all; no queries or no candidates give an empty result. Components may be of any
    size that fits 62 bits once scaled, and scores of any that fits 64; larger ones raise. Columns beside the two named
    ones are not read.
    """
    vectors = integer_vectors(candidates, id_col, vec_col, scale)
    asked = integer_vectors(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("largest")
    size, other = vectors.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("n"), largest).first(), asked.agg(F.max(F.size("v")).alias("n"), largest).first()
    n, most = max(size["n"] or 1, other["n"] or 1), (size["largest"] or 0, other["largest"] or 0)
    if max(most) >= 1 << 62:
        raise ValueError("a component does not fit 62 bits once scaled")
    exact, kind = n * most[0] * most[1] < EXACT, np.int32 if max(most) < NARROW else np.int64
    rotation = np.linalg.eigh(_gram(vectors, n))[1][:, ::-1]
    parts = max(1, -(-size["rows"] // CANDIDATES))
    ranged = vectors.withColumn("length", _length(F.col("v"))).repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    blocks = shared.written(_packed(ranged, n, CANDIDATES, kind))
    heads = shared.written(_packed(asked.select("id", "v"), n, QUERIES, kind)).select(F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    read = lambda raw, rows: np.frombuffer(raw, kind).reshape(rows, n)
    found_fields = "query_id long, vec_id long, score long"

    def run(batches):
        best: dict[bytes, _Best] = {}
        for b in batches:
            for q_ids, q_vectors, floors, ids, vecs in zip(*(b.column(c).to_pylist() for c in range(5))):
                i, j = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                if q_ids not in best:
                    if len(best) > 16:
                        yield from out(best)
                        best = {}
                    best[q_ids] = _Best(i, read(q_vectors, len(i)), k, rotation, exact, None if floors is None else np.frombuffer(floors, np.int64))
                best[q_ids].see(j, read(vecs, len(j)), rotation)
        yield from out(best)

    def out(best):
        for x in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.q]), pa.array(x.id), pa.array(x.score)], schema=schema)

    def floors_of(batches):
        """The k-th score of each query of a block from the found ones, packed; the least of them."""
        for b in batches:
            rows = []
            for q_longest, q_ids, q_vectors, have in zip(*(b.column(c).to_pylist() for c in range(4))):
                known = {x["query_id"]: x["floor"] for x in have or ()}
                floor = np.array([known.get(i, np.iinfo(np.int64).min) for i in np.frombuffer(q_ids, np.int64).tolist()], np.int64)
                rows.append((q_longest, q_ids, q_vectors, floor.tobytes(), float(floor.min())))
            yield shared.packed(rows, pa.schema([("q_longest", pa.float64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("floors", pa.binary()), ("least", pa.float64())]))

    shared.small_batches(queries.sparkSession)
    top = F.broadcast(blocks.agg(F.max(F.struct("longest", "block")).alias("t")).select("t.block"))  # one row
    longest = blocks.join(top, "block").select("ids", "vectors")  # one block
    first = shared.written(heads.withColumn("floors", F.lit(None).cast("binary")).crossJoin(longest).select("q_ids", "q_vectors", "floors", "ids", "vectors").mapInArrow(run, found_fields))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    members = heads.select("q_ids").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q, np.int64)), pa.array([q] * (len(q) // 8), pa.binary())], names=["query_id", "q_ids"]) for b in bs for q in b.column(0).to_pylist()), "query_id long, q_ids binary")
    by_block = members.join(kth, "query_id").groupBy("q_ids").agg(F.collect_list(F.struct("query_id", "floor")).alias("have"))  # QUERIES of a block at most
    floored = shared.written(heads.join(by_block, "q_ids", "left").select("q_longest", "q_ids", "q_vectors", "have").mapInArrow(floors_of, "q_longest double, q_ids binary, q_vectors binary, floors binary, least double"))
    part = F.pmod(F.xxhash64("block"), F.lit(DEALT)).cast("int")
    others = blocks.join(top, "block", "left_anti").select(part.alias("part"), "longest", "ids", "vectors")
    asked_blocks = floored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    reached = F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least")
    pairs = asked_blocks.join(others, "part").where(reached)  # blocks of the stated queries with blocks of all candidates
    found = first.unionByName(pairs.select("q_ids", "q_vectors", "floors", "ids", "vectors").mapInArrow(run, found_fields))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
