"""Hard negatives by a dual-tree search over anchors and candidates with inner-product intervals.

Both trees have the same three kinds of nodes. Groups come from median splits along principal directions, fitted on a
bounded sample; every row is routed, and centre and radius of a group cover all its rows. A group of candidates is cut
into chunks (rows of a Spark partition that lie together), a chunk into leaves by further median splits; a group of
anchors is cut into slices by hash. For a pair of nodes with centres a, b and radii r, s all inner products lie within
|a| s + |b| r + r s of a b. A chunk is sent only to those groups of anchors whose interval can hold a wanted score, so
that whole groups are pruned before the shuffle; a slice skips leaves in the same way, and pairs of leaves that are left
are scored exactly, in whole numbers.

First the search finds each anchor's positives, its highest scores of its own label. Their scores are then the bounds of
the second search: for each anchor and positive the highest scores of other labels in the stated band below the positive.
A task holds one slice of anchors and one chunk at a time, and hands on only the best of each anchor.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantrygrid.llm import shared
from pantrygrid.llm.top_inner import EXACT, NARROW, _matrix

#: Rows of the sample that the groups are fitted on (about; twice that at most); most groups; anchors of a group that are aimed at.
SAMPLE, GROUPS, GROUP_ANCHORS = 16384, 1024, 256
#: Rows of a chunk, a leaf and a slice (slices are dealt by hash: about); chunks that one task meets (about).
CHUNK, LEAF, SLICE, CHUNKS = 2048, 256, 256, 256
_LOWEST = np.iinfo(np.int64).min


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 16):
    """Arrow batches of few rows while tables of blocks are worked on, as one block is up to a megabyte."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def labelled_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (floor of scale x each component as double); rows with a null id, label, vector or a null or non-finite component are left out."""
    v = F.col(vec_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).where(whole)
    return own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))


def _direction(m: np.ndarray) -> np.ndarray:
    """The principal direction of rows, by a few power steps from the axis of largest variance."""
    m = m - m.mean(0)
    d = np.zeros(m.shape[1])
    d[np.argmax((m**2).sum(0))] = 1
    for _ in range(8):
        d = m.T @ (m @ d)
        size = np.sqrt(d @ d)
        if not size:
            return np.zeros(m.shape[1])
        d = d / size
    return d


class Groups:
    """The upper levels of both trees: 2 ** depth groups by median splits, and a centre for each."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, n = depth, sample.shape[1]
        self.directions, self.cuts = np.zeros((2**depth, n)), np.zeros(2**depth)  # node k has the children 2k and 2k + 1; the root is 1
        self.centres = np.zeros((2**depth, n))
        rows = {1: sample}
        for node in range(1, 2**depth):
            own = rows.pop(node)
            if len(own) > 1:
                self.directions[node] = _direction(own)
                self.cuts[node] = np.median(own @ self.directions[node])
            right = own @ self.directions[node] > self.cuts[node]
            rows[2 * node], rows[2 * node + 1] = own[~right], own[right]
        for node, own in rows.items():
            if len(own):
                self.centres[node - 2**depth] = own.mean(0)

    def of(self, m: np.ndarray) -> np.ndarray:
        node = np.ones(len(m), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", m, self.directions[node]) > self.cuts[node])
        return node - 2**self.depth


def _routed(vectors: DataFrame, groups: Groups, n: int) -> DataFrame:
    """vectors with their group, and the distance from its centre."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("grp", pa.int32()), ("far", pa.float64())])

    def run(batches):
        for b in batches:
            m = _matrix(b, 2, n).astype(float)
            g = groups.of(m)
            far = np.sqrt(((m - groups.centres[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(schema.field("v").type), pa.array(g, pa.int32()), pa.array(far)], schema=schema)

    return vectors.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<long>, grp int, far double")


def _leaves(m: np.ndarray) -> list[np.ndarray]:
    """Row numbers in leaves of at most LEAF rows that lie together."""
    out, todo = [], [np.arange(len(m))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        along = np.argsort(m[own] @ _direction(m[own]), kind="stable")
        todo += [own[along[len(own) // 2 :]], own[along[: len(own) // 2]]]
    return out


def _chunks(routed: DataFrame, n: int, kind) -> DataFrame:
    """Candidates, in the order that they have, as chunks of one group each: leaves one after another, with centre and radius."""
    schema = pa.schema([("chunk", pa.int64()), ("grp", pa.int32()), ("rows", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("leaf_rows", pa.binary())])

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def packed(g, ids, labels, m):
            leaves = _leaves(m.astype(float))
            turn = np.concatenate(leaves)
            centre = m.astype(float).mean(0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(1).max()))
            return shared.packed([((part << 32) + made, g, len(ids), centre.tobytes(), radius, ids[turn].tobytes(), labels[turn].tobytes(), m[turn].astype(kind).tobytes(), np.array([len(x) for x in leaves], np.int32).tobytes())], schema)

        held, have, group = [], 0, None
        for b in batches:
            ids, labels, m, g = np.asarray(b.column(0)), np.asarray(b.column(1)), _matrix(b, 2, n), np.asarray(b.column(3))
            at = 0
            while at < len(ids):
                if have and (g[at] != group or have == CHUNK):
                    yield packed(group, *(np.concatenate(x) for x in zip(*held)))
                    held, have, made = [], 0, made + 1
                group = int(g[at])
                other = np.flatnonzero(g[at:] != group)
                stop = min(at + (int(other[0]) if len(other) else len(ids)), at + CHUNK - have, len(ids))
                held.append((ids[at:stop], labels[at:stop], m[at:stop]))
                have += stop - at
                at = stop
        if have:
            yield packed(group, *(np.concatenate(x) for x in zip(*held)))

    return routed.select("id", "label", "v", "grp").mapInArrow(run, "chunk long, grp int, rows int, centre binary, radius double, ids binary, labels binary, vectors binary, leaf_rows binary")


def _slices(anchors: DataFrame, n: int, kind, positives: int) -> DataFrame:
    """Anchors (id, label, v, grp, slice, scores of positives) as one block for each slice; missing positives are the lowest number."""
    schema = pa.schema([("grp", pa.int32()), ("slice", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("positives", pa.binary())])

    def run(batches):
        def packed(key, held):
            ids, labels, m, p = (np.concatenate(x) for x in zip(*held))
            return shared.packed([(*key, ids.tobytes(), labels.tobytes(), m.astype(kind).tobytes(), p.tobytes())], schema)

        held, key = [], None
        for b in batches:
            grp, slice_ = np.asarray(b.column(3)), np.asarray(b.column(4))
            m, p = _matrix(b, 2, n), np.full((b.num_rows, positives), _LOWEST)
            size = np.diff(np.asarray(b.column(5).offsets))
            p[np.arange(positives) < size[:, None]] = np.asarray(b.column(5).flatten())
            edges = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (slice_[1:] != slice_[:-1])])
            for a, z in zip(edges, np.r_[edges[1:], len(grp)]):
                if key is not None and key != (int(grp[a]), int(slice_[a])):
                    yield packed(key, held)
                    held = []
                key = (int(grp[a]), int(slice_[a]))
                held.append((np.asarray(b.column(0))[a:z], np.asarray(b.column(1))[a:z], m[a:z], p[a:z]))
        if held:
            yield packed(key, held)

    dealt = anchors.select("id", "label", "v", "grp", "slice", "positives").repartition("grp", "slice").sortWithinPartitions("grp", "slice", "id")
    return dealt.mapInArrow(run, "grp int, slice int, ids binary, labels binary, vectors binary, positives binary")


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; beyond what doubles add up exactly, of any size, and those beyond 64 bits raise."""
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact else (a.astype(object) @ b.astype(object).T).astype(np.int64)


class _Search:
    """The best scores of a slice of anchors so far. Without bounds those of the own label; with them those of other labels in each positive's band."""

    def __init__(self, ids, labels, vectors, most: np.ndarray | None, band: tuple[int, int], k: int, exact: bool):
        self.ids, self.labels, self.vectors, self.k, self.exact = ids, labels, vectors, k, exact
        whole = vectors.astype(float)
        self.whole, self.length = whole, np.sqrt((whole**2).sum(1))
        self.centre = whole.mean(0)
        self.radius = np.sqrt(((whole - self.centre) ** 2).sum(1).max())
        self.own = most is None
        if self.own:
            self.top, self.low = np.full((len(ids), 1), np.inf), np.full((len(ids), 1), _LOWEST)
        else:
            known = most > _LOWEST
            top = [[int(x) * band[1] // 100 for x in row] for row in most]  # whole numbers: low * p <= 100 s <= high * p
            low = [[-(-int(x) * band[0] // 100) for x in row] for row in most]
            self.top = np.where(known, np.array(top, object).reshape(most.shape), _LOWEST).astype(np.int64)
            self.low = np.where(known, np.array(low, object).reshape(most.shape), np.iinfo(np.int64).max).astype(np.int64)
        self.want, self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(4))

    def meet(self, ids, labels, vectors, leaf_rows) -> None:
        whole = vectors.astype(float)
        ends = np.cumsum(leaf_rows)
        centres = np.add.reduceat(whole, ends - leaf_rows) / leaf_rows[:, None]
        radii = np.sqrt(np.maximum.reduceat(((whole - np.repeat(centres, leaf_rows, 0)) ** 2).sum(1), ends - leaf_rows))
        size = np.sqrt((centres**2).sum(1))
        middle, here = centres @ self.centre, np.sqrt(self.centre @ self.centre)
        wide = size * self.radius + here * radii + radii * self.radius
        slack = 1e-9 * (1 + self.length.max() * (size + radii))
        low, top = np.where(self.low == _LOWEST, -np.inf, self.low.astype(float)).min(1), self.top.max(1).astype(float)
        live = (middle + wide + slack >= low.min()) & (middle - wide - slack <= top.max())  # pairs of nodes
        if live.any():  # then each anchor with the leaves that are left
            near, reach = self.whole @ centres.T, self.length[:, None] * radii + slack
            live &= ((near + reach >= low[:, None]) & (near - reach <= top[:, None])).any(0)
        rows = np.repeat(live, leaf_rows)
        if not rows.any():
            return
        ids, labels = ids[rows], labels[rows]
        scores = _scores(self.vectors, vectors[rows], self.exact)
        fits = (labels == self.labels[:, None]) & (ids != self.ids[:, None]) if self.own else labels != self.labels[:, None]
        for slot in range(self.low.shape[1]):
            good = fits & (scores >= self.low[:, slot, None]) & (scores <= self.top[:, slot, None])
            many = good.sum(1)
            if not many.any():
                continue
            if (many > self.k).any():  # only what can be among the k best goes on
                kth = np.partition(np.where(good, scores, _LOWEST), -self.k, axis=1)[:, -self.k]
                good &= scores >= kth[:, None]
            self._add(slot, *np.nonzero(good), scores, ids)

    def _add(self, slot, a, c, scores, ids) -> None:
        here = self.slot == slot
        want, score, id_ = np.r_[self.want[here], a], np.r_[self.score[here], scores[a, c]], np.r_[self.id[here], ids[c]]
        turn = np.lexsort((id_, ~score, want))
        want, score, id_ = want[turn], score[turn], id_[turn]
        rank = np.arange(len(want)) - np.searchsorted(want, want)
        full = rank == self.k - 1
        self.low[want[full], slot] = np.maximum(self.low[want[full], slot], score[full])
        keep = rank < self.k
        self.want, self.score, self.id = (np.r_[x[~here], y[keep]] for x, y in ((self.want, want), (self.score, score), (self.id, id_)))
        self.slot = np.r_[self.slot[~here], np.full(keep.sum(), slot)]


def _searched(chunks: DataFrame, slices: DataFrame, parts: int, reach: dict, groups: Groups, n: int, kind, exact: bool, k: int, band: tuple[int, int] | None) -> DataFrame:
    """anchor_id, slot (which positive), vec_id, score: of every task the best. reach: group -> radius, number of slices, least and most score that its anchors want."""
    keys = np.array(sorted(reach), np.int64)
    centre, far, many, low, top = groups.centres[keys], *(np.array([reach[g][c] for g in sorted(reach)], float) for c in range(4))
    size = np.sqrt((centre**2).sum(1))
    target = pa.list_(pa.struct([("grp", pa.int32()), ("slice", pa.int32()), ("most", pa.float64())]))
    schema = pa.schema([("chunk", pa.int64()), ("to", target)])

    def wanted(batches):
        """The slices that a chunk is sent to: those of groups whose interval with it reaches a wanted score."""
        for b in batches:
            out = []
            for c, radius in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = np.frombuffer(c)
                here, own = centre @ c, np.sqrt(c @ c)
                wide = size * radius + own * far + far * radius + 1e-9 * (1 + (size + far) * (own + radius))
                live = np.flatnonzero((here + wide >= low) & (here - wide <= top))
                out.append([(int(keys[g]), s, float(here[g] + wide[g])) for g in live for s in range(int(many[g]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, target)], schema=schema)

    sent = chunks.select("chunk", "centre", "radius").mapInArrow(wanted, "chunk long, to array<struct<grp:int,slice:int,most:double>>")
    sent = shared.written(sent.select("chunk", F.explode("to").alias("to")).select("chunk", "to.*"))
    nothing = F.lit(None).cast("binary")
    blocks = sent.join(chunks.drop("grp"), "chunk").select("grp", "slice", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"), "most", "ids", "labels", "vectors", "leaf_rows")
    asked = slices.select("grp", "slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), F.lit(0.0).alias("most"), "ids", "labels", "vectors", F.col("positives").alias("leaf_rows") if band else nothing.alias("leaf_rows"))
    met = asked.unionByName(blocks).repartition("grp", "slice", "part").sortWithinPartitions("grp", "slice", "part", "side", F.desc("most"))
    out_schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        search = None

        def found():
            if search is not None and len(search.want):
                yield pa.RecordBatch.from_arrays([pa.array(search.ids[search.want]), pa.array(search.slot, pa.int32()), pa.array(search.id), pa.array(search.score)], schema=out_schema)

        for b in batches:
            for side, ids, labels, vectors, last in zip(*(b.column(c).to_pylist() for c in range(5))):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                vectors = np.frombuffer(vectors, kind).reshape(len(ids), n)
                if side == 0:
                    yield from found()
                    search = _Search(ids, labels, vectors, np.frombuffer(last, np.int64).reshape(len(ids), -1) if band else None, band or (0, 0), k, exact)
                else:
                    search.meet(ids, labels, vectors, np.frombuffer(last, np.int32).astype(np.int64))
        yield from found()

    return met.select("side", "ids", "labels", "vectors", "leaf_rows").mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the first of the other rows of its label; for each of them the negatives are the first of
    the rows of other labels with band[0] * positive_score <= 100 * score <= band[1] * positive_score. First is by higher
    score, then smaller id; scores are inner products of floor(scale * component). Rows on either side with a null id,
    label or vector, or a null or non-finite component, take no part. An anchor id that repeats is one anchor, with its
    least label and vector; rows with the anchor's id are the anchor itself. Other rows that repeat count one by one.
    Shorter vectors end in zeros. Anchors without positives, or positives without negatives, give no rows, and so do empty
    tables. Labels are whole numbers. Components must fit 62 bits once scaled, scores 64; larger ones raise. Columns
    beside the three named ones are not read.
    """
    spark = rows.sparkSession
    shared.small_batches(spark)
    vectors = labelled_vectors(rows, id_col, vec_col, label_col, scale)
    asked = labelled_vectors(anchors, id_col, vec_col, label_col, scale).groupBy("id").agg(F.min(F.struct("label", "v")).alias("own")).select("id", "own.*")
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("largest")
    figures = [F.count("*").alias("rows"), F.max(F.size("v")).alias("n"), largest]
    size, other = vectors.agg(*figures).first(), asked.agg(*figures).first()
    n, most = max(size["n"] or 1, other["n"] or 1), (size["largest"] or 0, other["largest"] or 0)
    if max(most) >= 1 << 62:
        raise ValueError("a component does not fit 62 bits once scaled")
    exact, kind = n * most[0] * most[1] < EXACT, np.int32 if max(most) < NARROW else np.int64
    share = min(1.0, SAMPLE / max(size["rows"], 1))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = vectors.where(draw).select("id", "v").limit(2 * SAMPLE).toArrow().sort_by("id").combine_chunks()
    sample = _matrix(sample.to_batches()[0], 1, n).astype(float) if sample.num_rows else np.zeros((0, n))
    groups = Groups(sample, int(np.ceil(np.log2(max(1, min(GROUPS, other["rows"] / GROUP_ANCHORS))))))
    with _few_rows(spark, 4096):
        dealt = _routed(vectors, groups, n).withColumn("from", F.spark_partition_id())
        ranged = dealt.repartitionByRange(max(1, -(-size["rows"] // (16 * CHUNK))), "grp", "id", "from").sortWithinPartitions("grp", "id")
        chunks = shared.written(_chunks(ranged, n, kind))
        own = shared.written(_routed(asked, groups, n))
    parts = max(1, -(-chunks.count() // CHUNKS))
    members = {r["grp"]: r for r in own.groupBy("grp").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect()}  # GROUPS rows at most
    many = {g: max(1, -(-r["rows"] // SLICE)) for g, r in members.items()}
    sizes = F.broadcast(spark.createDataFrame(list(many.items()), "grp int, slices int"))  # GROUPS rows at most
    own = own.join(sizes, "grp").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    args = (groups, n, kind, exact)
    with _few_rows(spark):
        plain = shared.written(_slices(own.withColumn("positives", F.array().cast("array<long>")), n, kind, positives))
        # a first look, at one chunk of each group, for the floors of whole groups
        home = chunks.join(F.broadcast(chunks.groupBy("grp").agg(F.min("chunk").alias("chunk")).select("chunk")), "chunk", "left_semi")  # GROUPS rows at most
        reach = {g: (r["far"], many[g], -np.inf, np.inf) for g, r in members.items()}
        best = lambda found, keys, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        seen = _searched(home, plain, 1, reach, *args, positives, None)
        kth = own.select("id", "grp").join(best(seen, ["anchor_id"], positives).where(F.col("rank") == positives).select(F.col("anchor_id").alias("id"), "score"), "id", "left")
        floors = {r["grp"]: r for r in kth.groupBy("grp").agg(F.min("score").alias("low"), F.count(F.when(F.col("score").isNull(), 1)).alias("open")).collect()}
        reach = {g: (r["far"], many[g], float(floors[g]["low"]) if not floors[g]["open"] else -np.inf, np.inf) for g, r in members.items()}
        near = shared.written(best(_searched(chunks, plain, parts, reach, *args, positives, None), ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        bounds = near.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))  # a few for each anchor
        ready = shared.written(own.join(bounds, "id"))
        ends = ready.groupBy("grp").agg(F.min(F.array_min("positives")).alias("low"), F.max(F.array_max("positives")).alias("top")).collect()
        low = lambda p: min(p * band[0], p * band[1]) / 100
        reach = {r["grp"]: (members[r["grp"]]["far"], many[r["grp"]], low(r["low"]) - 1, max(r["top"] * band[0], r["top"] * band[1]) / 100 + 1) for r in ends}
        full = shared.written(_slices(ready, n, kind, positives))
        hard = shared.written(_searched(chunks, full, parts, reach, *args, negatives, band))
    ranked = best(hard, ["anchor_id", "slot"], negatives).select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(ranked, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
