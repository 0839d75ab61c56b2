"""Periodic runs of words by Crochemore's partition refinement.

Positions are classed by the factor of l words that starts there, for l = 1, 2, 3, ... A class of length l + 1 is what is
left of a class of length l when it is split by the class of the next position. Only the smaller parts of a split split
others in the next step, so a position is moved O(log n) times. Each class is a list in order of position. Two
neighbours of a class at distance l are a square of period l, and its root is primitive, as a shorter period would put a
member between them. Squares at consecutive positions are one run, which no neighbour extends.

The kernel refines the classes of many documents at once; numpy works on all positions that move in a step, and a
document counts only up to the largest period that a run in it can have. Documents are dealt by Spark as they lie; there
is no shuffle, and a task holds FLUSH words or one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Words that one refinement handles at once; a longer document stands alone. Documents of over LONG words wait for each
#: other, as the number of steps is that of the longest document.
FLUSH, LONG = 1 << 20, 2048
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; of a null text none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] numbers, then those of start[1], ..."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


class _Classes:
    """Classes of positions by equal factors, refined from one length to the next.

    order holds the members of a class side by side, loc says where; nxt and prv are the neighbours by position in a
    class, -1 for none. log keeps (position, distance to its next neighbour, 0 for none, length from which that holds).
    """

    def __init__(self, names: np.ndarray, limit: np.ndarray):
        n = len(names)
        self.order = np.argsort(names, kind="stable").astype(np.int32)
        sorted_names = names[self.order]
        first = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]])
        self.start, self.size = np.zeros(2 * n + 1, np.int32), np.zeros(2 * n + 1, np.int32)
        self.count = len(first)
        self.start[: self.count], self.size[: self.count] = first, np.diff(np.r_[first, n])
        self.cls, self.loc = np.empty(n, np.int32), np.empty(n, np.int32)
        self.cls[self.order] = np.repeat(np.arange(self.count, dtype=np.int32), self.size[: self.count])
        self.loc[self.order] = np.arange(n, dtype=np.int32)
        self.nxt, self.prv = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.marked, self.limit, self.log = np.zeros(n, bool), limit, []
        self._link(self.order.copy(), sorted_names[1:] == sorted_names[:-1], 1)
        self.small = np.arange(1, n, dtype=np.int32)

    def _link(self, members: np.ndarray, joined: np.ndarray, length: int) -> None:
        """Makes lists of members, of which each is joined with the next or not."""
        nxt, prv = np.full(len(members), -1, np.int32), np.full(len(members), -1, np.int32)
        nxt[:-1][joined], prv[1:][joined] = members[1:][joined], members[:-1][joined]
        self.nxt[members], self.prv[members] = nxt, prv
        self.log.append((members, np.where(nxt >= 0, nxt - members, 0).astype(np.int32), length))

    def refine(self, length: int) -> bool:
        """From factors of one word less to this length; False if no class can change any more."""
        at = self.small - 1
        open_ = (self.size[self.cls[at]] > 1) & (self.limit[at] >= length)
        at, by = at[open_], self.small[open_]
        if not len(at):
            return False
        key = self.cls[at].astype(np.int64) * len(self.start) + self.cls[by]
        turn = np.argsort(key, kind="stable")  # small is sorted, so members of a part are in order
        at, key = at[turn], key[turn]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        part_size = np.diff(np.r_[first, len(at)])
        part_class = self.cls[at[first]]
        head = np.flatnonzero(np.r_[True, part_class[1:] != part_class[:-1]])  # the first part of each class
        classes, largest, taken = part_class[head], np.maximum.reduceat(part_size, head), np.add.reduceat(part_size, head)
        rest = self.size[classes] - taken
        stays = np.repeat(rest < largest, np.diff(np.r_[head, len(first)])) & (part_size == np.repeat(largest, np.diff(np.r_[head, len(first)])))
        if stays.any():  # of equal parts the first
            number = np.flatnonzero(stays)
            stays[:] = False
            stays[number[np.r_[True, part_class[number][1:] != part_class[number][:-1]]]] = True
        moves = np.repeat(~stays, part_size)
        part = np.repeat(np.arange(len(first)), part_size)
        torn = np.flatnonzero((rest > 0) & (rest < largest))  # the rest is smaller than a part: it moves too
        if len(torn):
            self.marked[at] = True
            whole = self.order[_ranges(self.start[classes[torn]], self.size[classes[torn]])]
            other = np.repeat(len(first) + np.arange(len(torn)), self.size[classes[torn]])
            left = ~self.marked[whole]
            self.marked[at] = False
            at, part = np.r_[at[moves], whole[left]], np.r_[part[moves], other[left]]
            turn = np.lexsort((at, part, self.cls[at]))
            at, part = at[turn], part[turn]
        else:
            at, part = at[moves], part[moves]
        if not len(at):
            self.small = at
            return True
        self._move(at, part, length)
        self.small = np.sort(at)
        return True

    def _move(self, at: np.ndarray, part: np.ndarray, length: int) -> None:
        """Takes members, sorted by class, part and position, out of their classes; each part becomes a class."""
        old = self.cls[at]
        by_place = np.argsort(old.astype(np.int64) * len(self.nxt) + at, kind="stable")
        gone = at[by_place]
        follow = self.nxt[gone[:-1]] == gone[1:]
        left, right = self.prv[gone[np.r_[True, ~follow]]], self.nxt[gone[np.r_[~follow, True]]]
        self.nxt[left[left >= 0]] = right[left >= 0]
        self.prv[right[right >= 0]] = left[right >= 0]
        stay = left >= 0
        self.log.append((left[stay], np.where(right[stay] >= 0, right[stay] - left[stay], 0).astype(np.int32), length))
        # moved members go to the end of their class's stretch of order, by swaps with those that stay
        head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        many = np.diff(np.r_[head, len(at)]).astype(np.int32)
        classes = old[head]
        tail = self.start[classes] + self.size[classes] - many
        slots = _ranges(tail, many).astype(np.int32)
        self.marked[at] = True
        there = self.order[slots]
        kept = there[~self.marked[there]]
        self.marked[at] = False
        holes = self.loc[at][self.loc[at] < np.repeat(tail, many)]
        self.order[holes], self.loc[kept] = kept, holes
        self.order[slots], self.loc[at] = at, slots
        self.size[classes] -= many
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[first, len(at)]).astype(np.int32)
        new = self.count + np.arange(len(first), dtype=np.int32)
        self.count += len(first)
        if self.count > len(self.start):
            self.start, self.size = (np.r_[x, np.zeros(len(x) + len(first), np.int32)] for x in (self.start, self.size))
        self.start[new], self.size[new] = slots[first], sizes
        self.cls[at] = np.repeat(new, sizes)
        self._link(at, part[1:] == part[:-1], length)


def squares(names: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of the primitively rooted squares of periods up to limit (by position); names are equal where words are."""
    found = _Classes(names, limit)
    length = 2
    while found.refine(length):
        length += 1
    at, gap = (np.concatenate([x[k] for x in found.log]) for k in (0, 1))
    since = np.repeat(np.array([x[2] for x in found.log], np.int32), [len(x[0]) for x in found.log])
    turn = np.argsort(at, kind="stable")
    at, gap, since = at[turn], gap[turn], since[turn]
    until = np.full(len(at), np.iinfo(np.int32).max, np.int32)  # the length at which the next entry of a position takes over
    until[:-1][at[1:] == at[:-1]] = since[1:][at[1:] == at[:-1]]
    true = (gap > 0) & (gap <= limit[at]) & (since <= gap) & (gap < until)
    return at[true], gap[true]


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = 6, powers: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start, length, period of all runs of max(least, powers * period) words and more, by document, start, period.

    codes: words as numbers, document after document; sizes: words of each document.
    """
    many, ends = len(sizes), np.cumsum(sizes)
    # after each document stands a position unlike all others, so that no factor crosses
    place = np.arange(len(codes)) + np.repeat(np.arange(many), sizes)
    names = np.empty(len(codes) + many, np.int64)
    span = int(codes.max(initial=0)) + 1
    names[place] = codes + np.repeat(np.arange(many, dtype=np.int64), sizes) * span
    names[ends + np.arange(many)] = many * span + np.arange(many)
    limit = np.where(sizes >= least, sizes // powers, 0).astype(np.int32)
    if not len(names):
        return (np.empty(0, np.int64),) * 4
    at, period = squares(names, np.repeat(limit, sizes + 1))
    turn = np.lexsort((at, period))
    at, period = at[turn].astype(np.int64), period[turn].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]) if len(at) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(at)] - 1 if len(first) else first
    start, period = at[first], period[first]
    length = at[last] - start + 2 * period
    long = length >= np.maximum(least, powers * period)
    start, length, period = start[long], length[long], period[long]
    begins = ends - sizes + np.arange(many)  # places of the documents' first words
    doc = np.searchsorted(begins, start, side="right") - 1
    start = start - begins[doc]
    turn = np.lexsort((period, start, doc))
    return doc[turn], start[turn], length[turn], period[turn]


def _flushed(held: list[pa.RecordBatch], schema: pa.Schema, least: int, powers: int):
    for b in held:
        if b.column(1).null_count:
            raise ValueError("words must not be null")
    lists = pa.chunked_array([b.column(1) for b in held]).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets)).astype(np.int64)
    codes = np.asarray(flat.dictionary_encode().indices, np.int64)
    doc, start, length, period = runs_of(codes, sizes, least, powers)
    at = np.r_[0, np.cumsum(sizes)]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at[doc] + start + period, 1)
    np.add.at(edge, at[doc] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.r_[0, np.cumsum(kept)][at].astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept))), " ")
    bounds = pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32))
    runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
    ids = pa.concat_arrays([b.column(0) for b in held])
    done = 0
    for b in held:
        yield pa.RecordBatch.from_arrays([x.slice(done, b.num_rows) for x in (ids, runs, texts)], schema=schema)
        done += b.num_rows


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words", least: int = 6, powers: int = 4) -> DataFrame:
    """For each row its id, runs and collapsed text.

    runs: array of (start, length, period) by start and period, of every stretch of max(least, powers * period) words or
    more that has that smallest period and that no neighbouring word extends. collapsed: the words that no run contains
    after its first period, joined by one space. One row for each row of docs, whatever its id (null or repeated ids are
    kept as they are); null words are no words, null members of an array are empty words; without words there are no
    runs and the text is empty. Columns beside the two named ones are not read. Words are compared as they are, not by hash.
    """
    shared.small_batches(docs.sparkSession)
    empty = F.array().cast("array<string>")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.transform(F.coalesce(F.col(words_col), empty), lambda w: F.coalesce(w, F.lit(""))).alias("words"))
    schema = pa.schema([("id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches):
        held = {False: [], True: []}
        words = {False: 0, True: 0}
        for b in batches:
            long = pc.greater(pc.list_value_length(b.column(1)), LONG)
            for kind, own in ((True, b.filter(long)), (False, b.filter(pc.invert(long)))):
                held[kind].append(own)
                words[kind] += len(own.column(1).flatten())
                if words[kind] >= FLUSH:
                    yield from _flushed(held[kind], schema, least, powers)
                    held[kind], words[kind] = [], 0
        for own in held.values():
            if own:
                yield from _flushed(own, schema, least, powers)

    found = narrow.mapInArrow(run, "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
