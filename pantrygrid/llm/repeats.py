"""Suffix-array dedup: repeated byte strings of a corpus from merged Burrows-Wheeler transforms of its shards.

Every window of 100 bytes belongs to its anchor: the 32-byte string inside it with the least hash (the leftmost of
equals). Equal windows have equal anchors, so neighbouring windows with one anchor form a segment, and only segments with
the same anchor can share a window. Three steps find the windows that also start earlier:

1. Shards send fingerprints of anchors and segments. A segment that is the same, byte for byte, as an earlier one repeats
   in all its windows; a segment whose anchor occurs nowhere else repeats in none. What is left are segments that share
   an anchor and differ: the ends of repeated passages.
2. Each shard writes the Burrows-Wheeler transform of its left segments. The shards' transforms merge by refining their
   interleave: it starts with all suffixes in one interval, and each round puts the suffixes, in the order they have, into
   intervals by the two symbols before them, which the transforms hold, and steps to those longer suffixes. After n rounds
   suffixes of one interval have 2n bytes in common; an interval with one suffix cannot repeat and leaves. Nothing is
   compared or sorted anew. The intervals after 50 rounds are the repeated windows; all but the earliest are repeats.
3. An anchor with very many different segments (a common line) would gather them in one task. Its windows go out one by
   one instead, each shard sending a window once, and are resolved as whole segments are in step 1.

A document gets its repeated windows as ranges, and its bytes are cut once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Bytes of an anchor, bytes of text in a shard, anchors in a bucket, different segments from which an anchor is common.
ANCHOR, SHARD_BYTES, BUCKET_ANCHORS, COMMON = 32, 8 << 20, 300_000, 1000
#: Bytes of a piece of a longer document; positions in a piece and its neighbours fit POSITION_BITS.
PIECE_BYTES, POSITION_BITS = 16 << 20, 26
END = 0xFF  # never a byte of UTF-8
_ENTRIES = "bucket long, prints binary, segments binary, ids binary, starts binary, sizes binary"
_FOUND = "id long, start int, stop int, kind int, print long"
_ENTRY_TYPES = {"prints": np.uint64, "segments": np.uint64, "ids": np.int64, "starts": np.int32, "sizes": np.int32}
U = np.uint64


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by block-wise running minima from both sides."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, U)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The segments of the rows that offsets bound: row, start (in data), size (windows), print (of the anchor), segment (fingerprint of all its bytes)."""
    n = len(data) - length + 1
    empty = {k: np.empty(0, np.int64) for k in ("row", "start", "size")} | {k: np.empty(0, U) for k in ("print", "segment")}
    if n <= 0:
        return empty
    prefix = shared.prefix_hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = shared.span_hashes(prefix, at, at + ANCHOR)
    low = U((1 << POSITION_BITS) - 1)
    anchor = (_sliding_least((h & ~low) | at.astype(U), length - ANCHOR + 1) & low).astype(np.int64)
    size = np.diff(offsets)
    last = np.repeat(offsets[1:], size)[:n] - length  # the last window of each position's row
    inside = np.arange(n) <= last
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (last[1:] != last[:-1]) | ~inside[:-1]
    start = np.flatnonzero(change & inside)
    stop = np.minimum(np.append(np.flatnonzero(change), n)[np.searchsorted(np.flatnonzero(change), start) + 1], last[start] + 1)
    row = np.searchsorted(offsets, start, side="right") - 1
    return {"row": row, "start": start, "size": stop - start, "print": h[anchor[start]], "segment": shared.span_hashes(prefix, start, stop + length - 1)}


def _shards(batches, limit: int = SHARD_BYTES):
    """Arrow batches as shards of about limit bytes of text: lists of batches."""
    held, size = [], 0
    for b in batches:
        _, at = shared.buffers(b.column(1))
        for i, j in shared.slices(at, limit):
            part = b.slice(i, j - i)
            held.append(part)
            size += int(at[j] - at[i])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, start, data, offsets) of parts that fit the kernels: whole rows together, a long row in pieces that share length - 1 bytes."""
    for i, j in shared.slices(offsets, PIECE_BYTES):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PIECE_BYTES:
            yield i, a, data[a:b], offsets[i : j + 1] - a
            continue
        for k in range(a, b, PIECE_BYTES):
            stop = min(b, k + PIECE_BYTES + length - 1)
            yield i, k, data[k:stop], np.array([0, stop - k])


def _by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, its values packed."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    edge = np.append(first, len(order))
    packed = {"bucket": pa.array(found.astype(np.int64), pa.int64())}
    for name, v in columns.items():
        v = np.ascontiguousarray(v[order].astype(_ENTRY_TYPES[name]))
        packed[name] = pa.array([v[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
    return pa.RecordBatch.from_pydict(packed)


def _first_of_each(segment: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by segment, id, start, and where a new segment begins in it."""
    order = np.lexsort((starts, ids, segment))
    s = segment[order]
    return order, np.append(True, s[1:] != s[:-1]) if len(s) else np.empty(0, bool)


def _sent(prints, segs, ids, starts, sizes, buckets: int, by: np.ndarray, key: int) -> list[pa.RecordBatch]:
    """A shard's entries by bucket, each segment once; its own repeats under a bucket beyond the others."""
    order, first = _first_of_each(segs, ids, starts)
    keep, again = order[first], order[~first]
    out = [_by_bucket((by[keep] % U(buckets)).astype(np.int64), {"prints": prints[keep], "segments": segs[keep], "ids": ids[keep], "starts": starts[keep], "sizes": sizes[keep]})] if len(keep) else []
    if len(again):
        zero = np.zeros(len(again), U)
        out.append(_by_bucket(np.full(len(again), buckets + key % buckets), {"prints": zero, "segments": zero, "ids": ids[again], "starts": starts[again], "sizes": sizes[again]}))
    return out


def _anchors(length: int, buckets: int):
    """Documents (id, text) to the entries of their segments, shard by shard."""

    def run(batches):
        for held in _shards(batches):
            got: list[tuple] = []
            for b in held:
                data, at = shared.buffers(b.column(1))
                own = np.asarray(b.column(0), np.int64)
                for row, base, part, edges in _pieces(data, at, length):
                    s = segments(part, edges, length)
                    r = row + s["row"]
                    got.append((s["print"], s["segment"], own[r], base + s["start"] - at[r], s["size"]))
            cols = [np.concatenate(c) for c in zip(*got)] if got else []
            if cols and len(cols[0]):
                yield from _sent(*cols, buckets, cols[0], int(cols[0][0] >> U(1)))

    return run


def _entries(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[name]), kind) for name, kind in _ENTRY_TYPES.items()]


def _found(ids, starts, stops, kind: int, prints) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "start": starts.astype(np.int32), "stop": stops.astype(np.int32), "kind": np.full(len(ids), kind, np.int32), "print": prints.view(np.int64)})


def _resolve(buckets: int, common: int):
    """Entries of one bucket: kind 1 are repeated windows, 2 and 3 segments that share their anchor with different ones (3: with very many)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, segs, ids, starts, sizes = _entries(pdf)
        if pdf["bucket"].iloc[0] >= buckets:
            return _found(ids, starts, starts + sizes, 1, prints)
        order, first = _first_of_each(segs, ids, starts)
        again, lead = order[~first], order[first]
        order = lead[np.argsort(prints[lead], kind="stable")]
        new = np.flatnonzero(np.append(True, prints[order][1:] != prints[order][:-1]))
        many = np.repeat(np.diff(np.append(new, len(order))), np.diff(np.append(new, len(order))))
        out = [_found(ids[again], starts[again], starts[again] + sizes[again], 1, prints[again])]
        for kind, which in ((2, order[(many > 1) & (many <= common)]), (3, order[many > common])):
            out.append(_found(ids[which], starts[which], starts[which] + sizes[which], kind, prints[which]))
        return pd.concat(out)

    return run


def shard_transform(strings: list[bytes]) -> np.ndarray:
    """The Burrows-Wheeler transform of strings: of each suffix in sorted order the byte before it, END at a string's start.

    Every string has an end mark, larger than any byte; among end marks the earlier string's is smaller. Suffixes are
    sorted by eight bytes, then by doubling until all differ.
    """
    text = np.frombuffer(bytes([END]).join(strings) + bytes([END]), np.uint8)
    n = len(text)
    end = np.flatnonzero(text == END)
    left = np.repeat(end, np.diff(np.append(-1, end))) - np.arange(n)  # bytes to the end mark
    pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for k in range(8):
        key = (key << U(8)) | np.where(left >= k, pad[k : k + n], U(0))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.append(True, key[order][1:] != key[order][:-1]) | (left[order] < 8)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while True:
        edge = np.append(np.flatnonzero(new), n)
        tied = np.repeat(np.diff(edge) > 1, np.diff(edge))
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        pos = order[at]
        double = rank[pos] * n + rank[pos + h]
        turn = np.argsort(double, kind="stable")
        pos, double = pos[turn], double[turn]
        order[at] = pos
        new[at] = np.append(True, double[1:] != double[:-1]) | (left[pos] < 2 * h)
        rank[pos] = np.maximum.accumulate(np.where(new[at], at, 0))
        h *= 2
    return np.where(order > 0, text[order - 1], END).astype(np.uint8)


def merged_intervals(transforms: list[np.ndarray], sizes: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, interval) of the windows that repeat in the strings behind the transforms, intervals together.

    sizes: of each transform's strings the number of their windows; strings are numbered on over all transforms.
    """
    links, symbols, ends, base = [], [], [], 0
    for bwt, size in zip(transforms, sizes):
        step = np.empty(len(bwt), np.int64)
        step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt)) + base
        links.append(step)
        symbols.append(bwt)
        ends.append(base + len(bwt) - len(size) + np.arange(len(size)))
        base += len(bwt)
    link, symbol, at, left = np.concatenate(links), np.concatenate(symbols), np.concatenate(ends), np.concatenate(sizes).astype(np.int64)
    # Windows' ends, by steps back from the strings' ends; all are one interval.
    string, x, owner, window = np.arange(len(left)), [], [], []
    while len(string):
        x.append(at)
        owner.append(string)
        window.append(left - 1)
        go = left > 1
        string, at, left = string[go], link[at[go]], left[go] - 1
    x = np.concatenate(x)
    item, block = np.arange(len(x)), np.zeros(len(x), np.int64)
    owner, window = np.concatenate(owner), np.concatenate(window)
    pair = (symbol.astype(np.uint16) << 8) | symbol[link]
    pairs_link = link[link]
    todo = length
    while todo and len(x):
        key, step = (pair, pairs_link) if todo > 1 else (symbol, link)
        todo -= 2 if todo > 1 else 1
        k = key[x]
        order = np.argsort(k, kind="stable")
        k, block = k[order], block[order]
        new = np.append(True, (k[1:] != k[:-1]) | (block[1:] != block[:-1]))
        stay = ~(new & np.append(new[1:], True))
        order = order[stay]
        x, item, block = step[x[order]], item[order], np.cumsum(new)[stay]
    return owner[item], window[item], block


def _ranges(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single window starts as ranges of neighbours."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)) if len(ids) else np.empty(0, bool)
    last = np.append(new[1:], True) if len(ids) else new
    return ids[new], starts[new], starts[last] + 1


def _transforms(length: int, buckets: int):
    """Documents (id, text, segs) to the transforms of their segments, by bucket, shard by shard."""
    schema = pa.schema([("bucket", pa.int64()), ("bwt", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        held, size = {}, 0
        for b in batches:
            data, at = shared.buffers(b.column(1))
            own, segs = np.asarray(b.column(0), np.int64), b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(segs.offsets)))
            flat = segs.flatten()
            start, stop, prints = (np.asarray(flat.field(k)) for k in ("start", "stop", "print"))
            bucket = (prints.view(U) >> U(7)) % U(buckets)
            for r, i, j, k in zip(row.tolist(), start.tolist(), stop.tolist(), bucket.tolist()):
                held.setdefault(k, []).append((data[at[r] + i : at[r] + j + length - 1].tobytes(), own[r], i, j - i))
                size += j - i + length
            if size >= SHARD_BYTES:
                yield out(held)
                held, size = {}, 0
        if held:
            yield out(held)

    def out(held):
        rows = []
        for k, got in held.items():
            text, ids, start, size = zip(*got)
            rows.append((k, shard_transform(list(text)).tobytes(), np.array(ids, np.int64).tobytes(), np.array(start, np.int32).tobytes(), np.array(size, np.int32).tobytes()))
        return shared.packed(rows, schema)

    return run


def _merge(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, starts = np.frombuffer(b"".join(pdf["ids"]), np.int64), np.frombuffer(b"".join(pdf["starts"]), np.int32)
        string, window, interval = merged_intervals([np.frombuffer(b, np.uint8) for b in pdf["bwt"]], [np.frombuffer(b, np.int32) for b in pdf["sizes"]], length)
        own, start = ids[string], starts[string].astype(np.int64) + window
        order, first = _first_of_each(interval, own, start)
        i, a, b = _ranges(own[order[~first]], start[order[~first]])
        return pd.DataFrame({"id": i, "start": a.astype(np.int32), "stop": b.astype(np.int32)})

    return run


def _single_windows(length: int, buckets: int):
    """Documents (id, text, segs) to entries of their segments' windows, one by one, shard by shard."""

    def run(batches):
        for held in _shards(batches, SHARD_BYTES // 8):
            got = []
            for b in held:
                data, at = shared.buffers(b.column(1))
                own, segs = np.asarray(b.column(0), np.int64), b.column(2)
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(segs.offsets)))
                flat = segs.flatten()
                start, size = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("stop")) - np.asarray(flat.field("start"))
                row, first = np.repeat(row, size), np.repeat(start, size)
                w = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
                prefix = shared.prefix_hashes(data)
                h = shared.span_hashes(prefix, at[row] + w, at[row] + w + length)
                got.append((h, h, own[row], w, np.ones(len(h), np.int64)))
            cols = [np.concatenate(c) for c in zip(*got)]
            if len(cols[0]):
                yield from _sent(*cols, buckets, cols[0] >> U(9), int(cols[0][0] >> U(1)))

    return run


def repeated_ranges(keyed: DataFrame, length: int) -> DataFrame:
    """Of documents with unique ids (id, text): id, start, stop of window starts that also start earlier."""
    n_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(n_bytes * 2 / (length - ANCHOR + 2) / BUCKET_ANCHORS) + 1)
    sent = keyed.where(F.octet_length("text") >= length).mapInArrow(_anchors(length, buckets), _ENTRIES)
    found = shared.written(sent.groupBy("bucket").applyInPandas(_resolve(buckets, COMMON), _FOUND))
    left = F.collect_list(F.struct("start", "stop", "print")).alias("segs")
    with_text = lambda kind: keyed.join(found.where(F.col("kind") == kind).groupBy("id").agg(left), "id").select("id", "text", "segs")
    merged = with_text(2).mapInArrow(_transforms(length, buckets), "bucket long, bwt binary, ids binary, starts binary, sizes binary").groupBy("bucket").applyInPandas(_merge(length), "id long, start int, stop int")
    ranges = found.where("kind = 1").select("id", "start", "stop").unionByName(merged)
    if not found.where("kind = 3").isEmpty():
        single = with_text(3).mapInArrow(_single_windows(length, buckets), _ENTRIES).groupBy("bucket").applyInPandas(_resolve(buckets, COMMON), _FOUND)
        ranges = ranges.unionByName(single.where("kind = 1").select("id", "start", "stop"))
    return ranges


def _cut(length: int, keep_text: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def run(batches):
        for b in batches:
            data, at = shared.buffers(b.column(1))
            rows = []
            for r, (key, ranges) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                text = data[at[r] : at[r + 1]]
                removed = spans = 0
                if ranges.is_valid:
                    flat = ranges.values
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, np.asarray(flat.field("start")), 1)
                    np.add.at(edge, np.asarray(flat.field("stop")) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                left = text.tobytes()
                rows.append((key, int(at[r + 1] - at[r]), removed, spans, hashlib.sha256(left).hexdigest(), *[left] * keep_text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text)], names=names)

    return run


def dedup_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for every row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept (binary).

    A byte goes if a string of length bytes that covers it also starts earlier: in a row before, or earlier in the same
    row; strings never cross rows and are judged on the input. Rows are ordered by id, null ids first, those with one id
    by text; null texts are empty. Rows that repeat id and text are ordered too, so all but one of them lose all that is
    at least length bytes long. Texts shorter than length stay whole. An empty table gives an empty result. Other columns
    are not read. length: over 32.
    """
    shared.small_batches(docs.sparkSession)
    keyed = shared.texts(docs, id_col, text_col)
    back = None
    counts = keyed.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    if counts["rows"] != counts["ids"]:  # ids that repeat or are null: numbers in their order stand for them
        back = shared.written(keyed.orderBy(F.asc_nulls_first("id"), "text").withColumn("own", F.monotonically_increasing_id()))
        keyed = back.select(F.col("own").alias("id"), "text")
    ranges = repeated_ranges(keyed, length).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    out = keyed.join(ranges, "id", "left").select("id", "text", "ranges").mapInArrow(_cut(length, keep_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    if back is not None:
        out = out.withColumnRenamed("id", "own").join(back.select("own", "id"), "own").drop("own").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text)
    return out.withColumnRenamed("id", id_col)
