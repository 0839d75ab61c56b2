"""N-gram Jaccard join by prefixes of token combinations.

A document is the set of its word n-grams (tokens). Its sample is the first tokens by fingerprint, so many that samples of
linked sets share a known number of tokens. Buckets of tokens find those that two sets or more have, with their counts; a
set with fewer such tokens than a link needs is out. The others' shared tokens have one order over all documents: by
count, the frequent class last. A prefix in that order must hold a signature that linked sets share: a single token of
the rare class, or a pair of tokens of one subclass of the frequent class. The prefix ends where its rare tokens, plus its
frequent ones less one for each subclass, outnumber the tokens that may differ; so it extends a little where tokens are
frequent, and pairs stand for them there. Pairs depend on the sizes' band: a set writes those of its own band and of the
next, so that sets whose sizes allow a link have a band in common.

Sets that are equal are one node. Signatures go to buckets, packed; a bucket links each node to the first one with the
same signature. That happens twice: first for the few signatures of each node that have the least hash, which gives most
of a group of near copies one head, then for all signatures, where a node stands under its head, so that only links
between different heads are left. What all of them connect is a cluster.

Sets are compared exactly, also twice: first each node with the first node of its group, then, in clusters that this did
not make one class, nodes of different classes that share a signature. A cluster may be a long chain of chance meetings,
so it never meets as a whole. Where few nodes hold a signature, they meet as pairs: sizes and parities of the sets (one
bit for each cell that tokens fall in) rule most of them out, the sets of the others are compared. What signatures of many
nodes connect meets in blocks, by the sizes of intersections; a pair of blocks hands on only links that connect
something new. Neither pairs nor blocks of one class meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pantrygrid.llm import shared
from pantrygrid.llm.components import components, contracted

#: Bytes of text in a shard; rows that make a token frequent in a shard and overall, and the most that are so (the most frequent ones).
SHARD_BYTES, FREQUENT_IN_SHARD, FREQUENT, MOST_FREQUENT = 8 << 20, 8, 64, 1 << 17
#: Tokens of samples in a bucket; nodes in a block; bytes of sets in a bundle of blocks.
BUCKET_TOKENS, BLOCK_NODES, BUNDLE_BYTES = 400_000, 1000, 8 << 20
#: Signatures of a node in the first round; most nodes of a signature that meet as pairs.
FIRST, PAIRED = 3, 64
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
U = np.uint64
_STEP = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], U)


def word_prints(lower: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word. Words up to 8 bytes of one length never share one; up to 16 bytes both halves are scrambled in turn; longer words have a cryptographic one."""
    size = stop - start
    padded = np.append(lower, np.zeros(16, np.uint8))

    def half(k: int) -> np.ndarray:
        held = padded[np.minimum(start + k, len(lower))[:, None] + np.arange(8)]
        held[np.arange(k, k + 8) >= size[:, None]] = 0
        return np.ascontiguousarray(held).view(U)[:, 0]

    out = shared.mix(half(0) + size.astype(U) * U(0xA24BAED4963EE407))
    more = np.flatnonzero(size > 8)
    if len(more):
        start, size, stop = start[more], size[more], stop[more]
        out[more] = shared.mix(out[more] ^ shared.mix(half(8)))
        for i in np.flatnonzero(size > 16):
            out[more[i]] = int.from_bytes(hashlib.blake2b(lower[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram tokens (64-bit fingerprints) of the rows of a buffer, by row and in order, and their bounds."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, U), np.zeros(rows + 1, np.int64)
    lower, white = shared.lower_ascii(data), _WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(~white & (edge[:-1] | np.append(True, white[:-1])))
    stop = np.flatnonzero(~white & (edge[1:] | np.append(white[1:], True))) + 1
    word = word_prints(lower, start, stop)
    bounds = np.searchsorted(start, offsets)
    words = np.diff(bounds)
    m = max(len(word) - n + 1, 0)
    gram = np.zeros(m, U)
    for k in range(n):
        gram += word[k : k + m] * _STEP[k]
    row = np.repeat(np.arange(rows), words)
    whole = row[:m] == row[n - 1 : n - 1 + m]
    gram, owner = shared.mix(gram[whole]), row[:m][whole]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        few = [int(sum(int(w) * int(s) for w, s in zip(word[bounds[r] : bounds[r + 1]], _STEP)) + 0x51ED * int(words[r])) & (2**64 - 1) for r in short]
        gram, owner = np.concatenate([gram, shared.mix(np.array(few, U))]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    first = np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])) if len(gram) else np.empty(0, bool)
    gram, owner = gram[first], owner[first]
    return gram, np.searchsorted(owner, np.arange(rows + 1))


def nodes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set; 0 for an empty one."""
    total = np.zeros(len(tokens) + 1, U)
    np.cumsum(shared.mix(tokens ^ U(0xA5A5A5A5)), out=total[1:])
    size = np.diff(bounds)
    got = shared.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(U)) | U(1)
    return np.where(size > 0, got, U(0))


def _shards(batches):
    held, size = [], 0
    for b in batches:
        _, at = shared.buffers(b.column(1))
        for i, j in shared.slices(at):
            held.append(b.slice(i, j - i))
            size += int(at[j] - at[i])
            if size >= SHARD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sets_of(held, n: int):
    """(ids, tokens, bounds) of a shard's batches."""
    ids, tokens, sizes = [], [], []
    for b in held:
        data, at = shared.buffers(b.column(1))
        t, bounds = token_sets(data, at, n)
        ids.append(b.column(0))
        tokens.append(t)
        sizes.append(np.diff(bounds))
    return pa.chunked_array(ids).combine_chunks(), np.concatenate(tokens), np.append(0, np.cumsum(np.concatenate(sizes)))


def _survey(n: int):
    """Documents to (id, node, size) rows, and, with size null, the tokens that are frequent in a shard with their rows."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def run(batches):
        for held in _shards(batches):
            ids, tokens, bounds = _sets_of(held, n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes(tokens, bounds).view(np.int64)), pa.array(np.diff(bounds))], schema=schema)
            found, count = np.unique(tokens, return_counts=True)
            many = count >= FREQUENT_IN_SHARD
            yield pa.RecordBatch.from_arrays([pa.array(count[many].astype(np.int64)), pa.array(found[many].view(np.int64)), pa.nulls(int(many.sum()), pa.int64())], schema=schema)

    return run


def least_shared(size, percent: int):
    """The fewest tokens that a set of this size shares with any set that is similar enough."""
    return -(-size * percent // 100)


def in_sample(size):
    """The fewest tokens that a set's sample shares with that of a similar enough set whose sample does not reach further."""
    return np.maximum(size // 6, 1)


def sure(size, percent: int):
    """The fewest tokens that the samples of a set of at least this size and of any similar enough set share."""
    return in_sample(least_shared(size, percent))


def size_code(size: np.ndarray) -> np.ndarray:
    """Sizes as one byte, by sixths of a tenth; from_code gives the least size of a code."""
    return np.minimum(np.log(np.maximum(size, 1)) / np.log(1.06) + 1e-9, 255).astype(np.uint8)


def from_code(code: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(1.06 ** code.astype(float) - 1e-6), 1).astype(np.int64)


def band(size: int, percent: int) -> int:
    """Sizes of linked sets are in the same band or in neighbouring ones, also when taken from their codes."""
    return int(np.log(size) / np.log(1.13 * 100 / percent) + 1e-9)


def pair_signatures(frequent: list[int], missing: int, size: int, percent: int) -> list[int]:
    """Signatures of the frequent tokens (in order) of a set whose rare tokens fall short of its prefix by missing.

    The subclasses of a band are fewer than the tokens that its sets surely share; where those are too few for pairs, the
    band has single tokens.
    """
    out = []
    for b in (band(size, percent), band(size, percent) + 1):
        spare = int(sure(int((1.13 * 100 / percent) ** max(b - 1, 0)), percent)) - 1
        if not spare:
            out += [(t * 0xC2B2AE3D27D4EB4F + b) & (2**64 - 1) for t in frequent[:missing]]
            continue
        classes, have = max(1, spare // 3), 0
        held: dict[int, list[int]] = {}
        for t in frequent:
            own = held.setdefault((t >> 37) % classes, [])
            out += [(x * 0x9E3779B97F4A7C15 + t * 0xC2B2AE3D27D4EB4F + b) & (2**64 - 1) for x in own]
            have += bool(own)
            own.append(t)
            if have >= missing:
                break
    return out


_FIELDS = {"tokens": np.uint64, "nodes": np.uint64, "counts": np.uint16, "codes": np.uint8}
_PACKED = "bucket long, tokens binary, nodes binary, counts binary, codes binary"
#: The count of a token of the frequent class; the kind of the blocks that classes share.
OFTEN, _SHARED = 0xFFFF, -1


def _by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray], shift: int = 0) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    edge = np.append(at, len(order))
    cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())
    return pa.RecordBatch.from_pydict({"bucket": pa.array((found + shift).astype(np.int64))} | {k: cut(np.ascontiguousarray(v[order])) for k, v in columns.items()})


def _among(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens are in the sorted table frequent."""
    common = np.zeros(len(tokens), bool)
    if len(frequent):
        table = np.zeros(1 << 20, bool)
        table[(frequent >> U(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(tokens >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(frequent, tokens[maybe]), len(frequent) - 1)
        common[maybe] = frequent[at] == tokens[maybe]
    return common


def _sampled(n: int, percent: int, frequent: np.ndarray, buckets: int):
    """Documents to the samples of their sets, packed: rare tokens by bucket, frequent ones under buckets beyond. A shard sends equal sets once."""

    def run(batches):
        for held in _shards(batches):
            _, tokens, bounds = _sets_of(held, n)
            own, size = nodes(tokens, bounds), np.diff(bounds)
            first = np.zeros(len(own), bool)
            first[np.unique(own, return_index=True)[1]] = True
            length = np.where(first & (size > 1), size - least_shared(size, percent) + in_sample(size), 0)
            row = np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(tokens)) - bounds[row] < length[row]
            tokens, row = tokens[inside], row[inside]
            common, code = _among(tokens, frequent), size_code(size)
            bucket = (tokens % U(buckets)).astype(np.int64)
            for which, shift in ((~common, 0), (common, buckets)):
                if which.any():
                    t = tokens[which]
                    packed = (t >> U(32)).astype(np.uint32) if not shift else t
                    yield _by_bucket(bucket[which], {"tokens": packed, "nodes": own[row[which]], "counts": np.empty((len(t), 0), np.uint16), "codes": code[row[which]]}, shift)

    return run


def _shared_tokens(buckets: int, node_buckets: int):
    """One bucket's tokens to those that two nodes or more have, with the number of nodes, packed by bucket of the node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, kind = int(pdf["bucket"].iloc[0]), np.uint32 if pdf["bucket"].iloc[0] < buckets else np.uint64
        token, node, code = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("tokens", kind), ("nodes", U), ("codes", np.uint8)))
        if k < buckets:
            order = np.lexsort((node, token))
            token, node, code = token[order], node[order], code[order]
            new = np.append(True, token[1:] != token[:-1])
            keep = new | np.append(True, node[1:] != node[:-1])
            token, node, code, new = token[keep], node[keep], code[keep], new[keep]
            count = np.diff(np.append(np.flatnonzero(new), len(new)))
            count = np.repeat(count, count)
            keep = count > 1
            token, node, code, count = (token[keep].astype(U) << U(32)) | U(k), node[keep], code[keep], np.minimum(count[keep], OFTEN - 1).astype(np.uint16)
        else:
            count = np.full(len(token), OFTEN, np.uint16)
        return _by_bucket(node.view(np.int64) % node_buckets, {"tokens": token, "nodes": node, "counts": count, "codes": code}).to_pandas()

    return run


def _signed(percent: int, buckets: int):
    """The shared tokens of one bucket of nodes to the nodes' signatures: all under the bucket, and the first ones by bucket of the signature, beyond.

    A node goes if it has fewer shared tokens than its sample surely shares with a linked one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        token, node, count, code = (np.frombuffer(b"".join(pdf[c]), t) for c, t in _FIELDS.items())
        order = np.lexsort((token, count, node))
        token, node, count, code = token[order], node[order], count[order], code[order]
        again = np.append(False, (node[1:] == node[:-1]) & (token[1:] == token[:-1]))  # a frequent token, from several shards
        token, node, count, code = token[~again], node[~again], count[~again], code[~again]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        length = np.diff(np.append(first, len(node)))
        size = from_code(code[first])
        need = length - sure(size, percent) + 1
        often = count == OFTEN
        rank = np.arange(len(node)) - np.repeat(first, length)
        single = ~often & (rank < np.repeat(need, length))
        rare = np.add.reduceat(~often, first) if len(first) else np.empty(0, np.int64)
        sigs, owners = [shared.mix(token[single])], [node[single]]
        for r in np.flatnonzero(need > rare).tolist():
            if need[r] > 0:
                got = pair_signatures(token[first[r] + rare[r] : first[r] + length[r]].tolist(), int(need[r] - rare[r]), int(size[r]), percent)
                sigs.append(shared.mix(np.array(got, U)))
                owners.append(np.full(len(got), node[first[r]]))
        sig, node = np.concatenate(sigs), np.concatenate(owners)
        order = np.lexsort((sig, node))
        rank = np.arange(len(order)) - np.searchsorted(node[order], node[order])
        few = order[rank < FIRST]
        whole = _by_bucket(np.full(len(sig), int(pdf["bucket"].iloc[0])), {"signatures": sig, "nodes": node})
        return pd.concat([whole.to_pandas(), _by_bucket((sig[few] % U(buckets)).astype(np.int64), {"signatures": sig[few], "nodes": node[few]}, buckets).to_pandas()])

    return run


def _regrouped(buckets: int):
    """All signatures of one bucket of nodes, and the nodes' heads, to the signatures of the heads (of a node without one, its own), packed by bucket of the signature."""

    def run(pdf: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        sig, node = np.frombuffer(b"".join(pdf["signatures"]), U), np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        groups = groups.sort_values("node")
        known, group = groups["node"].to_numpy(), groups["head"].to_numpy()
        if len(known):
            at = np.minimum(np.searchsorted(known, node), len(known) - 1)
            node = np.where(known[at] == node, group[at], node)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])) if len(sig) else np.empty(0, bool)
        sig, node = sig[new], node[new]
        return _by_bucket((sig % U(buckets)).astype(np.int64), {"signatures": sig, "nodes": node}).to_pandas()

    return run


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from each node of a bucket to the least node with the same signature."""
    sig, node = np.frombuffer(b"".join(pdf["signatures"]), U), np.frombuffer(b"".join(pdf["nodes"]), np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.append(True, sig[1:] != sig[:-1])
    head = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
    link = head != node
    return pd.DataFrame(np.unique(np.stack([head[link], node[link]], axis=1), axis=0), columns=["a", "b"])


def _still_apart(buckets: int):
    """All signatures of one bucket of nodes, and the nodes (class, size) whose clusters have several classes, to the signatures of those nodes, packed by bucket of the signature."""

    def run(pdf: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        sig, node = np.frombuffer(b"".join(pdf["signatures"]), U), np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        nodes = nodes.sort_values("node")
        known = nodes["node"].to_numpy(np.int64)
        at = np.searchsorted(known, node)
        keep = np.append(known, 0)[at] == node if len(known) else np.zeros(len(node), bool)
        keep &= at < len(known)
        sig, node, at = sig[keep], node[keep], at[keep]
        columns = {"signatures": sig, "nodes": node, "classes": nodes["class"].to_numpy(np.int64)[at], "sizes": nodes["size"].to_numpy(np.int64)[at]}
        return _by_bucket((sig % U(buckets)).astype(np.int64), columns).to_pandas()

    return run


def _meetings(percent: int):
    """The nodes of different classes in one bucket that share a signature: as pairs whose sizes allow a link where PAIRED nodes or fewer hold it, else (many) as links from the first of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, node, kind, size = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("signatures", U), ("nodes", np.int64), ("classes", np.int64), ("sizes", np.int64)))
        order = np.lexsort((node, sig))
        order = order[np.append(True, (sig[order][1:] != sig[order][:-1]) | (node[order][1:] != node[order][:-1]))]
        sig, node, kind, size = sig[order], node[order], kind[order], size[order]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(first, len(sig)))
        apart = np.minimum.reduceat(kind, first) != np.maximum.reduceat(kind, first)
        head = np.repeat(node[first], count)
        many = np.repeat(apart & (count > PAIRED), count) & (node != head)
        wide = np.unique(np.stack([head[many], node[many]], axis=1), axis=0)
        few = np.repeat(apart & (count <= PAIRED), count)
        sig, node, kind, size = sig[few], node[few], kind[few], size[few]
        pairs = [np.empty((0, 2), np.int64)]
        for d in range(1, PAIRED):
            i = np.flatnonzero(sig[d:] == sig[:-d])
            if not len(i):
                break
            i = i[(kind[i] != kind[i + d]) & (100 * np.minimum(size[i], size[i + d]) >= percent * np.maximum(size[i], size[i + d]))]
            pairs.append(np.stack([node[i], node[i + d]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        out = pd.DataFrame(np.concatenate([pairs, wide]), columns=["a", "b"])
        return out.assign(many=np.arange(len(out)) >= len(pairs))

    return run


def parities(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set one bit for each of twice as many cells or more (a power of two): whether an odd number of its tokens falls in it."""
    size = np.diff(bounds)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    at = np.append(0, np.cumsum(cells))
    place = np.repeat(at[:-1], size) + (tokens & np.repeat(cells - 1, size).astype(U)).astype(np.int64)
    bits = np.packbits(np.bincount(place, minlength=at[-1]).astype(np.uint8) & 1, bitorder="little")
    return [bits[i:j].tobytes() for i, j in zip(at[:-1] // 8, at[1:] // 8)]


def may_link(one: list[bytes], other: list[bytes], total: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets with these parities and sums of sizes may be linked: cells whose parity differs hold a token of one set alone."""
    out = np.zeros(len(total), bool)
    sizes = pd.DataFrame({"x": [len(v) for v in one], "y": [len(v) for v in other]})
    for (x, y), at in sizes.groupby(["x", "y"]).indices.items():
        least = min(x, y)
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(v[i] for i in at), np.uint8).reshape(len(at), -1, least), axis=1) for v in (one, other)]
        differ = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
        out[at] = differ * (100 + percent) <= total[at] * (100 - percent)
    return out


def _likely(percent: int):
    def run(batches):
        for pdf in batches:
            yield pdf.loc[may_link(pdf["x"].tolist(), pdf["y"].tolist(), pdf["total"].to_numpy(), percent), ["a", "b"]]

    return run


def linked(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets: (i, j) whose intersection is percent of the union or more.

    known: of each set the first one that it is known to be connected with.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 24:
        pairs = [(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for i in range(m) for j in range(i + 1, m) if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j])]
    else:
        pairs = _dense(sets, size, percent)
    parent = list(known or range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j, both in pairs:
        if 100 * both >= percent * (size[i] + size[j] - both) and (a := root(i)) != (b := root(j)):
            parent[b] = a
            out.append((i, j))
    return out


def _dense(sets, size, percent):
    """The similar enough pairs of many sets, by products of 0/1 matrices over the tokens that two or more hold."""
    m, owner = len(sets), np.repeat(np.arange(len(sets)), size)
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    keep = count[token] > 1
    name = np.cumsum(count > 1) - 1
    token, owner, wide = name[token[keep]], owner[keep], int((count > 1).sum())
    both = np.zeros((m, m), np.float32)
    for a in range(0, wide, 4096):
        part = (token >= a) & (token < a + 4096)
        x = np.zeros((m, min(4096, wide - a)), np.float32)
        x[owner[part], token[part] - a] = 1
        both += x @ x.T
    i, j = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))
    return zip(i.tolist(), j.tolist(), both[i, j].astype(np.int64).tolist())


def _head_verified(percent: int):
    """Sets of nodes under their head (the row whose node is the head has its set) to the links between the two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (head, _), part in pdf.groupby(["head", "part"], sort=False):
            own = (part["node"] == head).to_numpy()
            one = np.frombuffer(part["tokens"][own].iloc[0], U)
            rest = part[~own]
            size = rest["tokens"].str.len().to_numpy() // 8
            tokens = np.frombuffer(b"".join(rest["tokens"]), U)
            same = one[np.minimum(np.searchsorted(one, tokens), len(one) - 1)] == tokens
            total = np.append(0, np.cumsum(same))
            stop = np.cumsum(size)
            both = total[stop] - total[stop - size]
            out.append(rest["node"].to_numpy()[100 * both >= percent * (size + len(one) - both)])
            out.append(np.full(len(out[-1]), head))
        return pd.DataFrame({"a": np.concatenate(out[1::2] or [[]]).astype(np.int64), "b": np.concatenate(out[::2] or [[]]).astype(np.int64)})

    return run


def _verified(percent: int):
    """Pairs of blocks to links between the classes of their nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["cluster", "i", "j"], sort=False):
            part = part.drop_duplicates("node").sort_values("node")
            kind = part["class"].to_numpy()
            first = np.unique(kind, return_index=True, return_inverse=True)
            known = first[1][first[2]].tolist()
            out += [(kind[a], kind[b]) for a, b in linked([np.frombuffer(s, U) for s in part["tokens"]], percent, known)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _token_rows(n: int):
    def run(batches):
        for b in batches:
            data, at = shared.buffers(b.column("text"))
            t, bounds = token_sets(data, at, n)
            sets = pa.array([t[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(bounds)), pa.array(parities(t, bounds), pa.binary()), sets], names=["node", "size", "parity", "tokens"])

    return run


def _frequent_tokens(survey: DataFrame) -> np.ndarray:
    """The frequent class, sorted: MOST_FREQUENT tokens at most, so its size is bounded."""
    counts = survey.where("size is null").groupBy("node").agg(F.sum("id").alias("n")).where(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "node").limit(MOST_FREQUENT).select("node").toArrow()
    return np.sort(np.asarray(got["node"]).view(U))


def _bundle(bundles: int, *key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bundles))


def _blocks(nodes: DataFrame) -> DataFrame:
    """node, cluster, class of clusters with several classes to node, cluster, class, i, j: the pairs of blocks that a node is in.

    A class of BLOCK_NODES or more has blocks of its own, which never meet one another; the others of a cluster share
    some. Blocks have numbers in their cluster.
    """
    sizes = nodes.groupBy("cluster", "class").agg(F.count("*").alias("n"))
    large = F.col("n") >= BLOCK_NODES
    sizes = sizes.withColumn("own", F.when(large, F.col("class")))
    kinds = sizes.groupBy("cluster", "own").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK_NODES)).cast("int"))
    before = Window.partitionBy("cluster").orderBy(F.asc_nulls_first("own")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"))
    spans = kinds.groupBy("cluster").agg(F.sum("blocks").cast("int").alias("all"))
    placed = kinds.join(spans, "cluster")
    dealt = nodes.join(sizes.select("cluster", "class", "own"), ["cluster", "class"]).withColumn("own", F.coalesce("own", F.lit(_SHARED)))
    dealt = dealt.join(placed.select("cluster", F.coalesce("own", F.lit(_SHARED)).alias("own"), "blocks", "first", "all"), ["cluster", "own"])
    block = (F.col("first") + F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.col("all") - 1)
    same = lambda x: (F.col("own") != _SHARED) & (x >= F.col("first")) & (x < F.col("first") + F.col("blocks"))
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.filter(others, lambda x: ~same(x))))
    return dealt.select("node", "cluster", "class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _by_head(sets: DataFrame, heads: DataFrame, bundles: int, percent: int) -> DataFrame:
    """a, b: the links between nodes and their heads (node, head; a node may have several)."""
    parts = heads.groupBy("head").agg(F.ceil(F.count("*") / F.lit(BLOCK_NODES)).cast("int").alias("parts"))
    follow = heads.join(parts, "head").select("node", "head", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part"))
    lead = parts.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    meeting = sets.select("node", "tokens").join(follow.unionByName(lead).hint("merge"), "node").withColumn("bundle", _bundle(bundles, "head", "part"))
    return meeting.groupBy("bundle").applyInPandas(_head_verified(percent), "a long, b long")


def _links(own: DataFrame, known: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """node, component of the nodes that links connect with others."""
    total = known.agg(F.sum("size").alias("n")).first()["n"] or 0
    buckets = max(8, total * (116 - percent) // 100 // BUCKET_TOKENS + 1)
    sample = own.mapInArrow(_sampled(n, percent, frequent, buckets), _PACKED)
    tokens = sample.groupBy("bucket").applyInPandas(_shared_tokens(buckets, buckets), _PACKED)
    signatures = "bucket long, signatures binary, nodes binary"
    signed = shared.written(tokens.groupBy("bucket").applyInPandas(_signed(percent, buckets), signatures))
    first = signed.where(F.col("bucket") >= buckets).groupBy("bucket").applyInPandas(_candidates, "a long, b long")
    heads = shared.written(first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("head")))
    by_bucket = heads.withColumn("bucket", F.pmod("node", F.lit(buckets))).groupBy("bucket")
    regrouped = signed.where(F.col("bucket") < buckets).groupBy("bucket").cogroup(by_bucket).applyInPandas(_regrouped(buckets), signatures)
    between = regrouped.groupBy("bucket").applyInPandas(_candidates, "a long, b long")
    clusters = components(heads.select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(between))

    which = known.where("size > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("size").alias("size")).where("id is not null")
    chosen = shared.written(clusters.join(which, "node").select("id", "node", "size", F.col("component").alias("cluster")))
    size = chosen.agg(F.sum("size").alias("n")).first()["n"] or 0
    bundles = max(8, int(size * 8 / BUNDLE_BYTES) + 1)
    sets = shared.written(own.join(chosen.hint("merge"), "id").select("text", "node").mapInArrow(_token_rows(n), "node long, size long, parity binary, tokens binary"))

    # Every node with its head.
    near = shared.written(_by_head(sets, heads, bundles, percent))
    classes = components(near)

    # What is still apart in a cluster.
    nodes = chosen.select("node", "cluster", "size").join(classes, "node", "left").select("node", "cluster", "size", F.coalesce("component", "node").alias("class"))
    several = nodes.groupBy("cluster").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("cluster")
    apart = shared.written(nodes.join(several, "cluster").select("node", "class", "size", F.pmod("node", F.lit(buckets)).alias("bucket")))
    held = signed.where(F.col("bucket") < buckets).groupBy("bucket").cogroup(apart.groupBy("bucket")).applyInPandas(_still_apart(buckets), "bucket long, signatures binary, nodes binary, classes binary, sizes binary")
    meet = shared.written(held.groupBy("bucket").applyInPandas(_meetings(percent), "a long, b long, many boolean").distinct())
    parity = lambda node, x: sets.select(F.col("node").alias(node), F.col("size").alias(f"{x}_size"), F.col("parity").alias(x))
    pairs = meet.where("not many").join(parity("a", "x").hint("merge"), "a").join(parity("b", "y").hint("merge"), "b").select("a", "b", "x", "y", (F.col("x_size") + F.col("y_size")).alias("total"))
    likely = shared.written(pairs.mapInPandas(_likely(percent), "a long, b long").select(F.col("a").alias("head"), F.col("b").alias("node")))
    kind = lambda node, x: apart.select(F.col("node").alias(node), F.col("class").alias(x))
    links = shared.written(_by_head(sets, likely, bundles, percent))
    links = shared.written(links.join(kind("a", "x"), "a").join(kind("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = components(meet.where("many").select("a", "b")).withColumnRenamed("component", "cluster").join(apart, "node")
    dealt = shared.written(_blocks(shared.written(groups.select("node", "cluster", "class"))))
    blocks = sets.select("node", "tokens").join(dealt.hint("merge"), "node").withColumn("bundle", _bundle(bundles, "cluster", "i", "j"))
    return contracted(classes, links.unionByName(blocks.groupBy("bundle").applyInPandas(_verified(percent), "a long, b long")))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: id_col, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of n words, or all words as one
    where there are fewer. Two rows are linked when their intersection is percent of their union or more; component_id is
    the smallest id that links reach, the row's own included. Rows with equal sets are linked; rows without words are
    linked with nothing. Null texts are empty. Null ids count as missing: a component of such rows only has a null id.
    Rows that repeat an id are separate. An empty table gives an empty result. Other columns are not read.
    """
    shared.small_batches(docs.sparkSession)
    own = shared.texts(docs, id_col, text_col)
    survey = shared.written(own.mapInArrow(_survey(n), "id long, node long, size long"))
    known = survey.where("size is not null")
    frequent = _frequent_tokens(survey)
    if known.where("size > 0 and id is not null").groupBy("id").count().where("count > 1").isEmpty() and known.where("id is null").isEmpty():
        joined = _links(own, known, frequent, n, percent)
    else:  # ids that repeat or are null: numbers stand for them, in written order
        numbered = shared.written(own.select(F.monotonically_increasing_id().alias("id"), "text"))
        joined = _links(numbered, numbered.mapInArrow(_survey(n), "id long, node long, size long").where("size is not null"), frequent, n, percent)
    least = known.where("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    labelled = shared.written(least.join(shared.written(joined), "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = shared.written(labelled.join(ids, "component").select("node", "component_id"))
    out = known.join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
