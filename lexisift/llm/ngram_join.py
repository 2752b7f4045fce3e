"""N-gram Jaccard join: documents link when their word-shingle sets have a Jaccard similarity of at least a threshold.

1. Each document's set is hashed; documents with equal sets are one class from there on, whatever their number. Classes,
   by 128 bits of their sets, are the nodes of all that follows; the smallest doc_id of a component is found at the end.
2. Candidates. A class has a prefix: its rarest shingles, as many as it could lack and still be similar. Two similar
   classes share a shingle of their prefixes. How many classes hold a shingle is counted over the whole corpus; shingles
   of one class alone fill most prefixes, so unlike documents send nothing on. Classes that share a prefix shingle and
   whose sizes allow a link are in one candidate group, by connected components. No shingle's classes meet in one task:
   frequent shingles (``FREQUENT``) go to their classes at once, as the last of all, and the classes of a prefix shingle
   are chained bucket by bucket, each chain going on as its two ends.
3. Signature trees. Each group builds a tree: a node holds the OR of its documents' token bitmaps and the range of
   their sizes. Pairs of nodes are walked together, nearest first; a pair is left where the sizes or the largest
   overlap that the bitmaps allow rule out a link, or where both nodes lie in one component already. What is left is
   verified on the sets. Groups larger than ``BLOCK`` are dealt out in blocks, each with one pivot of the group;
   documents not in the group's main component afterwards are then held against all blocks. All links between different
   components are found; those inside a component are not all listed.

Shingles have 64 bits. Two sets are compared by them, so an error needs a collision within one pair, not within the corpus.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer
words than a shingle has is one shingle; rows without a doc_id link with nothing and have no component; rows of one
doc_id with different texts are different documents of that id; a doc_id that is no whole number is a TypeError; an empty
table gives an empty result. A text is held with about 40 times its length. Columns besides doc_id and text pass through
``one_of_each``, except that names beginning with ``__join_`` are its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import partitions_for, slices, staged, utf8
from lexisift.llm.components import components, forest
from lexisift.llm.suffix_dedup import _by_bucket, _pack, _rows, _unpack
from lexisift.llm.vectext import LOWER, mix, word_hash, words

SIZE, PERCENT = 5, 75
BLOCK = 1024
_FLUSH = 2 << 20
_SALT = np.random.default_rng(41).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = 4096


def sets(raw: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[raw]
    start, end, row = words(low, offsets)
    n = len(offsets) - 1
    if not len(start):
        return [np.zeros(0, np.uint64)] * n
    word = word_hash(low, start, end)
    edge = np.searchsorted(row, np.arange(n + 1))
    full = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        full += word[k : k + len(full)] * _SALT[k]
    full = mix(full)
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _SALT[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(own: np.ndarray) -> tuple[int, int]:
    return int(mix(own ^ _SALT[8]).sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ _SALT[9]).sum(dtype=np.uint64).view(np.int64))


def _each(batch, size):
    """(index, set) of each row of a batch."""
    raw, offsets = utf8(batch.column("text"))
    for a, b in slices(offsets):
        yield from zip(range(a, b), sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size), strict=True)


#: Classes that hold a shingle from which it counts as frequent, at every size of the corpus; and how many of these shingles
#: all tasks hear of before, the others being noticed by their own bucket.
FREQUENT, KNOWN_FREQUENT = 8192, 1 << 20
_LOT = 1 << 22
_ROW, _REPORT = 0, 1
_NODE = "struct<d1:bigint,d2:bigint>"


def _digests(size: int, flush: int):
    """Rows (doc_id, n, d1, d2), and reports (n, blob) of the shingles that many sets of one flush hold."""

    def run(batches):
        held, seen, total = [], set(), 0
        for batch in batches:
            rows = []
            for _, own in _each(batch, size):
                rows.append((len(own), *_digest(own)))
                if rows[-1][1:] not in seen and len(own):
                    seen.add(rows[-1][1:])
                    held.append(own)
                    total += len(own)
                    if total >= flush:
                        yield from report(held)
                        held, seen, total = [], set(), 0
            n, d1, d2 = list(zip(*rows, strict=True)) or [(), (), ()]
            m = batch.num_rows
            yield out(_ROW, batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(m, pa.binary()))
        if held:
            yield from report(held)

    def report(held):
        token = np.concatenate(held)
        held.clear()
        token.sort()
        often = np.unique(token[31:][token[31:] == token[:-31]])
        if len(often):
            count = np.searchsorted(token, often, "right") - np.searchsorted(token, often)
            lots = list(_by_bucket(_bucket(often, 64), 64))
            z = pa.nulls(len(lots), pa.int64())
            yield out(_REPORT, z, z, pa.array([b for b, _ in lots], pa.int64()), z, z, pa.array([_pack(often[i], count[i]) for _, i in lots], pa.binary()))

    def out(kind, *columns):
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind] * len(columns[0]), pa.int32())], ["doc_id", "text_key", "n", "d1", "d2", "blob", "kind"])

    return run


def digested(docs: DataFrame, size: int = SIZE, flush: int = _FLUSH) -> DataFrame:
    """(doc_id, n, d1, d2, blob, kind): the size of each document's set and 128 bits of its content; among them reports."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text")).mapInArrow(_digests(size, flush), "doc_id long, text_key long, n long, d1 long, d2 long, blob binary, kind int")


def frequent_shingles(digests: DataFrame, least: int) -> np.ndarray:
    """The sorted shingles that ``least`` reported sets or more hold. With least at a 2**20th of all shingles there are 2**20 at
    most. A shingle missed, as its sets lie far apart, is noticed by its bucket."""

    def run(batches):
        got = [_unpack(x, np.uint64, np.int64) for batch in batches for x in batch.column("blob").to_pylist()]
        if got:
            token, count = (np.concatenate(x) for x in zip(*got, strict=True))
            token, back = np.unique(token, return_inverse=True)
            often = token[np.bincount(back, count) >= least]
            if len(often):
                yield pa.RecordBatch.from_arrays([pa.array([often.tobytes()], pa.binary())], ["blob"])

    reports = digests.where(F.col("kind") == _REPORT).select(F.col("n").alias("bucket"), "blob")
    found = reports.repartition("bucket").select("blob").mapInArrow(run, "blob binary")
    rows = [np.frombuffer(bytes(r["blob"]), np.uint64) for r in found.collect()]  # 8 MB at most, by one job
    return np.sort(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


_FAR = 255
_SHINGLE, _OWN, _CHAIN, _LINK = range(4)


def _shingle_rows(buckets: int, size: int, frequent, flush_at: int = _FLUSH, bits: int = 32):
    """(kind, bucket, blob): the shingles of many classes; copies within a flush send theirs once. Frequent shingles are
    known to be shared and to come last, so they go to their classes, not to a bucket of their own."""
    low = np.uint64((1 << bits) - 1)

    def run(batches):
        held, names, total = [], {}, 0
        for batch in batches:
            for _, own in _each(batch, size):
                if not len(own):
                    continue
                key = _digest(own)[0]
                if key in names:
                    continue
                names[key] = len(own)
                held.append(own)
                total += len(own)
                if total >= flush_at:
                    yield from flush(held, names)
                    held, names, total = [], {}, 0
        if held:
            yield from flush(held, names)

    def flush(held, names):
        """Rows of one flush; each column is held once, and ``held`` no longer than needed."""
        d1, n = np.fromiter(names, np.int64, len(names)), np.fromiter(names.values(), np.int64, len(names))
        doc = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        token = np.concatenate(held)
        held.clear()
        known = _bucket(token, buckets)
        known <<= np.int64(32)
        token &= low
        known |= token.view(np.int64)
        del token
        order = np.argsort(known, kind="stable")  # by bucket and number, of one number in the order of the classes
        known, doc = known[order], doc[order]
        del order
        # by number, a class once for each; counts what falls together
        same = (known[1:] == known[:-1]) & (doc[1:] == doc[:-1])
        lost = np.bincount(doc[1:][same], minlength=len(d1))
        if same.any():
            once = np.concatenate([[True], ~same])
            known, doc = known[once], doc[once]
        often = frequent.value
        if len(often):  # by number: another shingle of that number counts as frequent too, for all classes alike
            often = np.unique(_bucket(often, buckets) << np.int64(32) | (often & low).astype(np.int64))
            hot = often[np.minimum(np.searchsorted(often, known), len(often) - 1)] == known
            if hot.any():
                its = doc[hot]
                yield _owned(known[hot], d1[its], n[its], lost[its], np.full(len(its), _FAR, np.uint8), buckets)
                known, doc = known[~hot], doc[~hot]
        edge = np.searchsorted(known, np.arange(buckets + 1, dtype=np.int64) << np.int64(32))
        out, blobs = np.flatnonzero(np.diff(edge)).tolist(), []
        for b in out:
            short = (known[edge[b] : edge[b + 1]] & np.int64(0xFFFFFFFF)).astype(np.uint32)
            used, back = np.unique(doc[edge[b] : edge[b + 1]], return_inverse=True)
            delta = np.diff(short, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
            back = back.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
            blobs.append(_pack(d1[used], n[used], lost[used], np.ascontiguousarray(delta), np.ascontiguousarray(back)))
        yield _rows(_SHINGLE, out, blobs)

    return run


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    out = token >> np.uint64(32)
    out %= np.uint64(buckets)
    return out.view(np.int64)


def _planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel()


def _repeated(token: np.ndarray) -> np.ndarray:
    """Whether another row has the same number."""
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    out = np.zeros(len(token), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _owned(token, d1, n, lost, rare, buckets: int) -> pa.RecordBatch:
    """Shared shingles, dealt out by class."""
    names, blobs = [], []
    for b, i in _by_bucket((mix(d1.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets):
        names.append(b)
        blobs.append(_pack(token[i], d1[i], n[i], lost[i], rare[i]))
    return _rows(_OWN, names, blobs)


def _shared(buckets: int, frequent: int = FREQUENT, lot: int = _LOT):
    """Of a bucket's shingles those that two classes or more hold, dealt out by class; those already dealt out pass.

    In a bucket a shingle is known by 32 bits; buckets grow in number with the data. Different shingles that are known by
    one number count as one, for all classes alike: groups may grow by that, but no link is lost, as ``_prefixes`` says.
    Whenever ``lot`` rows have come, a shingle with ``frequent`` of them is found to be frequent: it comes last for all its
    classes, which are dealt out as they come, so that no more rows of it are held.
    """

    def run(batches):
        got, size, most, over = [], 0, lot, np.zeros(0, np.int64)
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                if kind == _OWN:
                    yield _rows(_OWN, [bucket], [blob])
                    continue
                got.append((bucket, _unpack(blob, np.int64, np.int64, np.int64, np.uint8, np.uint8)))
                size += len(got[-1][1][4]) // 4
                if size >= most:
                    token, count = np.unique(np.concatenate([tokens(*g) for g in got]), return_counts=True)
                    over = np.union1d(over, token[count >= frequent])
                    got = yield from shed(got, over)
                    size = len(got[0][1][0])
                    most = max(lot, 2 * size)
        if got:
            yield from ranked(*(yield from shed(got, over, last=True))[0][1])

    def tokens(bucket, rows):
        return rows[0] if bucket is None else np.cumsum(_planes(rows[3]), dtype=np.uint32).astype(np.int64) | np.int64(bucket) << np.int64(32)

    def shed(got, over, last=False):
        """What is left of the rows, laid out; rows that come are packed, and laid out here alone. The last time only rows
        whose shingle another row has are: most have none."""
        token = np.concatenate([tokens(*g) for g in got])
        stays = np.ones(len(token), bool)
        if len(over):
            goes = np.isin(token, over)
            if goes.any():
                yield _owned(token[goes], *columns(got, goes), np.full(int(goes.sum()), _FAR, np.uint8), buckets)
            stays = ~goes
        if last:
            stays &= _repeated(token)
        left = (token[stays], *columns(got, stays))
        got.clear()
        return [(None, left)]

    def columns(got, which):
        """d1, n and lost of these rows."""
        out, a = ([], [], []), 0
        for bucket, rows in got:
            mask = which[a : a + (len(rows[0]) if bucket is None else len(rows[4]) // 4)]
            a += len(mask)
            at = None if bucket is None else _planes(rows[4])[mask]
            for k in range(3):
                out[k].append(rows[k + 1][mask] if at is None else rows[k][at])
        return [np.concatenate(x) for x in out]

    def ranked(token, d1, n, lost):
        if not len(token):
            return
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = order[np.lexsort((d1[order], token[order]))]
        token, d1, n, lost = token[order], d1[order], n[order], lost[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (d1[1:] != d1[:-1])
        token, d1, n, lost = token[new], d1[new], n[new], lost[new]  # a class counts once
        if not len(token):
            return
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(edge, len(token)))
        held = np.repeat(count, count)
        more = held > 1
        rare = np.minimum(np.floor(np.log2(held[more]) * 8), _FAR - 1).astype(np.uint8)
        if len(rare):
            yield _owned(token[more], d1[more], n[more], lost[more], rare, buckets)

    return run


def _prefixes(buckets: int, percent: int):
    """Of each class the shared shingles of its prefix, and the classes that meet by one of them.

    A class of n shingles that shares k of them with a similar one has k >= ``_least_shared``(n). Where ``lost`` of its
    shingles are known by the number of another one, at least k - lost of the n - lost numbers are shared, so that of any
    n - k + 1 numbers one is: the prefix has the length that it has without such losses.

    The classes that hold a shingle in their prefixes are chained by size, but not across a step that allows no link. Here
    this is done for the classes of one bucket; a chain goes on as its two ends, and the links inside it as a forest.
    """

    def run(batches):
        got = [_unpack(x, np.int64, np.int64, np.int64, np.int64, np.uint8) for batch in batches for x in batch.column("blob").to_pylist()]
        if not got:
            return
        token, d1, n, lost, rare = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((token, rare, d1))
        token, d1, n, lost = token[order], d1[order], n[order], lost[order]
        new = np.ones(len(d1), bool)
        new[1:] = (token[1:] != token[:-1]) | (d1[1:] != d1[:-1])
        token, d1, n, lost = token[new], d1[new], n[new], lost[new]  # frequent ones come once a flush
        edge = np.flatnonzero(np.concatenate([[True], d1[1:] != d1[:-1]]))
        count = np.diff(np.append(edge, len(d1)))
        # the shingles that no other class holds come first; the rest of the prefix is shared
        rest = (n - _least_shared(n, percent) + 1) - (n - lost - np.repeat(count, count))
        keep = np.arange(len(d1)) - np.repeat(edge, count) < rest
        token, d1, n = token[keep], d1[keep], n[keep]
        if not len(token):
            return
        order = np.lexsort((d1, n, token))
        token, d1, n = token[order], d1[order], n[order]
        near = (token[1:] == token[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
        if near.any():
            yield _linked(d1[:-1][near], d1[1:][near], buckets)
        first = np.flatnonzero(np.concatenate([[True], ~near]))
        last = np.append(first[1:], len(token)) - 1
        token, name, low, high = token[first], d1[first], n[first], n[last]
        names, blobs = [], []
        for b, i in _by_bucket((mix(token.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets):
            names.append(b)
            blobs.append(_pack(token[i], name[i], low[i], high[i]))
        yield _rows(_CHAIN, names, blobs)

    return run


def _linked(a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    a, b = forest(a, b)
    names, blobs = [], []
    for bucket, i in _by_bucket((mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets):
        names.append(bucket)
        blobs.append(_pack(a[i], b[i]))
    return _rows(_LINK, names, blobs)


def _meetings(percent: int):
    """Links (a, b) with the components of all chains: chains of one shingle join where their sizes overlap or the step
    between them allows a link. A task sends on a forest."""

    def run(batches):
        chains, links = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if kind == _LINK:
                    links.append(_unpack(blob, np.int64, np.int64))
                else:
                    chains.append(_unpack(blob, np.int64, np.int64, np.int64, np.int64))
        if chains:
            token, name, low, high = (np.concatenate(x) for x in zip(*chains, strict=True))
            order = np.lexsort((name, high, low, token))
            token, name, low, high = token[order], name[order], low[order], high[order]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            group = np.cumsum(first) - 1
            top = int(high.max()) + 1
            reach = np.maximum.accumulate(group * top + high) - group * top  # the largest size so far, of one shingle
            near = ~first[1:] & (reach[:-1] * 100 >= low[1:] * percent)
            links.append((name[:-1][near], name[1:][near]))
        if links:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*pairs)], ["a", "b"])

    return run


def candidate_groups(docs: DataFrame, size: int, percent: int, frequent, buckets: int, bits: int = 32) -> DataFrame:
    """(d1, component): the classes that may link with another, by groups outside which they can't."""
    blob = "kind int, bucket int, blob binary"
    deal = lambda df: df.repartitionById(buckets, F.col("bucket"))
    held = deal(docs.select("text").mapInArrow(_shingle_rows(buckets, size, frequent, bits=bits), blob))
    shared = deal(held.mapInArrow(_shared(buckets, FREQUENT, _LOT), blob))
    prefixes = deal(shared.mapInArrow(_prefixes(buckets, percent), blob))
    meetings = prefixes.mapInArrow(_meetings(percent), "a long, b long")
    return components(meetings, "a", "b").withColumnRenamed("node", "d1")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


class SignatureTree:
    """Documents of a group in a hierarchy; nodes hold OR-combined bitmaps and size ranges.

    overlap(x, y) <= popcount(bits(x) & bits(y)) + (size(x) - popcount(bits(x))) for two documents, as tokens that share
    a bit with another are at most size less popcount; with the OR of bitmaps and the largest such rest it holds for
    nodes.
    """

    FAN = 8

    def __init__(self, own: list[np.ndarray]):
        self.own, n = own, len(own)
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.order = np.lexsort(([int(x[0]) for x in own], self.sizes))
        bits = np.zeros((n, _BITS // 64), np.uint64)
        for i, d in enumerate(self.order):
            at = (own[d] & np.uint64(_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        low = high = self.sizes[self.order]
        rest = high - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, low, high, rest)]
        while len(bits) > 1:
            cut = np.arange(0, len(bits), self.FAN)
            bits, low, high, rest = np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(rest, cut)
            self.levels.append((bits, low, high, rest))

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Verified pairs that join all components of the group; not all pairs inside one."""
        n, found = len(self.own), []
        union = _Union(n)
        uniform = [{} for _ in self.levels]

        def one(level, i):
            """The component of all documents below a node, or -1 while they have several."""
            if level == 0:
                return union.find(int(self.order[i]))
            at = uniform[level].get(i)
            if at is None:
                below = range(i * self.FAN, min((i + 1) * self.FAN, len(self.levels[level - 1][1])))
                parts = {one(level - 1, j) for j in below}
                if len(parts) > 1 or -1 in parts:
                    return -1
                at = uniform[level][i] = parts.pop()  # once together, always together
            return union.find(at)

        def possible(level, i, js):
            bits, low, high, rest = self.levels[level]
            need = np.maximum(_least_shared(low[i], percent), _least_shared(low[js], percent))
            most = np.bitwise_count(bits[i] & bits[js]).sum(1).astype(np.int64) + np.minimum(rest[i], rest[js])
            return js[(high[i] * 100 >= low[js] * percent) & (high[js] * 100 >= low[i] * percent) & (most >= need)]

        def pair(level, i, j):
            a, b = one(level, i), one(level, j)
            if a >= 0 and a == b:
                return
            if level == 0:
                x, y = int(self.order[i]), int(self.order[j])
                if similar(self.own[x], self.own[y], percent):
                    found.append((x, y))
                    union.up[union.find(x)] = union.find(y)
                return
            size = len(self.levels[level - 1][1])
            js = np.arange(j * self.FAN, min((j + 1) * self.FAN, size))
            for p in range(i * self.FAN, min((i + 1) * self.FAN, size)):
                for q in possible(level - 1, p, js):
                    pair(level - 1, p, int(q))

        for level in range(1, len(self.levels)):  # nearest first: below one node, then below two
            size = len(self.levels[level - 1][1])
            for i in range(len(self.levels[level][1])):
                inner = range(i * self.FAN, min((i + 1) * self.FAN, size))
                for p in inner:
                    js = np.arange(p + 1, inner.stop)
                    if len(js):
                        for q in possible(level - 1, p, js):
                            pair(level - 1, p, int(q))
        return found


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) * 100 < len(b) * percent:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _walks(percent: int):
    """Rows (component, part, d1, d2, blob), groups one after the other -> what verified links join, as stars (a, b) of (d1, d2)."""

    def run(batches):
        key, names, own = None, [], []

        def done():
            pairs = SignatureTree(own).links(percent) if len(own) > 1 else []
            stars = forest(*np.array(pairs, np.int64).reshape(-1, 2).T)  # names come in their order
            return [(names[x], names[y]) for x, y in zip(*(x.tolist() for x in stars), strict=True)]

        out = []
        for batch in batches:
            for c, p, d1, d2, x in zip(*[batch.column(k).to_pylist() for k in ("component", "part", "d1", "d2", "blob")], strict=True):
                if (c, p) != key:
                    out += done()
                    key, names, own = (c, p), [], []
                if not names or names[-1] != (d1, d2):  # repeated rows of one class follow one another
                    names.append((d1, d2))
                    own.append(np.frombuffer(x, np.uint64))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        out += done()
        yield _pairs(out)

    def _pairs(rows):
        node = lambda k: pa.StructArray.from_arrays([pa.array([r[k][j] for r in rows], pa.int64()) for j in (0, 1)], ["d1", "d2"])
        return pa.RecordBatch.from_arrays([node(0), node(1)], ["a", "b"])

    return run


def _walked(rows: DataFrame, percent: int) -> DataFrame:
    dealt = rows.repartition("component", "part").sortWithinPartitions("component", "part", "d1", "d2")
    return dealt.select("component", "part", "d1", "d2", "blob").mapInArrow(_walks(percent), f"a {_NODE}, b {_NODE}")


_SALT_N, _COPIES = 32, 8


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bits: int = 32) -> DataFrame:
    """(doc_id, text_key, n, d1, d2, component_id) of each row; text_key is the hash of its text."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = staged(digested(base, size), "digests")
    all_rows = found.where(F.col("kind") == _ROW).select("doc_id", "text_key", "n", "d1", "d2")
    classes = all_rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    total = all_rows.agg(F.sum("n")).first()[0] or 0
    often = spark.sparkContext.broadcast(frequent_shingles(found, max(FREQUENT, total // KNOWN_FREQUENT)))  # 8 MB at most
    groups = staged(candidate_groups(base, size, percent, often, partitions_for(spark, total * 7), bits), "groups")
    member = classes.join(groups, "d1")
    counts = member.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("d1", "d2")).alias("pivot")).where("members > 1")
    member = staged(member.join(counts, "component").select("component", "members", "pivot", "rep", "n", "d1", "d2"), "members")

    names = ["component", "members", "pivot", "d1", "d2"]

    def hashed(batches):
        for batch in batches:
            want1, want2, want = (batch.column(c).to_pylist() for c in ("d1", "d2", "n"))
            keep, blobs = [], []
            for i, own in _each(batch, size):
                if len(own) == want[i] and _digest(own) == (want1[i], want2[i]):  # not another text of the same id
                    keep.append(i)
                    blobs.append(own.tobytes())
            took = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(took) for c in names], pa.array(blobs, pa.binary())], [*names, "blob"])

    own = base.join(member.hint("merge"), base.doc_id == member.rep)  # the same plan at every size
    own = own.select("component", "members", "pivot", "n", "d1", "d2", "text")
    own = own.mapInArrow(hashed, f"component long, members long, pivot {_NODE}, d1 long, d2 long, blob binary")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    part = F.pmod(F.xxhash64("d1"), blocks).cast("int")
    spread_ = F.when(F.struct("d1", "d2") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(part))
    labels = components(_walked(own.withColumn("part", F.explode(spread_)), percent), "a", "b")
    big = member.where(F.col("members") > BLOCK)
    if big.limit(1).count():  # groups in several blocks: what their blocks and pivot did not join is held against all
        named = labels.select("node", F.col("component").alias("joined"))
        tagged = big.select("component", F.struct("d1", "d2").alias("own")).join(named, F.col("own") == F.col("node"), "left").select("component", "own", F.coalesce("joined", "own").alias("label"))
        per = tagged.groupBy("component", "label").agg(F.count(F.lit(1)).alias("k"))
        main = per.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        rest = staged(tagged.join(main, "component").where("label <> main").select("component", F.col("own").alias("other")), "apart")
        lots = rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("lots"))
        if lots.limit(1).count():
            held = own.join(lots, "component")
            lot = F.pmod(F.xxhash64("d1"), F.col("lots")).cast("int")
            every = held.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).withColumn("part", part * F.col("lots") + F.col("lot"))
            others = held.join(rest.select("other"), F.struct("d1", "d2") == F.col("other"), "left_semi")
            others = others.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("part", F.col("block") * F.col("lots") + lot)
            cols = ["component", "part", "d1", "d2", "blob"]
            stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(stars.unionByName(_walked(every.select(*cols).unionByName(others.select(*cols)), percent)), "a", "b")
    # classes are the nodes; the smallest doc_id of each component comes last. A component may hold a third of all
    # classes, so it is met in salted parts.
    labels = labels.select(F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), "component")
    marked = staged(classes.join(labels, ["d1", "d2"]).withColumn("salt", F.pmod(F.xxhash64("d1"), F.lit(_SALT_N)).cast("int")), "labels")
    least = marked.groupBy("component").agg(F.min("rep").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT_N - 1))))
    named = marked.join(least, ["component", "salt"]).select("n", "d1", "d2", "least")
    named = classes.join(named, ["n", "d1", "d2"], "left").select("n", "d1", "d2", F.coalesce("least", "rep").alias("label"))
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    # a class may have a third of all rows as its copies
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))))
    salted = all_rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_COPIES)).cast("int"))
    return salted.join(named, ["n", "d1", "d2", "salt"], "left").select("doc_id", "text_key", "n", "d1", "d2", linked.alias("component_id"))


def links(docs: DataFrame) -> DataFrame:
    return joined(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents, of each linked group only the one with the smallest doc_id; rows of that very id stay."""
    id_, key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])
    go = joined(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__join_id"), F.col("text_key").alias("__join_key")).distinct()
    return docs.join(go, (id_ == F.col("__join_id")) & (key == F.col("__join_key")), "left_anti")
