"""Removal of long repeated substrings by a column-wise construction over many documents.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in an earlier document, or earlier in its
own. The suffix order is built as in the column-wise construction of a collection's Burrows-Wheeler transform: every
round inserts one symbol for each document and updates the order of suffixes and their common prefixes. Over whole
documents that would take as many rounds as the longest one has bytes, each over all data; two things make it fit:

* Anchors. The least hash of the ``gram``-byte strings in a window picks an anchor, by the window's content alone, so
  equal windows have equal anchors at equal places. An anchor's windows are a short stretch around it, a *context*.
  Only contexts whose anchor occurs twice can hold repeats; all others leave before anything is sorted.
* Columns. Contexts are laid out by their anchor, in buckets of the anchor's hash, and each bucket's collection gets its
  transform (``Transform``): one round inserts one symbol of each context, from the right. A stable distribution by that
  symbol turns the order of the column before into that of this column, and common prefixes follow by a range minimum.
  Where they reach ``width`` the windows are equal, byte for byte. Contexts end on different columns, so ones that start
  later enter with an empty suffix.

Between the steps, what was gathered is held in Parquet in the shared folder, as sequential runs per bucket; buckets grow
in number with the bytes of the texts. Only the last two columns' states are held, in memory, not those of all columns.

No task gets a passage's every occurrence. Of an anchor that occurs twice in one flush all occurrences are known to be
repeated, so its bucket hears of it once a flush. Equal contexts of one flush send one on, the earliest; the others are
repeats already. An anchor with ``HOT`` contexts or more (a line in a third of all documents) leaves the columns: its windows
go by a 128-bit digest of their bytes, of equal ones in a flush the earliest alone. The limit is the same at every size. The most
frequent of these anchors, with a 2**20th of all bytes or more, are sent to all tasks; a bucket that gathers ``HOT`` contexts of any other
anchor turns them, and all that follow, into windows too, which are dealt out once more.

Defined cases: a null text counts as empty; texts shorter than ``width`` lose nothing; a null doc_id comes first; rows
with equal id and text are one place in the order, of which none is earlier; rows of one id with different texts follow
one another by the texts' hashes; a doc_id that is no whole number is a TypeError; an empty table gives an empty result.
A text is read in parts, but its bytes and anchors are held at once, about 40 times its length at most. Other columns of the
input are kept by ``deduplicated_documents``, except that names beginning with ``__repeats_`` are its own.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import partitions_for, slices, staged, text_bytes, utf8
from lexisift.llm.vectext import _BYTE, mix, powers, span_hash, spread
from lexisift.llm.vectext import prefix as prefix_sums

WIDTH = 100
GRAM = 32
#: Contexts of one anchor from which its windows are dealt out one by one, at every size of the corpus; and how many of these
#: anchors all tasks hear of before, the others being noticed by their own bucket.
HOT, KNOWN_HOT = 8192, 1 << 20
_CHUNK = 1 << 19


class Held(NamedTuple):
    """What a worker holds at once: anchors, bytes of text, bytes of contexts, contexts in one transform."""

    anchors: int = 1 << 19
    text: int = 1 << 20
    contexts: int = 4 << 20
    lot: int = 1 << 14


_ID, _KEY, _RUNS = "__repeats_id", "__repeats_key", "__repeats_runs"
_NULL_ID = np.int64(-(1 << 63))


def contexts(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Anchor's hash and place, first and last window start of each context, over all rows of a batch."""
    n, reach = len(raw), width - gram + 1
    ends = offsets[1:]
    out = []
    for at in range(0, max(0, n - width + 1), _CHUNK):
        count = min(_CHUNK, n - width + 1 - at)  # window starts in this chunk
        part = raw[at : at + count + width - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * powers(len(part)), out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * powers(len(part), True)[: len(part) - gram + 1])
        least = (grams & ~np.uint64((1 << 21) - 1)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < reach:
            least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
        anchor = (least[:count] & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.arange(at, at + count)
        row_end = ends[np.searchsorted(ends, start, "right")] if len(ends) else start
        good = start + width <= row_end
        fresh = np.ones(count, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
        first = np.flatnonzero(good & fresh)
        last_mark = np.ones(count, bool)
        last_mark[:-1] = fresh[1:] | ~good[1:]
        last = np.flatnonzero(good & last_mark)
        out.append((grams[anchor[first]], anchor[first] + at, first + at, last + at))
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_CODEC, _LEVEL = "zstd", 6  # blobs are what the exchanges write


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.uint64).tobytes()
    body = head + b"".join(a.tobytes() for a in arrays)
    return np.uint64(len(body)).tobytes() + pa.Codec(_CODEC, compression_level=_LEVEL).compress(body, asbytes=True)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.uint64)[0]), codec=_CODEC, asbytes=True)
    sizes = np.frombuffer(body, np.uint64, len(kinds), 8).astype(np.int64)
    at, out = 8 + 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False)


def _by_bucket(bucket: np.ndarray, count: int):
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), order[edge[b] : edge[b + 1]]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (doc, key) pairs, and for each row the place of its own."""
    order = np.lexsort((key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
    back = np.empty(len(order), np.uint32)
    back[order] = np.cumsum(new) - 1
    return doc[order][new], key[order][new], back


def _rows(kind: int, names: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


_SINGLE, _KNOWN, _HOT, _CONTEXT, _WINDOW = range(5)


def anchor_rows(buckets: int, width: int, gram: int, most: Held = Held()):
    """Anchors of many documents. What occurs twice in one flush is known to be repeated and goes to its documents
    (``_KNOWN``); the bucket of its hash hears of it once, with the count. Anchors found once go there themselves. So no
    bucket gets more than one record a flush of an anchor, however many documents share it."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            every, bounds = utf8(batch.column("text"))
            ids, keys = _ids(batch), batch.column("text_key").to_numpy()
            for a, b in slices(bounds):
                offsets = bounds[a : b + 1] - bounds[a]
                hashes, place, first, last = contexts(every[bounds[a] : bounds[b]], offsets, width, gram)
                row = np.searchsorted(offsets, first, "right") - 1
                held.append((hashes, (place - offsets[row]).astype(np.uint32), (place - first).astype(np.uint16), (place - last).astype(np.uint16), ids[a:b][row], keys[a:b][row]))
                size += len(hashes)
                if size >= most.anchors:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held):
        hashes, place, low, high, doc, key = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        count = np.diff(np.append(edge, len(ranked)))
        many = np.repeat(count > 1, count)
        if many.any():
            i = order[many]
            yield _dealt(doc[i], key[i], np.column_stack([place[i], low[i], high[i]]), buckets, _KNOWN)
        i = order[edge]  # one of each
        alone = count == 1
        names, blobs = [], []
        for b, j in _by_bucket(_bucket_of(hashes[i], buckets), buckets):
            own = i[j][alone[j]]
            own_doc, own_key, back = _distinct(doc[own], key[own])
            more = j[~alone[j]]
            names.append(b)
            blobs.append(_pack(own_doc, own_key, hashes[own], back, place[own], low[own], high[own], hashes[i[more]], count[more]))
        yield _rows(_SINGLE, names, blobs)

    return run


def repeated_anchors(buckets: int, hot: int):
    """From the records of a partition: the anchors whose hash occurs twice or more, dealt out by document, and the hashes
    that occur ``hot`` times or more, with their counts. What is known already passes."""

    def run(batches):
        got = []
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                if kind == _KNOWN:
                    yield _rows(_KNOWN, [bucket], [blob])
                else:
                    got.append(_unpack(blob, np.int64, np.int64, np.uint64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint64, np.int64))
        if not got:
            return
        hashes = np.concatenate([g[k] for g in got for k in (2, 7)])
        weight = np.concatenate([x for g in got for x in (np.ones(len(g[2]), np.int64), g[8])])
        order = np.argsort(hashes)
        hashes, weight = hashes[order], weight[order]
        edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))[: len(hashes)]
        total = np.add.reduceat(weight, edge) if len(edge) else weight
        twice = hashes[edge][total > 1]
        if not len(twice):
            return
        much = total >= hot
        if much.any():
            yield _rows(_HOT, [0], [_pack(hashes[edge][much], total[much])])
        rest = []
        for doc, key, own, back, place, low, high, _, _ in got:
            at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
            hit = np.flatnonzero(twice[at] == own)
            rest.append((doc[back[hit]], key[back[hit]], place[hit], low[hit], high[hit]))
        doc, key, place, low, high = (np.concatenate(x) for x in zip(*rest, strict=True))
        if len(doc):
            yield _dealt(doc, key, np.column_stack([place, low, high]), buckets, _KNOWN)

    return run


def _dealt(doc: np.ndarray, key: np.ndarray, rows: np.ndarray, buckets: int, kind: int = 1) -> pa.RecordBatch:
    """Rows of numbers about documents, as one (kind, bucket, blob) for each bucket of documents."""
    names, blobs = [], []
    at = (mix(doc.view(np.uint64) ^ mix(key.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    rows = np.ascontiguousarray(rows, np.uint32)
    for b, i in _by_bucket(at, buckets):
        own_doc, own_key, back = _distinct(doc[i], key[i])
        names.append(b)
        blobs.append(_pack(own_doc, own_key, back, rows[i]))
    return _rows(kind, names, blobs)


def _by_document(columns_: int):
    """From all blobs of a bucket of documents: one row (id, key, blob) for each document, its rows in order."""

    def run(batches):
        got = [_unpack(x, np.int64, np.int64, np.uint32, np.uint32) for batch in batches for x in batch.column("blob").to_pylist()]
        if not got:
            return
        doc, key, rows = np.concatenate([g[0][g[2]] for g in got]), np.concatenate([g[1][g[2]] for g in got]), np.concatenate([g[3] for g in got])
        del got
        rows = rows.reshape(-1, columns_)
        order = np.lexsort((rows[:, 0], key, doc))
        doc, key, rows = doc[order], key[order], rows[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
        stop = np.append(new[1:], len(doc))
        for a in range(0, len(new), 5000):
            part = slice(a, a + 5000)
            blobs = [rows[i:j].tobytes() for i, j in zip(new[part], stop[part], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[new[part]]), pa.array(key[new[part]]), pa.array(blobs, pa.binary())], [_ID, _KEY, "blob"])

    return run


def context_rows(buckets: int, width: int, gram: int, hot, most: Held = Held()):
    """Contexts of the repeated anchors, dealt out by anchor; windows of those that are hot, dealt out by window; and the
    runs that are known to be repeats already, dealt out by document."""

    def run(batches):
        held, size, often = [], 0, hot.value
        for batch in batches:
            every, bounds = utf8(batch.column("text"))
            ids, keys, lists = _ids(batch), batch.column("text_key").to_numpy(), batch.column("blob").to_pylist()
            for a, b in slices(bounds, most.text):
                raw, offsets = every[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                own = [np.frombuffer(x, np.uint32).reshape(-1, 3).astype(np.int64) for x in lists[a:b]]
                rows, row = np.concatenate(own), np.repeat(np.arange(b - a), [len(x) for x in own])
                sums = prefix_sums(raw)
                for cut in range(0, len(rows), most.lot):  # a very long text is taken in parts
                    (place, low, high), r = rows[cut : cut + most.lot].T, row[cut : cut + most.lot]
                    at = place + offsets[r]
                    anchor = mix((sums[at + gram] - sums[at]) * powers(len(sums), True)[at])
                    begin, end = at - low, at - high + width
                    same = span_hash(sums, begin, end) ^ mix((low * 4096 + high).astype(np.uint64))
                    lengths = end - begin
                    held.append((anchor, same, ids[a:b][r], keys[a:b][r], place.astype(np.uint32), low.astype(np.uint16), high.astype(np.uint16), lengths, raw[spread(begin, lengths)]))
                    size += int(lengths.sum())
                    if size >= most.contexts:
                        yield from flush(held, often)
                        held, size = [], 0
        if size:
            yield from flush(held, often)

    def flush(held, often):
        anchor, same, doc, key, place, low, high, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = np.cumsum(lengths) - lengths
        order = np.lexsort((place, key, doc, same))
        lead = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        head = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]  # the earliest of each group, for each member
        copy = ~lead & (lengths[order] == lengths[head]) & (low[order] == low[head])
        copy &= ~((doc[order] == doc[head]) & (key[order] == key[head]) & (place[order] == place[head]))
        i, h = order[copy], head[copy]
        if len(i):  # equal hashes are held against the bytes
            differs = data[spread(starts[i], lengths[i])] != data[spread(starts[h], lengths[h])]
            wrong = np.add.reduceat(differs, np.cumsum(lengths[i]) - lengths[i]) > 0
            copy[np.flatnonzero(copy)[wrong]] = False
        done = order[copy]
        if len(done):
            yield _dealt(doc[done], key[done], np.column_stack([place[done].astype(np.int64) - low[done], place[done].astype(np.int64) - high[done] + width]), buckets)
        go = np.sort(order[~copy])
        if len(often):
            at = np.minimum(np.searchsorted(often, anchor[go]), len(often) - 1)
            is_hot = often[at] == anchor[go]
            i = go[is_hot]
            if len(i):
                yield from _windows(doc[i], key[i], place[i], low[i], high[i], _laid(data, starts[i], lengths[i], low[i], width, gram), buckets, width, gram)
            go = go[~is_hot]
        names, blobs = [], []
        for b, i in _by_bucket(_bucket_of(anchor[go], buckets), buckets):
            i = go[i]
            own_doc, own_key, back = _distinct(doc[i], key[i])
            names.append(b)
            blobs.append(_pack(own_doc, own_key, anchor[i], back, place[i], low[i], high[i], data[spread(starts[i], lengths[i])]))
        yield _rows(_CONTEXT, names, blobs)

    return run


def _laid(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, width: int, gram: int) -> np.ndarray:
    """One row of symbols for each context, with all anchors in one column."""
    text = np.zeros((len(starts), 2 * width - gram), np.uint8)
    text.ravel()[spread(np.arange(len(starts)) * text.shape[1] + (width - gram) - low, lengths)] = data[spread(starts, lengths)]
    return text


def _windows(doc, key, place, low, high, text, buckets: int, width: int, gram: int):
    """Windows of hot contexts by a 128-bit digest of their bytes. Of equal ones in this batch the earliest goes on; the
    others are repeats, so that a window in many documents sends one record a batch."""
    left = width - gram
    wide = np.lib.stride_tricks.sliding_window_view(text, width, axis=1)
    names, blobs = [], []
    parts = []
    for a in range(0, len(doc), 1024):
        b = min(a + 1024, len(doc))
        before = left - np.arange(left + 1)  # how far before the anchor the window of each column starts
        owner, column = np.nonzero((before >= high[a:b, None]) & (before <= low[a:b, None]))
        word = np.zeros((len(owner), -(-width // 8) * 8), np.uint8)
        word[:, :width] = wide[a:b][owner, column]
        word = word.view(np.uint64)
        one, two = np.full(len(owner), width, np.uint64), np.full(len(owner), 0x5851F42D4C957F2D, np.uint64)
        for k in range(word.shape[1]):
            one, two = mix(one ^ word[:, k]) + np.uint64(2 * k + 1), mix(two + word[:, k] * np.uint64(0xD1342543DE82EF95)) ^ one
        parts.append((one, two, owner + a, place[a:b][owner].astype(np.int64) - before[column]))
    one, two, owner, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc, key = doc[owner], key[owner]
    go, late = _earliest(one, two, doc, key, start)
    if len(late):
        yield _dealt(*_joined_runs(doc[late], key[late], start[late], width), buckets)
    for b, i in _by_bucket(_bucket_of(one[go], buckets), buckets):
        i = go[i]
        own_doc, own_key, back = _distinct(doc[i], key[i])
        names.append(b)
        blobs.append(_pack(own_doc, own_key, one[i], two[i], back, start[i].astype(np.uint32)))
    yield _rows(_WINDOW, names, blobs)


def _earliest(one, two, doc, key, start) -> tuple[np.ndarray, np.ndarray]:
    """Places of the earliest window of each digest, and of all that come after it."""
    order = np.lexsort((start, key, doc, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    own = (doc[order] == doc[head]) & (key[order] == key[head]) & (start[order] == start[head])
    return order[new], order[~own]


def _joined_runs(doc, key, start, width: int):
    """Windows of neighbouring starts as one run: documents, keys and (start, end) pairs."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(doc)) - 1
    return doc[edge], key[edge], np.column_stack([start[edge], start[last] + width])


def _late_windows(got: list, buckets: int, width: int):
    """From all windows of a bucket: those with an equal one earlier, as runs of their documents."""
    doc, key = np.concatenate([g[0][g[4]] for g in got]), np.concatenate([g[1][g[4]] for g in got])
    one, two, start = (np.concatenate([g[k] for g in got]) for k in (2, 3, 5))
    start = start.astype(np.int64)
    _, late = _earliest(one, two, doc, key, start)
    if len(late):
        yield _dealt(*_joined_runs(doc[late], key[late], start[late], width), buckets)


class Transform:
    """The Burrows-Wheeler transform of a collection of contexts, built column by column from the right.

    The state after the round of column c, one entry for each suffix that starts there, in the order of the suffixes:
    ``order`` (its context), ``common`` (its common prefix with the suffix before it, at most ``width``) and ``before``,
    the transform: the symbol before the suffix, which the next round inserts. A round reads the column to the left once.
    """

    def __init__(self, text: np.ndarray, last: np.ndarray, width: int):
        self.column = np.ascontiguousarray(text.T)  # a column is one sequential run
        self.last, self.top = last, np.uint8(width - 1)
        self.by_end = np.argsort(-last, kind="stable")
        self.entered, self.at = 0, len(self.column)
        self.order, self.common, self.before = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)

    def insert(self) -> None:
        """One round: the next symbol of each context; contexts that end on this column enter with it."""
        self.at -= 1
        now = int(np.searchsorted(-self.last[self.by_end], -self.at, "right"))
        if now > self.entered:  # empty suffixes stand before all others, with nothing in common
            new = self.by_end[self.entered : now]
            if len(self.common):
                self.common[0] = 0
            self.order = np.concatenate([new, self.order])
            self.common = np.concatenate([np.zeros(len(new), np.uint8), self.common])
            self.before = np.concatenate([self.column[self.at][new], self.before])
            self.entered = now
        if not len(self.order):
            return
        turn = np.argsort(self.before, kind="stable")  # the distribution by the inserted symbol
        counts = np.bincount(self.before, minlength=256)
        common, at = np.zeros(len(turn), np.uint8), 0
        for count in counts[counts > 0]:
            mine = turn[at : at + count]
            if count > 1:
                # from one suffix of this symbol to the next: the least common prefix on the way
                least = np.minimum.reduceat(self.common[: mine[-1] + 1], np.minimum(mine[:-1] + 1, mine[-1]))
                common[at + 1 : at + count] = np.minimum(least, self.top) + 1
            at += count
        self.order, self.common = self.order[turn], common
        if self.at:
            self.before = self.column[self.at - 1][self.order]


def columns(text: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Which windows of the contexts are repeats: (contexts, columns before the anchor and its own).

    text: one row for each context, one column for each place from width - gram before the anchor. rank: the order of
    their places in the collection.
    """
    left = width - gram
    built = Transform(text, left + width - 1 - high.astype(np.int64), width)
    repeat = np.zeros((len(low), left + 1), bool)
    for c in range(left + width - 1, -1, -1):
        built.insert()
        if c > left or not len(built.order):
            continue
        start = left - c  # how far before the anchor the window starts
        owns = (high[built.order] <= start) & (start <= low[built.order])
        mine = built.order[owns]
        if not len(mine):
            continue
        group = np.cumsum(built.common < width)[owns]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.minimum.reduceat(rank[mine], edge)
        later = rank[mine] > np.repeat(first, np.diff(np.append(edge, len(mine))))
        repeat[mine[later], start] = True
    return repeat


def repeats(buckets: int, width: int, gram: int, most: Held = Held(), hot: int = HOT):
    """From all contexts and windows of a bucket: the repeats among them, as runs of their documents; runs already known
    pass. Contexts are sorted in lots of whole anchors. An anchor with ``hot`` contexts goes on as windows."""
    left, lot = width - gram, most.lot
    kinds = (np.int64, np.int64, np.uint64, np.uint32, np.uint32, np.uint16, np.uint16, np.uint8)

    def run(batches):
        held, windows, size, over = [], [], 0, np.zeros(0, np.uint64)
        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                if kind == _KNOWN:
                    yield _rows(_KNOWN, [bucket], [blob])
                elif kind == _CONTEXT:
                    held.append(_unpack(blob, *kinds))
                    size += len(held[-1][2])
                    if size >= max(4 * lot, 2 * hot):
                        held, over = yield from _shed(held, over)
                        size = 0
                else:
                    windows.append(_unpack(blob, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32))
        if windows:
            yield from _late_windows(windows, buckets, width)
        del windows
        if held:
            held, over = yield from _shed(held, over)
        if held:
            yield from _sorted_lots(held)

    def _shed(got, over):
        """The contexts of hot anchors leave as windows; the others, and the hot anchors so far, are returned."""
        name = np.concatenate([g[2] for g in got])
        found, count = np.unique(name, return_counts=True)
        over = np.union1d(over, found[count >= hot])
        if not np.isin(found, over).any():
            return got, over
        rest, parts, n = [], [], 0
        for doc, key, anchor, back, place, low, high, data in got:
            goes = np.isin(anchor, over)
            lengths = low.astype(np.int64) - high + width
            starts = np.cumsum(lengths) - lengths
            i, j = np.flatnonzero(goes), np.flatnonzero(~goes)
            if len(j):
                rest.append((doc, key, anchor[j], back[j], place[j], low[j], high[j], data[spread(starts[j], lengths[j])]))
            if len(i):
                text = _laid(data, starts[i], lengths[i], low[i].astype(np.int64), width, gram)
                parts.append((doc[back[i]], key[back[i]], place[i], low[i].astype(np.int64), high[i].astype(np.int64), text))
                n += len(i)
            if n >= lot:
                yield from _windows(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets, width, gram)
                parts, n = [], 0
        if parts:
            yield from _windows(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets, width, gram)
        return rest, over

    def _sorted_lots(got):
        anchor, place, low, high = (np.concatenate([g[k] for g in got]) for k in (2, 4, 5, 6))
        doc = np.concatenate([g[0][g[3]] for g in got])
        key = np.concatenate([g[1][g[3]] for g in got])
        data = np.concatenate([g[7] for g in got])
        got.clear()
        lengths = low.astype(np.int32) - high + width
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        order = np.argsort(anchor, kind="stable")
        same = np.concatenate([anchor[order][1:] == anchor[order][:-1], [False]])
        alone = ~same & ~np.concatenate([[False], same[:-1]])
        order = order[~alone]  # the others of the anchor were known repeats
        if not len(order):
            return
        edge = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        at = 0
        while at < len(order):  # lots of whole groups of an anchor
            k = np.searchsorted(edge, at + lot, "right") - 1
            to = len(order) if at + lot >= len(order) else int(edge[k]) if edge[k] > at else int(edge[k + 1]) if k + 1 < len(edge) else len(order)
            i = order[at:to]
            at = to
            text = _laid(data, starts[i], lengths[i].astype(np.int64), low[i].astype(np.int64), width, gram)
            place_i = place[i].astype(np.int64)
            by = np.lexsort((place_i, key[i], doc[i]))
            new = np.concatenate([[False], (doc[i][by][1:] != doc[i][by][:-1]) | (key[i][by][1:] != key[i][by][:-1]) | (place_i[by][1:] != place_i[by][:-1])])
            rank = np.empty(len(i), np.int64)
            rank[by] = np.cumsum(new)
            hit = columns(text, low[i], high[i], rank, width, gram)
            # stretches of neighbouring starts are one run
            grid = np.zeros((len(i), left + 3), np.int8)
            grid[:, 1:-1] = hit
            step = np.diff(grid, axis=1)
            who, far = np.nonzero(step == 1)
            _, near = np.nonzero(step == -1)
            if len(who):
                yield _dealt(doc[i][who], key[i][who], np.column_stack([place_i[who] - (near - 1), place_i[who] - far + width]), buckets)

    return run


def _hot_set(found: DataFrame, least: int) -> tuple[np.ndarray, bool]:
    """The sorted hashes of the anchors that occur ``least`` times or more, and whether there are other hot ones."""

    def run(batches):
        some, others = [], 0
        for batch in batches:
            for x in batch.column("blob").to_pylist():
                hashes, total = _unpack(x, np.uint64, np.int64)
                some.append(hashes[total >= least])
                others += int((total < least).sum())
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(some).tobytes()], pa.binary()), pa.array([others], pa.int64())], ["blob", "others"])

    rows = found.where(F.col("kind") == _HOT).select("blob").mapInArrow(run, "blob binary, others long").collect()
    every = [np.frombuffer(bytes(r["blob"]), np.uint64) for r in rows]
    return np.sort(np.concatenate(every)) if every else np.zeros(0, np.uint64), any(r["others"] for r in rows)


def _late(buckets: int, width: int):
    def run(batches):
        got = [_unpack(x, np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32) for batch in batches for x in batch.column("blob").to_pylist()]
        if got:
            yield from _late_windows(got, buckets, width)

    return run


def runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, most: Held = Held(), known_hot: int = KNOWN_HOT) -> DataFrame:
    """(id, key, blob): the stretches [start, end) of bytes to remove, as pairs of numbers; they may overlap."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    long_ = base.where(F.octet_length("text") >= width)
    size = text_bytes(long_)
    buckets = partitions_for(spark, size)
    dealt = lambda df, *more: df.repartitionById(buckets, F.col("bucket")).select(*more, "blob")
    blob, document = "kind int, bucket int, blob binary", f"{_ID} long, {_KEY} long, blob binary"
    anchors = dealt(long_.mapInArrow(anchor_rows(buckets, width, gram, most), blob), "kind", "bucket")
    repeated = staged(anchors.mapInArrow(repeated_anchors(buckets, hot), blob), "anchors")
    before, more = _hot_set(repeated, max(hot, size // known_hot))
    often = spark.sparkContext.broadcast(before)  # 8 bytes for each of known_hot at most, as each has such a share of all bytes
    lists = dealt(repeated.where(F.col("kind") == _KNOWN)).mapInArrow(_by_document(3), document)
    id_ = F.coalesce(F.col("doc_id"), F.lit(int(_NULL_ID)))
    beside = long_.join(lists, (id_ == F.col(_ID)) & (F.col("text_key") == F.col(_KEY)))
    found = dealt(beside.select("doc_id", "text", "text_key", "blob").mapInArrow(context_rows(buckets, width, gram, often, most), blob), "kind", "bucket")
    every = found.mapInArrow(repeats(buckets, width, gram, most, hot), blob)
    if more:  # their buckets send windows, which meet once more
        every = staged(every, "repeats")
        late = dealt(every.where(F.col("kind") == _WINDOW)).mapInArrow(_late(buckets, width), blob)
        every = every.where(F.col("kind") == _KNOWN).unionByName(late)
    return dealt(every).mapInArrow(_by_document(2), document)


def kept_bytes(text: np.ndarray, blob: bytes | None) -> tuple[np.ndarray, int, int]:
    """The bytes left, how many went, and in how many stretches."""
    if not blob:
        return text, 0, 0
    pairs = np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64)
    delta = np.zeros(len(text) + 1, np.int32)
    np.add.at(delta, pairs[:, 0], 1)
    np.add.at(delta, pairs[:, 1], -1)
    gone = np.cumsum(delta[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return text[~gone], int(gone.sum()), spans


def _with_runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number")
    found = runs(docs, width, gram).withColumnRenamed("blob", _RUNS)
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NULL_ID)))
    return docs.join(found, (id_ == F.col(_ID)) & (text_key == F.col(_KEY)), "left").drop(_ID, _KEY)


def _digest(batches):
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        out = []
        for i, blobs in enumerate(batch.column(_RUNS).to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            left, gone, spans = kept_bytes(text, blobs)
            out.append((len(text), gone, spans, hashlib.sha256(left.tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    with_runs = _with_runs(docs.select("doc_id", "text"), width, gram)
    return with_runs.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated_documents(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents without repeated stretches. A character cut in two goes whole; a document left empty goes."""
    names = docs.columns

    def cut(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            texts = batch.column("text").to_pylist()
            keep = []
            for i, blobs in enumerate(batch.column(_RUNS).to_pylist()):
                if blobs:
                    texts[i] = kept_bytes(raw[offsets[i] : offsets[i + 1]], blobs)[0].tobytes().decode(errors="ignore")
                if not blobs or texts[i]:
                    keep.append(i)
            new = pa.array([texts[i] for i in keep], pa.string())
            took = pa.array(keep, pa.int64())
            size = lambda: pa.array([None if x is None else len(x) for x in new.to_pylist()], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new if c == "text" else size() if c == "n_chars" else batch.column(c).take(took) for c in names], names)

    return _with_runs(docs, width, gram).mapInArrow(cut, docs.schema)
