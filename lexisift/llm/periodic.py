"""Periodic runs of words: stretches of a text that repeat with a period four times or more, found on a suffix tree.

Words are numbered exactly, by their bytes. A word of a run stands in it four times or more, so words that stand less often between the
places where a text is cut are no part of any: they cut it further, until nothing changes. What is left, mostly nothing, goes
into a suffix tree of all pieces of a lot of texts; no piece shares words with another, each ends in a word of its own. The
tree is the table of its inner nodes, each with its depth and its leaf list, an interval of the suffix array.

Each node's largest child is left out, and for all other leaves i it is asked whether i + depth or i - depth lies in the node's
leaf list, below another child: each such pair is a branching tandem repeat, one that the word after it does not
extend. A leaf is asked about once for every halving of a list, so n words take n log n questions, which numpy answers for many
nodes at once. Turned left word by word as long as it remains a repeat, a branching repeat spans the maximal run that ends with it. Of
repeats with one end, a multiple of a shorter period is merged into the shorter one's run where that covers it, and
a run of four periods has a branching repeat of twice its period, so that repeats without one are dropped before they are turned.

Defined cases: a null text has no words; a null doc_id is not looped; repeated rows are each searched; an empty table
gives an empty result. Other columns are not read. A text of n words that all lie in runs is held with about
(100 + 4 log2 n) n bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexisift.llm.common import ship_package, slices, utf8
from lexisift.llm.vectext import spread

LEAST, TIMES = 6, 4
LOT = 1 << 20
PAIRS = 1 << 21


def looped(words: list, doc_id: int | None) -> list:
    """Some texts end in a loop of their own words: one in ten, by the checksum of the id."""
    h, n = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[: n - a]


def pieces(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, piece, symbol) of the words that can lie in runs: their places, by piece, with numbers that no two pieces share.

    doc rises; a piece is a stretch of neighbouring words of one text, each of which stands in it ``TIMES`` times or more.
    """
    at, piece, symbol = np.arange(len(word)), doc, word
    while len(at):
        key = piece * (int(symbol.max()) + 1) + symbol
        _, symbol, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[symbol] >= TIMES
        at, piece, symbol = at[stays], piece[stays], symbol[stays]
        if not len(at):
            break
        cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])])
        new = np.cumsum(cut) - 1
        large = np.bincount(new)[new] >= LEAST
        if stays.all() and large.all():
            return at, new, symbol
        at, piece, symbol = at[large], new[large], symbol[large]
    return at, piece, symbol


def suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, ranks, longest common prefixes with the one before) of s, by doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int32)
    kept, width = [], 1
    while True:
        kept.append(rank)
        second = np.zeros(n, np.int64)
        second[: max(n - width, 0)] = rank[width:].astype(np.int64) + 1
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            break
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(kept) - 1, -1, -1):
        step = 1 << k
        inside = np.maximum(a, b) < n
        same = inside & (kept[k][np.minimum(a, n - 1)] == kept[k][np.minimum(b, n - 1)])
        common[1:] += same * step
        a, b = a + same * step, b + same * step
    return order, rank, common


def tree(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes but the root: depth, first leaf, end of the leaves; and the node that splits at each place between leaves."""
    depth, first, end, split = [], [], [], np.full(len(common), -1, np.int64)
    open_: list[list] = []  # [depth, first leaf, places], deeper ones last

    def close(node, to):
        split[node[2]] = len(depth)
        depth.append(node[0])
        first.append(node[1])
        end.append(to)

    for i, d in enumerate(common.tolist()):
        left = i - 1
        while open_ and open_[-1][0] > d:
            node = open_.pop()
            close(node, i)
            left = node[1]
        if d > 0:
            if open_ and open_[-1][0] == d:
                open_[-1][2].append(i)
            else:
                open_.append([d, left, [i]])
    while open_:
        close(open_.pop(), len(common))
    return np.array(depth, np.int64), np.array(first, np.int64), np.array(end, np.int64), split


def branching(s: np.ndarray, order: np.ndarray, rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of all branching tandem repeats: s[end - 2 p : end - p] equals s[end - p : end], s[end - p] is not s[end]."""
    depth, first, end, split = tree(common)
    place = np.flatnonzero(split >= 0)
    by_node = np.argsort(split[place], kind="stable")
    place, node = place[by_node], split[place[by_node]]
    # children: from the node's first leaf and from each split up to the next one
    nodes = np.arange(len(depth))
    owner = np.concatenate([nodes, node])
    start = np.concatenate([first, place])
    sort = np.lexsort((start, owner))
    owner, start = owner[sort], start[sort]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    stop = np.concatenate([start[1:], [0]])
    stop[last] = end[owner[last]]
    size = stop - start
    largest = np.zeros(len(owner), bool)
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    by_size = np.lexsort((size, owner))  # the last of each owner is its largest
    largest[by_size[np.concatenate([head[1:], [len(owner)]]) - 1]] = True
    owner, start, size = owner[~largest], start[~largest], size[~largest]
    n, ends, periods = len(s), [], []
    edges = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + PAIRS, "right")))
        i = order[spread(start[at:to], size[at:to])]
        own = np.repeat(owner[at:to], size[at:to])
        d = depth[own]
        for left in (i, i - d):  # a repeat begins at the leaf, or its second half does
            right = left + d
            ok = (left >= 0) & (right + d < n)
            l, r, o, p = left[ok], right[ok], own[ok], d[ok]
            other = np.where(l == i[ok], r, l)
            inside = (rank[other] >= first[o]) & (rank[other] < end[o])
            l, r, p = l[inside], r[inside], p[inside]
            branch = s[r] != s[r + p]
            ends.append((r + p)[branch])
            periods.append(p[branch])
        at = to
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.stack([np.concatenate(ends), np.concatenate(periods)], 1), axis=0)
    return found[:, 0], found[:, 1]


def turned(s: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the run of each repeat begins: it is turned left, ever more words at a time, until a word differs."""
    start, live, step = end - 2 * period, np.arange(len(end)), 16
    while len(live):
        reach = np.minimum(start[live], step)
        away = spread(np.zeros(len(live), np.int64), reach) + 1
        who = np.repeat(np.arange(len(live)), reach)
        left = start[live][who] - away
        differs = s[left] != s[left + period[live][who]]
        far = reach.copy()
        np.minimum.at(far, who[differs], away[differs] - 1)
        start[live] -= far
        live = live[(far == reach) & (reach == step)]
        step = min(2 * step, 1 << 16)
    return start


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, least period) of the maximal runs of s of ``TIMES`` periods and ``LEAST`` words or more. The last of s, and
    what ends a piece within it, stands there once."""
    none = np.zeros(0, np.int64)
    if len(s) < LEAST:
        return none, none, none
    end, period = branching(s, *suffixes(s))
    big = len(s) + 1
    key = end * big + period
    twice = np.isin(end * big + 2 * period, key)
    end, period = end[twice], period[twice]  # in order of ends, then periods
    out = []
    while len(end):
        head = np.concatenate([[True], end[1:] != end[:-1]])
        e, p = end[head], period[head]
        start = turned(s, e, p)
        out.append(np.stack([start, e, p], 1))
        of = np.cumsum(head) - 1
        merged = head | ((period % p[of] == 0) & (end - 2 * period >= start[of]))
        end, period = end[~merged], period[~merged]
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    size = found[:, 1] - found[:, 0]
    found = found[size >= np.maximum(LEAST, TIMES * found[:, 2])]
    return found[:, 0], found[:, 1], found[:, 2]


def numbered(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes; raw holds the words one after the other."""
    edge = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=edge[1:])
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edge), pa.py_buffer(raw)])
    return own.dictionary_encode().indices.to_numpy().astype(np.int64)


def found_in(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    count = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), count)
    out: list[list] = [[] for _ in texts]
    if not len(doc):
        return out
    every = [w for t in texts for w in t]
    raw = np.frombuffer(b"".join(every), np.uint8)
    word = numbered(raw, np.fromiter(map(len, every), np.int64, len(every)))
    at, piece, symbol = pieces(doc, word)
    if not len(at):
        return out
    # each piece is followed by a symbol of its own
    last = np.flatnonzero(np.concatenate([piece[1:] != piece[:-1], [True]]))
    where = np.arange(len(at)) + piece
    s = np.empty(len(at) + len(last), np.int64)
    back = np.empty(len(s), np.int64)
    s[where], back[where] = symbol, at
    s[where[last] + 1] = int(symbol.max()) + 1 + np.arange(len(last))
    begin = np.cumsum(count) - count
    start, end, period = runs(s)
    place = back[start]
    own = doc[place]
    order = np.lexsort((period, place))
    for d, a, size, p in zip(own[order].tolist(), (place - begin[own])[order].tolist(), (end - start)[order].tolist(), period[order].tolist(), strict=True):
        out[d].append((a, size, p))
    return out


def _longest(found: list[tuple]) -> tuple | None:
    """The run with the greatest exact quotient of length and period; of equal ones the first."""
    return max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)


def collapsed(words: list[bytes], found: list[tuple]) -> list[bytes]:
    """The words but those that some run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in found:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


_SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic(docs: DataFrame, loops: bool = True, runs_too: bool = False) -> DataFrame:
    """The runs of every document, their digests and the longest of them by periods. Without ``loops`` texts are taken as they are; with
    ``runs_too`` the runs and the collapsed text go out as well."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, LOT):
                own = batch.column("doc_id").slice(a, b - a)
                whole = raw[offsets[a] : offsets[b]].tobytes()
                at = (offsets[a : b + 1] - offsets[a]).tolist()
                texts = [whole[x:y].split() for x, y in zip(at, at[1:])]  # by the six white-space bytes
                if loops:
                    texts = [looped(t, d) for t, d in zip(texts, own.to_pylist(), strict=True)]
                every = found_in(texts)
                best = [_longest(f) for f in every]
                number = lambda f, best=best: pa.array([None if x is None else f(x) for x in best], pa.int64())
                left = [b" ".join(collapsed(t, f)) for t, f in zip(texts, every, strict=True)]
                columns = [
                    own,
                    pa.array([len(f) for f in every], pa.int64()),
                    number(lambda x: x[0]),
                    number(lambda x: x[1]),
                    number(lambda x: x[2]),
                    number(lambda x: 1000 * x[1] // x[2]),
                    pa.array([hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in f).encode()).hexdigest() for f in every], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string()),
                ]
                names = ["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))]
                if runs_too:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    columns += [pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in f] for f in every], kind), pc.cast(pa.array(left, pa.binary()), pa.string())]
                    names += ["runs", "collapsed"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if runs_too else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}{more}")
