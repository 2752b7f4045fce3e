"""Byte-level BPE encoding and decoding by a rank file.

Texts are cut into pieces by the public pattern. A piece is encoded on a segment tree over its byte positions: a leaf
holds the rank of the pair that starts there, a node the leftmost least rank below it. The root tells the next merge;
a merge joins two live neighbours, changes at most three leaves and updates their paths, so a piece of n bytes takes
O(n log n) steps. Pieces of equal width go up and down their trees together, as numpy arrays; long ones go alone.
Encoded pieces are kept in a bounded cache, found by hash and compared by bytes, so that a word is merged once for each worker.

Defined cases: a null text counts as empty and has no tokens; repeated rows are each encoded; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from lexisift.llm.common import slices, utf8
from lexisift.llm.vectext import RaggedCache, cached_runs

RANKS = "byte_bpe_50k.tiktoken"
NEVER = np.int64(1 << 40)


class Merges:
    """Pairs of tokens that merge, by rank; a table for arrays and a dictionary for single pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], NEVER)

    def together(self, raw: np.ndarray) -> list[np.ndarray]:
        """raw: (pieces, width) bytes of pieces of one width. The ids of all, padded with -1, left-aligned."""
        n, width = raw.shape
        token = self.first[raw]
        if width == 1:
            return token
        leaves = 1 << (width - 1).bit_length()
        tree = np.full((n, 2 * leaves), NEVER, np.int64)
        # a node is rank * leaves + place, so that the least is the leftmost least
        tree[:, leaves : leaves + width - 1] = self.rank(token[:, :-1], token[:, 1:]) * leaves + np.arange(width - 1)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            top = tree[live, 1]
            at, rank = top % leaves, top // leaves
            gone = after[live, at]
            token[live, at] = rank
            token[live, gone] = -1
            nxt, prev = after[live, gone], before[live, at]
            after[live, at] = nxt
            inner = nxt < width
            before[live[inner], nxt[inner]] = at[inner]
            right = np.where(inner, token[live, np.minimum(nxt, width - 1)], -1)
            left = np.where(prev >= 0, token[live, np.maximum(prev, 0)], -1)
            for place, new, some in (
                (gone, np.full(len(live), NEVER), None),
                (at, self._leaf(token[live, at], right, at, leaves), None),
                (np.maximum(prev, 0), self._leaf(left, token[live, at], np.maximum(prev, 0), leaves), prev >= 0),
            ):
                who, node, new = (live, place + leaves, new) if some is None else (live[some], place[some] + leaves, new[some])
                tree[who, node] = new
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
            live = live[tree[live, 1] < NEVER]
        return token

    def _leaf(self, left, right, place, leaves):
        rank = self.rank(left, right)
        return np.where(rank < NEVER, rank * leaves + place, NEVER)

    def alone(self, piece: bytes) -> list[int]:
        """One piece, on a tree in a list."""
        n = len(piece)
        if n == 0:
            return []
        token = [int(self.first[b]) for b in piece]
        leaves = 1 << max(0, (n - 1).bit_length())
        far, size, pairs = int(NEVER), self.size, self.pairs
        tree = [far] * (2 * leaves)
        for i in range(n - 1):
            r = pairs.get(token[i] * size + token[i + 1])
            if r is not None:
                tree[leaves + i] = r * leaves + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i, left, right):
            r = pairs.get(left * size + right) if left is not None and right is not None else None
            node = leaves + i
            tree[node] = far if r is None else r * leaves + i
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        while leaves > 1 and tree[1] < far:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            token[i], token[j] = rank, None
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
            put(j, None, None)
            put(i, rank, token[k] if k < n else None)
            if h >= 0:
                put(h, token[h], rank)
        return [t for t in token if t is not None]

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, wide: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the pieces of raw from start to end."""
        widths = end - start
        parts: list = [None] * len(start)
        lengths = np.zeros(len(start), np.int64)
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            if width > wide or len(mine) < 8:
                for i in mine:
                    parts[i] = np.array(self.alone(raw[start[i] : end[i]].tobytes()), np.uint32)
                    lengths[i] = len(parts[i])
                continue
            for lot in np.array_split(mine, max(1, len(mine) // 20000)):
                ids = self.together(raw[start[lot][:, None] + np.arange(width)])
                has = ids >= 0
                count = has.sum(1)
                lengths[lot] = count
                flat = ids[has].astype(np.uint32)
                for i, part in zip(lot, np.split(flat, np.cumsum(count)[:-1]), strict=True):
                    parts[i] = part
        return lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        from lexisift.llm.vectext import spread

        return self.blob[spread(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def _cache(path: str) -> RaggedCache:
    return RaggedCache(np.uint32, 1 << 20)


# Classes of bytes: white space, letter, number, other, and what only the pattern itself decides.
_WHITE, _LETTER, _NUMBER, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[:128] = [_WHITE if chr(i) in " \t\n\r\x0b\x0c" else _LETTER if chr(i).isalpha() else _NUMBER if chr(i).isdigit() else _OTHER if 32 < i < 127 else _ODD for i in range(128)]


def classes(raw: np.ndarray) -> np.ndarray:
    """Byte classes; of the wider characters only the letters of U+00C0 to U+00FF are told, the rest is odd."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    tail = raw[lead + 1]
    good = lead[(tail != 0x97) & (tail != 0xB7)]
    kind[good] = kind[good + 1] = _LETTER
    return kind


def pieces(raw: np.ndarray, offsets: np.ndarray, pattern=regex.compile(public_tokenizers.PATTERN)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each match of the pattern. Rows with odd characters go through the pattern itself."""
    n = len(offsets) - 1
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    kind = classes(raw)
    sums = np.concatenate([[0], np.cumsum(kind == _ODD)])
    odd_row = sums[offsets[1:]] > sums[offsets[:-1]]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    final = np.zeros(len(raw) + 1, bool)
    final[offsets[1:]] = True
    final = final[1:]  # the last byte of a row
    white = kind == _WHITE
    was_white, will_white = np.concatenate([[False], white[:-1]]), np.concatenate([white[1:], [False]])
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    after_blank = np.concatenate([[False], raw[:-1] == 32]) & ~first
    start = np.where(white, ~was_white | (~will_white & ~final), change & ~after_blank) | first
    # contractions: an apostrophe that starts a piece takes the letters after it
    for i in np.flatnonzero((raw == 39) & start):
        to = int(offsets[np.searchsorted(offsets, i, "right")])
        nxt = raw[i + 1 : min(i + 3, to)].tobytes()
        size = 1 if nxt[:1] in (b"s", b"t", b"m", b"d") else 2 if nxt in (b"re", b"ve", b"ll") else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < to:
                start[i + 1 + size] = True
    begin = np.flatnonzero(start)
    end = np.concatenate([begin[1:], [len(raw)]])
    row = np.searchsorted(offsets, begin, "right") - 1
    if not odd_row.any():
        return begin, end, row
    keep = ~odd_row[row]
    lots = [(begin[keep], end[keep], row[keep])]
    for r in np.flatnonzero(odd_row):
        found = [len(x.encode()) for x in pattern.findall(raw[offsets[r] : offsets[r + 1]].tobytes().decode())]
        edge = offsets[r] + np.concatenate([[0], np.cumsum(found)]).astype(np.int64)
        lots.append((edge[:-1], edge[1:], np.full(len(found), r)))
    begin, end, row = (np.concatenate(x) for x in zip(*lots, strict=True))
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order], row[order]


def encode_rows(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each row, and all ids."""
    n = len(offsets) - 1
    begin, end, row = pieces(raw, offsets)
    if not len(begin):
        return np.zeros(n, np.int64), np.zeros(0, np.uint32)
    lengths, ids = cached_runs(_cache(path), raw, begin, end, lambda i: merges(path).encode(raw, begin[i], end[i]))
    return np.bincount(row, lengths, n).astype(np.int64), ids


def encoder(path: str):
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                counts, ids = encode_rows(part, at, path)
                edge = np.concatenate([[0], np.cumsum(counts)])
                table = merges(path)
                hashed = [hashlib.sha256(ids[edge[i] : edge[i + 1]].astype("<u4").tobytes()).hexdigest() for i in range(b - a)]
                decoded = [hashlib.sha256(table.decode(ids[edge[i] : edge[i + 1]])).hexdigest() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(hashed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per document: tokens, the digest of its ids, and the digest of the bytes that they decode to."""
    path = ranks or public_tokenizers.path(RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoder(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Per document: its ids as an array."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                counts, ids = encode_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path)
                edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
