"""Best-fit packing of token pieces into sequences of bounded length, in bulk-synchronous rounds.

Documents become token pieces; only one longer than a sequence is cut. Both documents and gaps are tables sorted by size:
``pieces`` with the rank of each piece within its length, and runs of sequences with equal gaps. A round takes the longest
documents left and sweeps the gaps upward for their successor, the smallest gap that still holds them. All documents of the
length meet all gaps of that size at once: the rank decides who gets which gap, those left over go on to the next gap
size, the gaps shrink, and the rounds repeat until no document is left.

Sizes are whole numbers up to the sequence length, so sorting by range leaves as many groups of documents, and of gaps, as
a sequence has places, however many documents there are. A round therefore moves whole runs: it says of a stretch of
ranks which stretch of sequences it gets. The rounds run in one task over these groups (``rounds``), whose result is a table of
stretches; ranking the pieces and joining them with their stretches are distributed. The driver sees no lengths and no plan.

Defined cases: a null or empty text is a document with the end token alone; repeated rows are packed each; an empty table
gives an empty result; other columns are not read; a special token's literal in a text is that token. A text is held with about 40 times its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import rank_within, slices, staged, utf8
from lexisift.llm.vectext import LOWER, SPACE, RaggedCache, cached_runs

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
STEP = 4096
END = 0

# Characters of which it is known here how the tokenizer cuts them: ASCII, without controls and the apostrophe, and the
# letters of U+00C0 to U+00FF. A word with any other goes to the tokenizer as it stands.
_LETTER, _NUMBER, _MARK, _BLANK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[:128] = [_BLANK if SPACE[i] else _LETTER if chr(i).isalpha() else _NUMBER if chr(i).isdigit() else _MARK if 32 < i < 127 and i != 39 else _ODD for i in range(128)]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, and the characters that stand for bytes in its model."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return found, {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _cache(path: str) -> RaggedCache:
    return RaggedCache(np.uint32, 1 << 20)


_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _encode(path: str, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole, letters = tokenizer(path)
    lengths, ids = [], []
    for a, b in zip(start, end, strict=True):
        piece = raw[a:b].tobytes()
        text = piece.decode()
        if _PLAIN.fullmatch(text):
            one = [t.id for t in whole.model.tokenize("".join([letters[x] for x in piece]))]
        else:
            one = whole.encode(text, add_special_tokens=False).ids
        lengths.append(len(one))
        ids += one
    return np.array(lengths, np.int64), np.array(ids, np.uint32)


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes; start, end and row of the parts that the tokenizer treats alone."""
    n = len(raw)
    kind = _CLASS[raw]
    low = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    tail = raw[lead + 1]
    fine = (tail != 0x97) & (tail != 0xB7)
    kind[lead[fine]] = kind[lead[fine] + 1] = _LETTER
    upper = lead[fine & (tail < 0x9F)]
    low[upper + 1] += 0x20
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    change = np.concatenate([[True], kind[1:] != kind[:-1]])[:n] | first | (kind == _NUMBER)
    # words with an odd character are one part
    blank = kind == _BLANK
    word_start = ~blank & (np.concatenate([[True], blank[:-1]])[:n] | first)
    word = np.cumsum(word_start) - 1
    odd_word = np.zeros(int(word[-1]) + 1 if n else 0, bool)
    odd_word[word[kind == _ODD]] = True
    if odd_word.any():
        inside = odd_word[np.maximum(word, 0)] & ~blank
        change = np.where(inside, word_start, change)
        low = np.where(inside, raw, low)
    begin = np.flatnonzero(change & ~blank)
    stop = np.flatnonzero(change | blank)  # each part ends where the next thing begins
    stop = np.concatenate([stop, [n]])
    end = stop[np.searchsorted(stop, begin, "right")]
    row = np.searchsorted(offsets, begin, "right") - 1
    return low, begin, end, row


@lru_cache(maxsize=2)
def _literals(path: str) -> re.Pattern:
    """What the tokenizer takes for a token of its own wherever it stands, as bytes."""
    return re.compile(b"|".join(re.escape(t.content.encode()) for t in tokenizer(path)[0].get_added_tokens_decoder().values()) or b"(?!)", re.IGNORECASE)


def tokens(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each row, without the end token, and all ids. A row with the literal of a special token goes to the tokenizer whole."""
    counts, ids = _by_parts(raw, offsets, path)
    found = [m.start() for m in _literals(path).finditer(raw.tobytes())]
    if not found:
        return counts, ids
    lists = np.split(ids, np.cumsum(counts)[:-1])
    for i in np.unique(np.searchsorted(offsets, found, "right") - 1):
        lists[i] = np.array(tokenizer(path)[0].encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
    return np.array([len(x) for x in lists], np.int64), np.concatenate(lists)


def _by_parts(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    low, begin, end, row = pieces(raw, offsets)
    if not len(begin):
        return np.zeros(n, np.int64), np.zeros(0, np.uint32)
    lengths, ids = cached_runs(_cache(path), low, begin, end, lambda i: _encode(path, low, begin[i], end[i]))
    return np.bincount(row, lengths, n).astype(np.int64), ids


def cutter(path: str, most: int):
    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                counts, ids = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path)
                edge = np.concatenate([[0], np.cumsum(counts)])
                doc, piece, start, length, crc = [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[edge[i] : edge[i + 1]], np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), most)):
                        part = own[at : at + most]
                        doc.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, path: str | None = None, most: int = SEQUENCE) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cutter(path or public_tokenizers.path(TOKENIZER), most), out)


_STRETCH = "length long, first long, count long, sequence long, offset long"


def rounds(counts: dict[int, int], most: int = SEQUENCE):
    """Stretches (length, first rank, count, first sequence, offset): rank r gets sequence first + r - first rank.

    gaps[g] are runs (first sequence, count) of sequences with g tokens free; sizes are the g with runs, in order.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    fresh = 0

    def leave(gap, first, count):
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor
            if at == len(sizes):
                new = -(-left // (most // length))
                leave(most, fresh, new)
                fresh += new
                continue
            gap = sizes[at]
            moved = []
            while left and gaps[gap]:
                first, count = gaps[gap].pop()
                took = min(left, count)
                yield length, rank, took, first, most - gap
                moved.append((gap - length, first, took))
                if took < count:
                    gaps[gap].append((first + took, count - took))
                rank, left = rank + took, left - took
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            for x in moved:
                leave(*x)


def stretches(parts: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Which stretch of sequences each stretch of ranks gets, for all lengths."""

    def run(batches):
        counts = {}
        for batch in batches:
            counts |= dict(zip(batch.column("length").to_pylist(), batch.column("n").to_pylist(), strict=True))
        found = rounds(counts, most)
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["length", "first", "count", "sequence", "offset"])

    groups = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most ``most`` rows
    return groups.repartition(1).mapInArrow(run, _STRETCH)


def packed(docs: DataFrame, path: str | None = None, most: int = SEQUENCE) -> DataFrame:
    parts = staged(cut(docs, path, most), "pieces")
    # a bucket of about 50,000 pieces: how many there are is known from the table, not from the driver's plan
    buckets = max(16, parts.count() // 50_000)
    ranked = rank_within(
        parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))),
        "length",
        "_bucket",
        [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")],
        "_rank",
    ).drop("_bucket")
    # A stretch is cut at multiples of STEP, so that a rank finds its own by (length, rank // STEP) and a comparison; large
    # lengths meet in many such cells, not in one.
    table = staged(stretches(parts, most), "stretches")
    cells = table.withColumn("_cell", F.explode(F.sequence(F.expr(f"first div {STEP}"), F.expr(f"(first + count - 1) div {STEP}"))))
    cells = cells.select(F.col("length").alias("_length"), "_cell", "first", "count", "sequence", F.col("offset"))
    own = ranked.withColumn("_own", F.expr(f"_rank div {STEP}"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_own") == F.col("_cell")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("count"))
    joined = own.join(cells.hint("merge"), inside)
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
