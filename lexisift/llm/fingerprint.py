"""Quartile bucket digests of documents.

A digest counts the hashed byte triplets of a sliding window of five bytes in 128 buckets and writes for each
bucket the quartile that its count lies in (two bits), after a header of the length, on a logarithmic scale. Two
digests are compared by a score bounded by 0 and 1: 1 for equal ones, less for each quartile that a bucket is off, and
for the difference in length.

Defined cases: a null text counts as empty; texts too short for a triplet have a digest of zero buckets and their
length, and equal texts always have equal digests; an empty table gives an empty result. Documents are in ascending
doc_id, nulls first; repeated ids follow one another in the order of their texts' hashes. The document after the last
is the first; one alone is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexisift.llm.common import slices, staged, utf8

BUCKETS = 128
#: A quartile off costs 1, two cost 2, three cost 6; a sum of SPAN or more is a likeness of 0.
COST = np.array([0, 1, 2, 6], np.float64)
SPAN = 240.0

_PEARSON = np.random.default_rng(7).permutation(256).astype(np.uint8)


def buckets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all rows' triplets: (rows, BUCKETS). Of each window of five bytes its four triplets that hold the last."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * BUCKETS, np.int64)
    for salt, (i, j) in zip((2, 3, 5, 7), ((1, 2), (1, 3), (2, 3), (1, 4)), strict=True):
        if len(raw) <= j:
            continue
        h = _PEARSON[_PEARSON[_PEARSON[raw[j:] ^ salt] ^ raw[j - i : len(raw) - i]] ^ raw[: len(raw) - j]]
        inside = row[j:] == row[: len(raw) - j]
        key = row[j:] * BUCKETS + (h >> 1)
        out += np.bincount(key[inside], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 1 + BUCKETS): the length's class, then each bucket's quartile."""
    counts = buckets(raw, offsets)
    ranked = np.sort(counts, axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > q[:, None, :]).sum(2)
    size = np.floor(np.log2(np.diff(offsets) + 1.0) * 8).astype(np.int64)
    return np.column_stack([np.minimum(size, 255), code]).astype(np.uint8)


def written(digest: np.ndarray) -> list[str]:
    """Hexadecimal text of each digest: two digits of length, then four quartiles to a byte."""
    code = digest[:, 1:].reshape(len(digest), -1, 4)
    packed = (code * np.array([64, 16, 4, 1], np.uint8)).sum(2).astype(np.uint8)
    return [bytes(x).hex() for x in np.column_stack([digest[:, :1], packed])]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    off = COST[np.abs(a[:, 1:].astype(np.int64) - b[:, 1:])].sum(1)
    size = np.maximum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]) - 1, 0) * 4.0
    return 1.0 - np.minimum(off + size, SPAN) / SPAN


def _edited(own: str, following: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ids: pa.Array, text: list[str]) -> list:
    """The columns of ``_NAMES`` for all texts but the last, each beside the one after it."""
    n = len(text) - 1
    raw, offsets = utf8(pa.array(text))
    changed = [_edited(text[i], text[i + 1]).encode() for i in range(n)]
    raw2, offsets2 = utf8(pa.array(changed, pa.binary()))
    own, new = digests(raw, offsets), digests(raw2, offsets2)
    return [
        ids.slice(0, n),
        pa.array([len(x) for x in text[:n]], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
        pa.array(written(own[:n]), pa.string()),
        pa.array(written(new), pa.string()),
        pa.array(likeness(own[:n], new), pa.float64()),
        pa.array(likeness(own[:n], own[1:]), pa.float64()),
    ]


def _walk(batches):
    """Rows of a sorted partition, each beside the next; the partition's first and last rows go out with their texts."""
    part = TaskContext.get().partitionId()
    held, first = None, True

    def edge(table, kind):
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([table.column("doc_id"), *blank, pa.array([part]), pa.array([kind]), table.column("text")], [*_NAMES, "_part", "_edge", "_text"])

    for batch in batches:
        for a, b in slices(utf8(batch.column("text"))[1], 1 << 18):
            now = batch.slice(a, b - a)
            if first:
                yield edge(now.slice(0, 1), 0)
                first = False
            table = now if held is None else pa.concat_batches([held, now])
            if table.num_rows > 1:
                done = _compared(table.column("doc_id"), [x or "" for x in table.column("text").to_pylist()])
                m = table.num_rows - 1
                yield pa.RecordBatch.from_arrays([*done, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())], [*_NAMES, "_part", "_edge", "_text"])
            held = table.slice(table.num_rows - 1, 1)
    if held is not None:
        yield edge(held, 1)


def _bridge(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            pair = [batch.column("_text")[i].as_py() or "", batch.column("_next")[i].as_py() or ""]
            ids = pa.concat_arrays([batch.column("doc_id").slice(i, 1)] * 2)
            yield pa.RecordBatch.from_arrays(_compared(ids, pair), _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents are sorted by range; what a partition can't see, its last row's next one, is added from the edges.

    The numbers of the partitions with rows, and no texts, are put in order; by them each last row meets one first row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    own = docs.select("doc_id", "text").withColumn("_order", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_order")]
    sorted_ = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = staged(sorted_.mapInArrow(_walk, f"{out}, _part long, _edge long, _text string"), "fingerprints")
    parts = rows.where("_edge = 0").select("_part")
    numbers = W.orderBy("_part")
    after = parts.select(
        F.col("_part").alias("_last"),
        F.coalesce(F.lead("_part").over(numbers), F.min("_part").over(numbers.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_follows"),
    )
    first = rows.where("_edge = 0").select(F.col("_part").alias("_first"), F.col("_text").alias("_next"))
    ends = rows.where("_edge = 1").select("doc_id", "_text", "_part")
    ends = ends.join(after, F.col("_part") == F.col("_last")).join(first.hint("merge"), F.col("_follows") == F.col("_first"))
    last = ends.select("doc_id", "_text", "_next").mapInArrow(_bridge, out)
    return rows.where(F.col("_edge").isNull()).select(*_NAMES).unionByName(last)
