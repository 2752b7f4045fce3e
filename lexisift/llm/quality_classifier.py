"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse random index vector, drawn from its hash. The context vector of a word is the sum of the index
vectors of its neighbours over the whole corpus; words share ``ROWS`` hashed rows, which bounds the table. A word's
shape (capitals and last two bytes) is indexed beside it, so that words never seen have a vector too. A document is the
mean of its words' and its shapes' vectors, with how much its index vectors agree with each other and with those
beside them, which repetition raises. A two-layer numpy network learns the labels of at most ``SAMPLE`` rows on the
driver, and a temperature fitted on part of them calibrates its probabilities. Only rows whose
crc32(doc_id as text) mod 4 is not 2 are learned from; label, lang, source and doc_id are no inputs.

Defined cases: a null text counts as empty; texts without words have zero vectors and are scored like any other; a
null doc_id is not held out; without labels every score is 0.5; repeated labels of one document count once, the smaller
one; where one doc_id has many rows, fewer than ``SAMPLE`` rows may be learned from; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.llm.common import slices, staged, utf8
from lexisift.llm.vectext import mix, word_hash, words

ROWS, DIMS, PARTS = 1 << 15, 64, 16
SAMPLE = 20_000
HIDDEN = 32
CUT = 0.7
_POOLED = 2 * DIMS + 4


def _rows_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their shapes."""
    word = word_hash(raw, start, end)
    head, tail = raw[start].astype(np.uint64), raw[end - 1].astype(np.uint64)
    before = raw[np.maximum(end - 2, start)].astype(np.uint64)
    capital = ((head >= 65) & (head <= 90)).astype(np.uint64)
    return word, mix(capital << np.uint64(40) | tail << np.uint64(16) | before << np.uint64(4))


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs of each index vector."""
    place = np.stack([(hashes >> np.uint64(k)) % np.uint64(DIMS) for k in (20, 32)], 1).astype(np.int64)
    sign = np.stack([(hashes >> np.uint64(k)) & np.uint64(1) for k in (50, 51)], 1).astype(np.int64) * 2 - 1
    return place, sign


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(ROWS)).astype(np.int64)


def _contexts(batches):
    """Partial sums of context vectors: one blob for each part of the table."""
    table = np.zeros(ROWS * DIMS, np.int64)
    for batch in batches:
        every, bounds = utf8(batch.column("text"))
        for a, b in slices(bounds):
            raw, offsets = every[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            start, end, doc = words(raw, offsets)
            if not len(start):
                continue
            word, shape = _rows_of(raw, start, end)
            place, sign = _index(word)
            near, near_sign = _index(shape)
            row, shape_row = _row(word) * DIMS, _row(shape) * DIMS
            for gap in (1, 2):
                same = np.flatnonzero(doc[gap:] == doc[:-gap])
                for target, source in ((same, same + gap), (same + gap, same)):
                    for k in range(2):
                        np.add.at(table, row[target] + place[source, k], sign[source, k])
                        if gap == 1:
                            np.add.at(table, shape_row[target] + near[source, k], near_sign[source, k])
    cut = table.reshape(PARTS, -1).astype(np.int32)  # sums of signs are whole numbers, and small ones pack well
    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(x) for x in cut], pa.binary())], ["part", "blob"])


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    size = ROWS // PARTS * DIMS * 4
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            own = _unpacked(blob)
            total[part] = own.astype(np.int64) if part not in total else total[part] + own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["part", "blob"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(ROWS, DIMS) unit context vectors. The table has a fixed size, whatever the corpus."""
    sums = docs.select("text").mapInArrow(_contexts, "part int, blob binary").repartitionById(PARTS, F.col("part")).mapInArrow(_summed, "part int, blob binary")
    table = np.zeros((PARTS, ROWS // PARTS * DIMS), np.float32)
    for r in sums.collect():  # PARTS rows
        table[r["part"]] = np.frombuffer(r["blob"], np.float32)
    table = table.reshape(ROWS, DIMS)
    table = np.sign(table) * np.log1p(np.abs(table))
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def _mean(table: np.ndarray, rows: np.ndarray, lot: int = 1 << 14) -> np.ndarray:
    return sum(table[rows[at : at + lot]].sum(0) for at in range(0, len(rows), lot)) / np.float32(len(rows))


def pooled(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, _POOLED), np.float32)
    start, end, doc = words(raw, offsets)
    if not len(start):
        return out
    word, shape = _rows_of(raw, start, end)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    own, count = doc[edge], np.diff(np.append(edge, len(doc))).astype(np.float32)
    row, shape_row = _row(word), _row(shape)
    for i, a, size in zip(own, edge, count.astype(np.int64), strict=True):  # a sum a document: reduceat over rows takes many times as long
        out[i, :DIMS] = _mean(table, row[a : a + size])
        out[i, DIMS : 2 * DIMS] = _mean(table, shape_row[a : a + size])
    place, sign = _index(word)
    sums = np.zeros((n, DIMS), np.float32)
    for k in range(2):
        np.add.at(sums.ravel(), doc * DIMS + place[:, k], sign[:, k].astype(np.float32))
    out[own, -4] = (sums[own] ** 2).sum(1) / (2 * count**2)
    for at, gap in ((-3, 1), (-2, 2)):
        if len(word) > gap:
            same = ((word[gap:] == word[:-gap]) & (doc[gap:] == doc[:-gap])).astype(np.float32)
            out[own, at] = np.bincount(doc[gap:], same, n)[own] / count
    out[own, -1] = np.log1p(count)
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh, one logit; Adam on the log loss, then a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = ((x - self.mean) / self.scale).astype(np.float64)
        held = r.random(len(z)) < 0.15
        learn = np.flatnonzero(~held) if (~held).sum() > 10 else np.arange(len(z))
        w = [r.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            r.shuffle(learn)
            for at in range(0, len(learn), 256):
                i = learn[at : at + 256]
                h = np.tanh(z[i] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - y[i]) / len(i)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[i].T @ back + decay * w[0], back.sum(0), h.T @ d + decay * w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if held.sum() > 10:
            logit, label = self.logits(x[held]), y[held]
            loss = [np.mean(np.logaddexp(0, np.where(label > 0, -1, 1) * logit / t)) for t in np.geomspace(0.25, 8, 101)]
            self.temperature = float(np.geomspace(0.25, 8, 101)[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3], -30, 30)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def vectors(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, vector) of each document, the vector as float16 bytes: half the size, and far finer than the classes."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets):
                x = pooled(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["doc_id", "vector"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, vector binary")


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    held = staged(vectors(docs, word_vectors(docs)), "vectors")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~is_held_out(F.col("doc_id")))
    # bounded by the parameter: the rows with the smallest hashes of their ids. A top-k alone would have every task send
    # the driver its own k, and all vectors shuffled, so rows past the hash that k rows surely lie below go first.
    total = held.select("doc_id").join(known.select("doc_id"), "doc_id").count()
    order, reach = F.xxhash64("doc_id"), (sample + 8 * sample**0.5 + 64) / max(total, 1)
    near = held.where(order < F.lit(int(reach * 2**64) - 2**63)) if reach < 1 else held
    rows = near.join(known, "doc_id").orderBy(order, "doc_id").select("vector", "quality").limit(sample).collect()
    network = None
    if rows:
        x = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float16).astype(np.float64).reshape(len(rows), -1)
        network = Network(x, np.array([float(r["quality"]) for r in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float16).astype(np.float64).reshape(batch.num_rows, _POOLED)
            score = shared.value.scores(x) if shared.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = held.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    from lexisift.llm.common import documents

    return classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
