"""Sums over the rows of a distributed matrix, and its largest singular vectors from a Gaussian sketch.

The rows lie in Spark, sparse. A pass multiplies a narrow block with the matrix and its transpose: a task adds up its own rows' part, the
parts meet by column, evenly over all reducers, and the driver takes one block of columns x ``BLOCK`` numbers.

The sketch starts from random directions. Each pass is a power round whose block is made orthogonal to all before it, so that the blocks
span a Krylov space; in it the best vectors are found by the eigenvectors of a small matrix. What a pass leaves beyond the space
is all that the vectors in it lack, so the driver holds the space, not its images. Rounds go on until the
residual of every wanted vector is below ``CLOSE`` of its value, which puts the singular values far nearer than that. A space that
has grown to ``SPACE`` times the wanted vectors is drawn together to the best of them. Where the matrix has no more directions the space
is the whole of its row space, and the vectors are as many as the rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators.stages import in_batches, staged

BLOCK, SPACE, CLOSE, PASSES = 64, 8, 1e-6, 80
ROWS = 32  # that lie dense in a task at once, few enough to have few of all columns
FOLD = 32  # columns whose sums a task sends in one row
FEW, SMALL = 32, 1 << 21  # parts and numbers, at most, that the driver adds up itself


def added(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """(height, width) sums of rows (i, x), x the bytes of ``width`` doubles."""

    def summed(batches):
        total, some = np.zeros((height, width)), np.zeros(height, bool)
        for batch in batches:
            i = batch.column("i").to_numpy()
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), float).reshape(len(i), width)
            order = np.argsort(i, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))[: len(i)]
            if len(edge):
                total[i[order][edge]] += np.add.reduceat(x[order], edge)
                some[i] = True
        return total, some

    def run(batches):
        total, some = summed(batches)
        yield from rows_of(np.flatnonzero(some), total[some])

    count = parts.rdd.getNumPartitions()
    if count <= FEW and count * height * width <= SMALL:
        return summed(parts.toArrow().to_batches())[0]
    return summed(in_batches(parts.repartition("i"), run, "i int, x binary").toArrow().to_batches())[0]


def rows_of(i: np.ndarray, x: np.ndarray):
    """Batches (i, x) of the rows of x."""
    kind = pa.binary(x.shape[1] * 8)
    step = max(1, (1 << 18) // x.shape[1])
    for a in range(0, len(i), step):
        own = np.ascontiguousarray(x[a : a + step], float)
        blob = pa.FixedSizeBinaryArray.from_buffers(kind, len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(i[a : a + step].astype(np.int32)), blob], ["i", "x"])


def cut(batch):
    """The rows of a batch (at, v), ``ROWS`` at a time: their number, the columns that any of them has, and the cells and values of a matrix of
    those columns alone."""
    at, v = batch.column("at"), batch.column("v")
    count = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    place, value = at.flatten().to_numpy(), v.flatten().to_numpy()
    edge = np.concatenate([[0], np.cumsum(count)])
    for a in range(0, len(count), ROWS):
        b = min(a + ROWS, len(count))
        s = slice(edge[a], edge[b])
        some, own = np.unique(place[s], return_inverse=True)
        yield b - a, some, np.repeat(np.arange(b - a), count[a:b]) * len(some) + own, value[s]


def tiles(vectors: DataFrame) -> DataFrame:
    """(n, some, cell, x): what ``cut`` tells of the rows (at, v), as bytes, so that a pass neither sorts columns nor takes lists apart."""

    def run(batches):
        for batch in batches:
            found = list(cut(batch))
            blobs = [pa.array([np.ascontiguousarray(t[i], kind).tobytes() for t in found], pa.binary()) for i, kind in ((1, np.int32), (2, np.int32), (3, float))]
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in found], pa.int32()), *blobs], ["n", "some", "cell", "x"])

    return in_batches(vectors.select("at", "v"), run, "n int, some binary, cell binary, x binary")


def uncut(batch):
    """What ``cut`` told, of a batch of tiles."""
    read = lambda c, kind: (np.frombuffer(x, kind) for x in batch.column(c).to_pylist())
    return zip(batch.column("n").to_pylist(), read("some", np.int32), read("cell", np.int32), read("x", float), strict=True)


def dense(batch):
    """The rows of a batch (at, v), or of one of tiles, ``ROWS`` at a time, as the columns that any of them has and a matrix of those columns alone."""
    for n, some, cell, value in uncut(batch) if "cell" in batch.schema.names else cut(batch):
        yield some, np.bincount(cell, value, n * len(some)).reshape(n, len(some))


def gram(vectors: DataFrame, size: int, block: np.ndarray) -> np.ndarray:
    """A'A times the block, A the matrix of the rows (at, v) or of their tiles."""
    sent = vectors.sparkSession.sparkContext.broadcast(block)
    height, width = -(-size // FOLD), block.shape[1]

    def run(batches):
        own = sent.value
        total = np.zeros((height * FOLD, width))
        taken = np.zeros_like(own)  # room that is kept, as fresh memory costs more than the sums
        for batch in batches:
            for some, x in dense(batch):
                here = taken[: len(some)]
                y = x @ np.take(own, some, 0, out=here, mode="clip")
                total[some] += np.matmul(x.T, y, out=here)
        total = total.reshape(height, FOLD * width)
        some = np.flatnonzero(total.any(1))
        yield from rows_of(some, total[some])

    # a task for each core, whatever the rows: every one of them sends a block
    parts = in_batches(vectors.coalesce(vectors.sparkSession.sparkContext.defaultParallelism), run, "i int, x binary")
    try:
        return added(parts, height, FOLD * width).reshape(-1, width)[:size]
    finally:
        sent.unpersist()


def orthogonal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns that span what the block has beyond the basis; none for what is within ``least`` of it."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def singular(vectors: DataFrame, size: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors and the values of the rows (at, v), without centring; k falls to the rank."""
    wide, held = min(BLOCK, size), staged(tiles(vectors))
    rest = gram(held, size, np.random.default_rng(seed).normal(size=(size, wide)))
    largest = np.linalg.norm(rest, 2) if rest.any() else 0.0
    if not largest:
        return np.zeros((size, 0)), np.zeros(0)
    most = max(SPACE * k, 4 * wide)
    space, n = np.zeros((size, min(size, most)), order="F"), 0  # its first n columns are the basis
    small, value, turn = np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0))
    for _ in range(PASSES):
        fresh = orthogonal(rest, space[:, :n], 1e-13 * largest)
        if not fresh.shape[1]:
            break
        if n + fresh.shape[1] > space.shape[1]:  # what the best vectors lack lies in the fresh block as well
            n = k + wide
            space[:, :n] = space[:, : len(turn)] @ turn[:, :n]
            small = np.diag(value[:n])
        a, n = n, n + fresh.shape[1]
        space[:, a:n] = fresh
        basis, block = space[:, :n], gram(held, size, fresh)
        side = basis.T @ block
        small = np.block([[small, side[:a]], [side[:a].T, (side[a:] + side[a:].T) / 2]])
        rest = block - basis @ side
        rest -= basis @ (basis.T @ rest)
        value, turn = np.linalg.eigh(small)
        value, turn = value[::-1], turn[:, ::-1]
        largest = value[0]
        if n >= k:
            lack = np.linalg.norm(np.linalg.qr(rest, "r") @ turn[a:, :k], axis=0)
            if (lack <= np.maximum(CLOSE * value[:k], 1e-13 * largest)).all():
                break
    k = int((value[:k] > 1e-12 * value[0]).sum())  # squares below are rounding
    return space[:, :n] @ turn[:, :k], np.sqrt(value[:k])
