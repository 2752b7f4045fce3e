"""Products with a distributed matrix: few columns at a time, as many sums as cores."""

import numpy as np
import pyarrow as pa

from lexisift.operators import matrix as mx
from lexisift.operators import model as mo
from lexisift.operators import terms as te


def test_a_task_for_each_core_sends_sums(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(sorted(r.choice(50, 6, False).tolist()), r.normal(size=6).tolist()) for _ in range(300)] + [([], [])]
    x = np.zeros((len(rows), 50))
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    block, seen = r.normal(size=(50, 4)), []
    monkeypatch.setattr(mx, "added", lambda parts, *a, f=mx.added: seen.append(parts.rdd.getNumPartitions()) or f(parts, *a))
    vectors = spark.createDataFrame(rows, "at array<int>, v array<double>").repartition(30)
    assert np.allclose(mx.gram(vectors, 50, block), x.T @ x @ block)
    assert seen[0] <= spark.sparkContext.defaultParallelism


def test_only_the_columns_of_a_few_rows_are_dense():
    batch = pa.record_batch({"at": pa.array([[3, 900_000], [3], []], pa.list_(pa.int32())), "v": pa.array([[1.0, 2.0], [4.0], []])})
    (some, x), = mx.dense(batch)
    assert some.tolist() == [3, 900_000] and x.tolist() == [[1.0, 2.0], [4.0, 0.0], [0.0, 0.0]]


def test_batches_are_cut_by_words(monkeypatch):
    monkeypatch.setattr(te, "lots", lambda lists, f=te.lots: f(lists, 10))
    batch = pa.record_batch({"k": pa.array(range(6)), "words": pa.array([["a"] * 4, ["b"] * 4, ["c"] * 30, None, [], ["d"] * 9])})
    parts = list(mo.in_lots([batch]))
    assert [p.num_rows for p in parts] == [2, 1, 3] and [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))


def test_a_flat_spectrum_takes_few_passes(spark, monkeypatch):
    """A space that is drawn together goes on from what its best vectors lack."""
    r, passes = np.random.default_rng(3), []
    x = r.normal(size=(900, 800)) * np.linspace(1, 1.5, 800)
    rows = spark.createDataFrame([([0], [1.0])], "at array<int>, v array<double>")
    monkeypatch.setattr(mx, "gram", lambda rows, size, block: passes.append(block.shape) or x.T @ (x @ block))
    v, s = mx.singular(rows, 800, 20)
    assert np.allclose(s, np.linalg.svd(x)[1][:20], rtol=1e-10) and np.allclose(v.T @ v, np.eye(20))
    assert np.allclose(x.T @ (x @ v), v * s**2, atol=1e-5 * s[0] ** 2)
    assert len(passes) <= 20


def test_tiles_hold_the_rows(spark):
    r = np.random.default_rng(2)
    rows = [(sorted(r.choice(90, 7, False).tolist()), r.normal(size=7).tolist()) for _ in range(75)] + [([], [])]
    x = np.zeros((len(rows), 90))
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    held = mx.tiles(spark.createDataFrame(rows, "at array<int>, v array<double>").repartition(3))
    assert sum(t["n"] for t in held.collect()) == len(rows)
    block = r.normal(size=(90, 3))
    assert np.allclose(mx.gram(held, 90, block), x.T @ x @ block)
