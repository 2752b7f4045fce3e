"""What the Jaccard join holds in a task, and how many jobs and rounds it takes."""

import itertools
import tracemalloc
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from lexisift.llm import components as cc
from lexisift.llm import ngram_join


def peak(run):
    """What run() returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        out = run()
        return out, tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


def test_a_flush_and_a_bucket_are_held_once(monkeypatch):
    r = np.random.default_rng(11)
    sets = [np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(1600)]
    sets += [np.union1d(s[:150], r.integers(0, 1 << 63, 150).astype(np.uint64)) for s in sets[:100]]
    monkeypatch.setattr(ngram_join, "_each", lambda batch, size: enumerate(s.copy() for s in batch))
    total = sum(map(len, sets))
    dealt = lambda buckets: list(ngram_join._shingle_rows(buckets, 5, SimpleNamespace(value=np.zeros(0, np.uint64)), total)([sets]))
    rows = dealt(1)  # once before, for what is loaded at first use
    assert peak(lambda: dealt(50))[1] < 42 * total  # with the sets themselves and the rows that go out
    out, most = peak(lambda: list(ngram_join._shared(1)(rows)))
    assert most < 52 * total
    got = [ngram_join._unpack(b, np.int64, np.int64, np.int64, np.int64, np.uint8) for x in out for b in x.column("blob").to_pylist()]
    both = {(int(t), int(d)) for token, d1, *_ in got for t, d in zip(token, d1, strict=True)}
    name = lambda s: ngram_join._digest(s)[0]
    want = {(int(t), d) for a, b in zip(sets[:100], sets[1600:], strict=True) for t in np.intersect1d(a, b) & np.uint64(0xFFFFFFFF) for d in (name(a), name(b))}
    assert want <= both and len(both - want) < 0.01 * total  # besides, shingles of one number


def test_reported_shingles_come_by_one_job(spark):
    rows = [(i, f"one two three four five {i} {i}a {i}b") for i in range(200)]
    digests = ngram_join.digested(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).cache()
    digests.count()
    sc = spark.sparkContext
    sc.setJobGroup("reports", "reports")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(ngram_join.frequent_shingles(digests, 150)) == 1
        assert len(sc.statusTracker().getJobIdsForGroup("reports")) <= 2  # the rows' shuffle and the rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)
        digests.unpersist()


def test_stars_take_no_round(spark, monkeypatch):
    staged, kept = [], cc.staged
    monkeypatch.setattr(cc, "staged", lambda df, name: staged.append(name) or kept(df, name))
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20 + i, 20) for i in range(1, 5)] + [(3, 3)], "a long, b long")
    found = {(r["node"], r["component"]) for r in cc.components(stars, "a", "b").collect()}
    assert found == {(i, 0) for i in range(9)} | {(i, 20) for i in range(20, 25)}
    assert staged == ["edges"]
    none = cc.components(stars.where(F.col("a") == F.col("b")), "a", "b")
    assert none.count() == 0


def test_walks_send_stars(monkeypatch):
    """A chain of sets, each like the next: whatever pairs are found, each class comes with the least."""
    import pyarrow as pa

    own = [np.arange(i * 10, i * 10 + 100, dtype=np.uint64) for i in range(30)]
    r = np.random.default_rng(2)
    names = sorted((int(a), int(b)) for a, b in r.integers(-(1 << 62), 1 << 62, (30, 2)))
    at = r.permutation(30)
    batch = pa.table({"component": [1] * 30, "part": [0] * 30, "d1": [a for a, _ in names], "d2": [b for _, b in names], "blob": [own[i].tobytes() for i in at]}).to_batches()[0]
    got = [((x["a"]["d1"], x["a"]["d2"]), (x["b"]["d1"], x["b"]["d2"])) for out in ngram_join._walks(75)([batch]) for x in out.to_pylist()]
    assert all(ngram_join.similar(a, b, 75) for a, b in itertools.pairwise(own))
    assert sorted(got) == [(x, names[0]) for x in names[1:]]
