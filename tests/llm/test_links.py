"""The Jaccard join with repeated ids, narrow hashes, frequent shingles and small blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexisift.llm import ngram_join


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """By row, as ids repeat: the smallest id among the rows reachable from it."""
    own = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
            up[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(own[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"], r["n"], r["component_id"]) for r in df.collect())


def rows_of(n, seed):
    r = random.Random(seed)
    seeds = [[f"w{r.randrange(400)}" for _ in range(r.randrange(30, 90))] for _ in range(9)]
    common = [f"c{i}" for i in range(8)]  # in every document
    out = []
    for i in range(n):
        w = common + list(r.choice(seeds))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(8, len(w))] = f"w{r.randrange(400)}"
        out.append((r.randrange(n), " ".join(w)))  # ids repeat
    return out


@pytest.mark.parametrize("bits,frequent,block,lot", [(3, 8192, 1024, 1 << 22), (32, 40, 16, 1 << 22), (32, 5, 1024, 50), (3, 5, 1024, 50)])
def test_components(spark, monkeypatch, bits, frequent, block, lot):
    monkeypatch.setattr(ngram_join, "_LOT", lot)
    monkeypatch.setattr(ngram_join, "KNOWN_FREQUENT", 1 if lot == 50 else 1 << 20)  # one: no shingle is known before
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = rows_of(160, bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_join.joined(docs, bits=bits)) == components(rows)


def test_repeated_ids(spark):
    r = random.Random(5)
    base = [f"a{i}" for i in range(200)]
    change = lambda w, k: [x if i not in set(r.sample(range(len(w)), k)) else f"z{r.random()}" for i, x in enumerate(w)]
    b = base[:170] + [f"b{i}" for i in range(40)]
    rows = [(1, "nothing like the others at all here"), (1, " ".join(base)), (1, " ".join(b)), (0, " ".join([*b, "q"])), (5, " ".join([*base, "q"])), (7, " ".join(["p", *b]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    assert got(ngram_join.joined(docs)) == want and (1, 3, 1) in want
    left = ngram_join.one_of_each(docs.withColumns({"n": F.lit(1), "d1": F.lit("x"), "component_id": F.lit(2), "_gone": F.lit(3)}))
    assert left.columns == ["doc_id", "text", "n", "d1", "component_id", "_gone"]
    assert rows[0] in {(r["doc_id"], r["text"]) for r in left.collect()}
    with pytest.raises(TypeError):
        ngram_join.links(docs.withColumn("doc_id", F.lit("x")))


def test_stars_stay_whole(spark, monkeypatch):
    """Components with hot nodes, by numbers and by structs."""
    from lexisift.llm import components as cc

    monkeypatch.setattr(cc, "HOT", 8)
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(12)] + [(r.randrange(200, 240), 250) for _ in range(30)] + [(250, 39), (7, 7)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r["node"], r["component"]) for r in cc.components(df, "a", "b").collect()} == {(x, find(x)) for x in up}
    pairs = df.select(F.struct(F.col("a").alias("d1"), F.lit(1).alias("d2")).alias("a"), F.struct(F.col("b").alias("d1"), F.lit(1).alias("d2")).alias("b"))
    assert {(r["node"]["d1"], r["component"]["d1"]) for r in cc.components(pairs, "a", "b").collect()} == {(x, find(x)) for x in up}


def test_no_bucket_holds_a_frequent_shingle():
    """One shingle at 50 times the limit in one bucket: its rows go out as they come."""
    import numpy as np

    limit, n = 20, 1000
    sets = [np.array([7], np.uint64)] * n
    blobs = []
    for a in range(0, n, 10):
        token = np.concatenate(sets[a : a + 10]).astype(np.uint32)
        order = np.argsort(token, kind="stable")
        planes = lambda x: np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
        doc = np.arange(10)[order]
        blobs.append(ngram_join._pack(np.arange(a, a + 10), np.full(10, 1), np.zeros(10, np.int64), planes(np.diff(token[order], prepend=np.uint32(0))), planes(doc)))
    rows = ngram_join._rows(ngram_join._SHINGLE, [0] * len(blobs), blobs)
    out = list(ngram_join._shared(1, limit, 4 * limit)([rows]))
    parts = [ngram_join._unpack(b, np.int64, np.int64, np.int64, np.int64, np.uint8) for x in out for b in x.column("blob").to_pylist()]
    assert max(len(p[0]) for p in parts) <= 4 * limit + 10  # what had come when the limit was noticed
    assert {int(t) for p in parts for t in p[0]} == {7} and sorted(int(d) for p in parts for d in p[1]) == list(range(n))
    assert {int(x) for p in parts for x in p[4]} == {ngram_join._FAR}
