"""Density clusters over cells against plain ones, on dense groups, chains, copies and noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.operators import density as dn


def plain(x, eps, least):
    """Labels and cores, pair by pair; rows are numbered by their place."""
    near = np.round(1 - x @ x.T, 9) <= eps
    core = near.sum(1) >= least
    low = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], low[None], len(x)).min(1), len(x))
        if (new == low).all():
            break
        low = new
    border = np.where(near & core[None], low[None], len(x)).min(1)
    low = np.where(core, low, border)
    names = {k: i for i, k in enumerate(sorted(set(low[core].tolist())))}
    return [(names.get(k, -1), bool(c)) for k, c in zip(low.tolist(), core, strict=True)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cases():
    r = np.random.default_rng(3)
    around = lambda c, n, s: np.asarray(c) + r.normal(0, s, (n, len(c)))
    turn = np.linspace(0, 1.4, 60)
    yield "groups", unit(np.concatenate([around([1, 0, 0, 0], 80, 0.05), around([0, 1, 0, 0], 60, 0.2), around([0, 0, 1, 0.4], 9, 0.01), r.normal(size=(60, 4))])), 0.02
    yield "chain of dense knots", unit(np.concatenate([around([np.cos(t), np.sin(t), 0], 12, 0.004) for t in turn[::6]])), 0.01
    yield "arc", unit(np.stack([np.cos(turn), np.sin(turn), 0 * turn], 1).repeat(3, 0) + r.normal(0, 0.002, (180, 3))), 0.004
    yield "copies", unit(np.concatenate([np.repeat([[1.0, 0, 0]], 25, 0), np.repeat([[0.9, 0.3, 0]], 3, 0), around([0, 1, 1], 30, 0.3)])), 0.05
    yield "wide", unit(r.normal(size=(300, 8))), 0.3


@pytest.mark.parametrize("name,x,eps", list(cases()), ids=[c[0] for c in cases()])
def test_clusters(spark, monkeypatch, name, x, eps):
    x = x[np.random.default_rng(1).permutation(len(x))]
    monkeypatch.setattr(dn, "BLOCK", 40)
    z = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, z array<double>").repartition(4)
    got = sorted(tuple(r) for r in dn.density(z, eps, 10).collect())
    assert [(c, k) for _, c, k in got] == plain(x, eps, 10) and [i for i, _, _ in got] == list(range(len(x)))


def test_cells_are_found_and_linked(spark):
    x = dict((n, v) for n, v, _ in cases())["chain of dense knots"]
    z = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "id long, w long, z array<double>")
    cells, found = dn.dense_cells(z, 0.01, 10)
    assert len(found) >= 5 and cells.where("cell >= 0").count() > len(x) / 2
    assert dn._linked(cells.where("cell >= 0"), found, 0.04, "bigint")


@pytest.mark.parametrize("apart", [0.0, 0.01])
def test_dense_groups_stay_linear(spark, monkeypatch, apart):
    """20,000 equal vectors, or as many within a small cap: no more rows between the steps than vectors."""
    r = np.random.default_rng(2)
    x = unit(np.array([1.0, 0, 0, 0]) + r.normal(0, apart, (20_000, 4)) if apart else np.repeat([[1.0, 0, 0, 0]], 20_000, 0))
    z = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(30_000, [0.0, 1.0, 0.0, 0.0]), (30_001, [0.0] * 4)], "vec_id long, z array<double>")
    made = []
    keep = dn.staged

    def watched(df):
        out = keep(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(dn, "staged", watched)
    got = dn.density(z, 0.1, 10)
    assert {tuple(x) for x in got.groupBy("cluster").count().collect()} == {(0, 20_000), (-1, 2)}
    assert got.where(F.col("is_core")).count() == 20_000 and max(made) <= 21_000
    one = dn.summary(z.where("vec_id >= 30000"), 0.1, 10).first()
    assert tuple(one) == (0, 0, 2, 0) and dn.density(z.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("width,eps", [(16, 0.5), (3, 0.02)])
def test_vectors_are_sent_a_bounded_number_of_times(spark, monkeypatch, width, eps):
    """Thrice the vectors: thrice the rows that meet, whether pivots help or not, and no more rows between the steps than that."""
    monkeypatch.setattr(dn, "BLOCK", 16)
    monkeypatch.setattr(dn, "TILE", 32)
    sent, made, keep, groups = [], [], dn.staged, dn._in_groups
    monkeypatch.setattr(dn, "_in_groups", lambda df, *a: sent.append(df.count()) or groups(df, *a))

    def watched(df):
        out = keep(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(dn, "staged", watched)
    r, most = np.random.default_rng(4), []
    for n in (400, 1200):
        sent.clear(), made.clear()
        x = unit(r.normal(size=(n, width)))
        z = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, z array<double>")
        got = sorted(tuple(r) for r in dn.density(z, eps, 10).collect())
        assert [(c, k) for _, c, k in got] == plain(x, eps, 10)
        most.append(max(sent) / n)
        assert max(made) <= 2 * dn.PARTS * n
        assert sum(r["n"] for r in dn.counts(z, eps).collect()) == (np.round(1 - x @ x.T, 9) <= eps).sum() == dn.neighbours(z, eps).distinct().count() == dn.neighbours(z, eps).count()
    assert max(most) <= 3 * dn.PARTS and most[1] <= 1.5 * most[0]
