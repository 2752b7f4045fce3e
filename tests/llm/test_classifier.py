"""The quality classifier in its parts: vectors by hand, the temperature by its grid, and what it must not learn from."""

import random
import zlib

import numpy as np
import pytest

from lexisift.llm import quality_classifier as qc

R = random.Random(3)
WORDS = "alpha Beta gamma delta épsilon zeta eta theta Iota kappa".split()
ROWS = [(i, " ".join(R.choice(WORDS[: 3 if i % 5 == 0 else 10]) for _ in range(R.randrange(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, " \n")]


def hashes(words):
    """(word, shape) hashes of single words."""
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        word, shape = qc._rows_of(raw, np.array([0]), np.array([len(raw)]))
        out.append((word, shape))
    return out


def test_context_vectors_by_hand(spark):
    table = np.zeros((qc.ROWS, qc.DIMS))
    for _, text in ROWS:
        own = hashes((text or "").split())
        for t in range(len(own)):
            for s in range(len(own)):
                if 1 <= abs(t - s) <= 2:
                    place, sign = qc._index(own[s][0])
                    for k in range(2):
                        table[qc._row(own[t][0])[0], place[0, k]] += sign[0, k]
                if abs(t - s) == 1:
                    place, sign = qc._index(own[s][1])
                    for k in range(2):
                        table[qc._row(own[t][1])[0], place[0, k]] += sign[0, k]
    want = np.sign(table) * np.log1p(np.abs(table))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    got = qc.word_vectors(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3))
    assert np.allclose(got, want, atol=1e-5)
    from lexisift.llm.common import utf8
    import pyarrow as pa

    raw, offsets = utf8(pa.array([t or "" for _, t in ROWS]))
    pooled = qc.pooled(raw, offsets, got)
    for i, (_, text) in enumerate(ROWS):
        words = (text or "").split()
        own = hashes(words)
        if not own:
            assert not pooled[i].any()
            continue
        assert np.allclose(pooled[i, : qc.DIMS], np.mean([want[qc._row(w)[0]] for w, _ in own], 0), atol=1e-4)
        assert np.allclose(pooled[i, qc.DIMS : 2 * qc.DIMS], np.mean([want[qc._row(s)[0]] for _, s in own], 0), atol=1e-4)
        assert np.isclose(pooled[i, -3], sum(a == b for a, b in zip(words, words[1:])) / len(words)) and np.isclose(pooled[i, -1], np.log1p(len(words)))


def test_network_and_temperature():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] + 0.3 * r.normal(size=600) > 0).astype(float)
    net = qc.Network(x, y, epochs=150)
    assert ((net.scores(x) > 0.5) == (y > 0.5)).mean() > 0.85  # no linear model gets beyond chance
    held = np.random.default_rng(5).random(600) < 0.15
    grid = np.geomspace(0.25, 8, 101)
    loss = [np.mean(np.log1p(np.exp(np.where(y[held] > 0, -1, 1) * net.logits(x[held]) / t))) for t in grid]
    assert net.temperature == pytest.approx(grid[int(np.argmin(loss))])
    assert np.allclose(net.scores(x), 1 / (1 + np.exp(-net.logits(x) / net.temperature)))


def test_a_step_follows_the_gradient():
    """After one step of Adam every weight has moved by the rate against the sign of its numeric gradient."""
    r = np.random.default_rng(2)
    x, y = r.normal(size=(12, 3)), (r.random(12) > 0.5).astype(float)
    # with 12 rows all are learned from, in one batch, unless more than ten are left after the held ones go
    held = np.random.default_rng(5).random(12) < 0.15
    learn = np.flatnonzero(~held) if (~held).sum() > 10 else np.arange(12)
    before, after = qc.Network(x, y, epochs=0, decay=0.0), qc.Network(x, y, epochs=1, rate=1e-3, decay=0.0)
    z = ((x - x.mean(0)) / (x.std(0) + 1e-3))[learn]

    def loss(w):
        p = 1 / (1 + np.exp(-(np.tanh(z @ w[0] + w[1]) @ w[2] + w[3])))
        return -np.mean(y[learn] * np.log(p) + (1 - y[learn]) * np.log(1 - p))

    for k in range(4):
        for i in list(np.ndindex(before.w[k].shape))[:20]:
            w = [a.copy() for a in before.w]
            w[k][i] += 1e-6
            slope = (loss(w) - loss(before.w)) / 1e-6
            if abs(slope) > 1e-4:
                assert after.w[k][i] - before.w[k][i] == pytest.approx(-1e-3 * np.sign(slope), rel=0.02)


def test_held_out_labels_are_not_seen(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    held = {d for d, _ in ROWS if zlib.crc32(str(d).encode()) % 4 == 2}
    labels = [(d, int(d % 5 > 0)) for d, _ in ROWS]
    flipped = [(d, 1 - q if d in held else q) for d, q in labels]
    a, b = (sorted(tuple(r) for r in qc.classified(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped))
    assert a == b and {r[0] for r in a if r[1]} == held and all(r[3] == (r[2] >= 0.7) for r in a)
    none = qc.classified(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qc.classified(docs.where("doc_id < 0"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
