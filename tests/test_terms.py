"""The most frequent terms against plain counting, with few counters and with many."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from lexisift.operators import terms as te

R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]
ROWS = [[WORDS[min(399, int(R.paretovariate(0.7)) - 1)] for _ in range(R.randrange(0, 60))] for _ in range(600)] + [None, [], ["w0"], ["once"] * 900]


def plain(most, least):
    total, df = Counter(), Counter()
    for words in ROWS:
        own = Counter(" ".join((words or [])[i : i + n]) for n in (1, 2, 3) for i in range(len(words or []) - n + 1))
        total += own
        df.update(own.keys())
    order = sorted((t for t in total if df[t] >= least), key=lambda t: (-total[t], t))[:most]
    return [(t, df[t], total[t]) for t in order]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(ROWS)], "id long, words array<string>").repartition(5).cache()


@pytest.mark.parametrize("most,held", [(50, 1 << 19), (50, 1500), (50, 60), (3000, 1 << 19), (10**6, 1 << 19), (10**6, 100)])
def test_top_terms(rows, most, held):
    assert [tuple(r) for r in te.top_terms(rows, most, 2, held).collect()] == plain(most, 2)


def test_few_counters_are_enough(rows, monkeypatch):
    """Where the bound separates, the candidates are counted again and nothing else is."""
    calls = []
    monkeypatch.setattr(te, "recounted", lambda *a, f=te.recounted: calls.append(len(a[1])) or f(*a))
    monkeypatch.setattr(te, "LOT", 500)
    assert [tuple(r) for r in te.top_terms(rows, 10, 2, 1000).collect()] == plain(10, 2)
    assert len(calls) == 1 and 10 <= calls[0] <= 80


def test_a_summary_falls_short_by_its_bound():
    table = pa.table({"term": ["a", "b", "c", "d"], "total": [9, 4, 4, 1], "df": [2, 2, 1, 1]})
    left, short = te.shortened(table, 2)
    assert short == 4 and left.to_pydict() == {"term": ["a"], "total": [5], "df": [2]}
    assert te.shortened(table, 4) == (table, 0)


def test_grams():
    row, term = te.grams(pa.array([["a", "b", "c"], None, [], ["d"], ["e", "f"]]))
    assert sorted(zip(row.tolist(), term.to_pylist())) == sorted([(0, "a"), (0, "b"), (0, "c"), (0, "a b"), (0, "b c"), (0, "a b c"), (3, "d"), (4, "e"), (4, "f"), (4, "e f")])
    assert te.grams(pa.array([], pa.list_(pa.string())))[0].tolist() == []
