"""Periodic runs against a plain search, on random, periodic and hard sequences of words."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lexisift.llm import periodic

SCHEMA = "doc_id long, text string"


def plain(w):
    """(start, length, period) of all runs."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, size = i, j + q - i
            if size >= max(6, 4 * q) and not any(all(w[k] == w[k + x] for k in range(s, s + size - x)) for x in range(1, q)):
                out.append((s, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = plain(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts(n, seed=3):
    r = random.Random(seed)
    for _ in range(n):
        words = "a b c dd é \U0001f600 lorem ipsum dolor sit amet".split()[: r.choice([1, 2, 3, 11])]
        w = [r.choice(words) for _ in range(r.randrange(0, 70))]
        for _ in range(r.randrange(0, 3)):
            u = [r.choice(words) for _ in range(r.randrange(1, 9))]
            x = r.randrange(0, len(w) + 1)
            w[x:x] = (u * 9)[: r.randrange(4, 9) * len(u) + r.randrange(0, len(u))]
        yield r.choice([" ", "\n", " \t\x0b\x0c\r "]).join(w)


def test_all_columns(spark, monkeypatch):
    monkeypatch.setattr(periodic, "LOT", 3000)
    rows = list(enumerate(texts(400))) + [(None, "x " * 40), (7, "x y " * 40), (7, "x y " * 40), (1001, None), (1002, ""), (1003, " \n "), (1004, "z" * 3000), (1005, "a a " * 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS period", "2 AS runs").repartition(3)
    got = periodic.periodic(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(row(*r)) for r in rows)
    assert periodic.periodic(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_and_text_go_out(spark):
    df = spark.createDataFrame([(1, "so so so so so so it is")], SCHEMA)
    r = periodic.periodic(df, loops=False, runs_too=True).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 6, 1)] and r["collapsed"] == "so it is"


@pytest.mark.parametrize("pairs", [7, 1 << 21])
def test_sequences(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    r, fib = random.Random(1), [b"a"]
    before = [b"b"]
    while len(fib) < 400:
        fib, before = fib + before, fib
    cases = [fib, [b"a"] * 300, [b"a", b"b"] * 150, ([b"a"] * 7 + [b"b"]) * 30, [], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 3 + [b"a"], [b"a", b"b"] * 4]
    cases += [[bytes([97 + r.randrange(2)]) for _ in range(200)] for _ in range(20)]
    assert periodic.found_in(cases) == [plain(w) for w in cases]


def test_the_tree_is_that_of_the_suffixes():
    """Depths and leaf lists of the inner nodes: every common prefix of two suffixes that can be read on in two ways."""
    r = np.random.default_rng(2)
    s = np.append(r.integers(0, 2, 60), 9)
    order, rank, common = periodic.suffixes(s)
    text = s.tolist()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(61)) and (rank[order] == np.arange(61)).all()
    depth, first, end, split = periodic.tree(common)
    want = {}
    for i in range(61):
        for j in range(i + 1, 61):
            d = next(k for k in range(61) if text[i + k] != text[j + k])
            if d:
                want.setdefault(tuple(text[i : i + d]), set()).update((i, j))
    got = {tuple(text[order[a] : order[a] + d]): set(order[a:b].tolist()) for d, a, b in zip(depth.tolist(), first.tolist(), end.tolist(), strict=True)}
    assert set(got) == set(want) and all(want[k] <= v for k, v in got.items()) and (split >= 0).sum() == (common > 0).sum()


def test_long_and_periodic_in_little_time():
    n = 200_000
    for w in ([b"a"] * n, [b"a", b"b"] * (n // 2), [b"%d" % (i % 3000) for i in range(n)]):
        q = len(set(w))
        assert periodic.found_in([w]) == [[(0, len(w), q)]]
