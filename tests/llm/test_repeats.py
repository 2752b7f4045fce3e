"""Repeats at small flushes and lots, with hot anchors, against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisift.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def repeats(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


def rows_of(n=250, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    line = " ".join(word() for _ in range(9))[:60]  # in every document, shorter than a window
    passages = [" ".join(word() for _ in range(r.randrange(15, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(3)]
        parts.insert(r.randrange(4), line)
        if r.random() < 0.6:
            parts.insert(r.randrange(4), r.choice(passages))
        if r.random() < 0.1:
            parts.append("x" * r.randrange(90, 400))
        out.append((i, "\n".join(parts)))
    return out + [(n, out[0][1]), (n + 1, out[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "é" * 300)]


@pytest.mark.parametrize(
    "hot,held,known_hot",
    [(8192, (1 << 19, 1 << 20, 4 << 20, 1 << 14), 1 << 20), (20, (64, 4000, 4000, 32), 1 << 20), (2, (300, 4000, 20000, 64), 1 << 20), (8192, (50, 3000, 2000, 8), 1 << 20), (3, (64, 4000, 2000, 1), 1), (20, (64, 4000, 2000, 4), 200)],
)
def test_repeats_whatever_the_flushes(spark, monkeypatch, hot, held, known_hot):
    rows = rows_of()
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
    original = suffix_dedup.runs
    monkeypatch.setattr(suffix_dedup, "runs", lambda *a: original(*a, hot=hot, most=suffix_dedup.Held(*held), known_hot=known_hot))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == repeats(rows)


def test_transform_is_that_of_the_contexts():
    """After the last column: the order of all contexts, their common prefixes, and before it the symbols that the round inserts."""
    r = np.random.default_rng(1)
    text = r.integers(1, 4, (40, 12)).astype(np.uint8)
    built = suffix_dedup.Transform(text, np.full(40, 11), 100)
    for c in range(11, -1, -1):
        built.insert()
        keys = [text[i, c:].tobytes() for i in built.order]
        assert keys == sorted(text[i, c:].tobytes() for i in range(40))
        common = [next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 12 - c) for a, b in zip(keys, keys[1:], strict=False)]
        assert list(built.common[1:]) == common
        if c:
            assert list(built.before) == list(text[built.order, c - 1])


def test_names_and_ids(spark):
    rows = [(1, "a" * 150, 7, 8, 9), (2, "a" * 150 + "b", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, _runs int")
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated_documents(docs).collect()}
    assert set(got) == {1, 2} and all((r["_id"], r["_key"], r["_runs"]) == (7, 8, 9) for r in got.values())
    assert got[2]["text"] == "b"
    with pytest.raises(TypeError):
        suffix_dedup.deduplicated(docs.withColumn("doc_id", F.lit("x")))


def test_no_transform_holds_a_hot_anchor(monkeypatch):
    """One anchor at 50 times the limit: its bucket sorts no more contexts of it than the limit, and finds its repeats all the same."""
    r = np.random.default_rng(4)
    hot, n, width, gram = 20, 1000, 100, 32
    text = r.integers(97, 123, (n, 2 * width - gram)).astype(np.uint8)
    text[:, 30:] = text[0, 30:]  # the windows from column 30 on are equal
    zeros = np.zeros(n, np.uint16)
    low = zeros + np.uint16(width - gram)
    blob = [suffix_dedup._pack(np.arange(a, b), np.zeros(b - a, np.int64), np.full(b - a, 7, np.uint64), np.arange(b - a, dtype=np.uint32), np.full(b - a, 500, np.uint32), low[a:b], zeros[a:b], text[a:b].ravel()) for a, b in ((i, i + 50) for i in range(0, n, 50))]
    seen = []
    monkeypatch.setattr(suffix_dedup, "columns", lambda text, *a: seen.append(len(text)) or np.zeros((len(text), width - gram + 1), bool))
    held = suffix_dedup.Held(lot=16)
    out = list(suffix_dedup.repeats(1, width, gram, held, hot)([suffix_dedup._rows(suffix_dedup._CONTEXT, [0] * len(blob), blob)]))
    windows = [b for x in out for k, b in zip(x.column("kind").to_pylist(), x.column("blob").to_pylist(), strict=True) if k == suffix_dedup._WINDOW]
    known = [x for x in out if x.column("kind")[0].as_py() == suffix_dedup._KNOWN]
    known += suffix_dedup._late(1, width)([suffix_dedup._rows(suffix_dedup._WINDOW, [0] * len(windows), windows)])
    assert not seen and windows  # nothing was left to sort
    gone = {}
    for x in known:
        for b in x.column("blob").to_pylist():
            doc, _, back, rows = suffix_dedup._unpack(b, np.int64, np.int64, np.uint32, np.uint32)
            for d, (a, e) in zip(doc[back], rows.reshape(-1, 2), strict=True):
                gone.setdefault(int(d), set()).update(range(a, e))
    seen, want = set(), {}
    for i in range(n):
        starts = [c for c in range(width - gram + 1) if text[i, c : c + width].tobytes() in seen]
        want |= {i: {500 - (width - gram) + c + k for c in starts for k in range(width)}} if starts else {}
        seen |= {text[i, c : c + width].tobytes() for c in range(width - gram + 1)}
    assert gone == want and len(want) == n - 1
