"""The manifest against a plain tree, with several depths of blocks, and against its SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pyarrow as pa
import pytest

from lexisift.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(12)
ROWS = [(i * 3 - 40, R.choice(["Some Text", "é", "", None, "ABC " * 50]), R.choice(["en", "en", "en", "de", "é", None]), R.choice(["s1", None, ""]), R.choice([7, None])) for i in range(700)]
ROWS += [(None, "no id", "en", "s", 1), (None, None, None, None, None), (5000, "alone", "zz", "s", 5), (5003, "A", "Zz", "s", 1)]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    d, text, lang, source, n = r
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def climb(nodes):
    """The top and, for each node, the siblings left and right of it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
    return nodes[0] if nodes else None, paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *climb([leaf(r) for r in own])
    root, above = climb([trees[x][1] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), sub, root, h(*[x for p in path for side in p for x in side]), now, now == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], SCHEMA + ", g int").repartition(3).cache()


@pytest.mark.parametrize("top", [4096, 4, 2])
def test_manifest(docs, monkeypatch, top):
    if top < 4096:
        monkeypatch.setattr(merkle, "LEVELS", top // 2)  # blocks of 64 and of 8
    assert sorted((tuple(r) for r in merkle.manifest(docs, top).collect()), key=str) == plain(ROWS)


def test_many_languages(spark):
    """More subroots than the driver takes."""
    rows = [(i, f"t{i}", f"l{i % 90:02}", "s", i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in merkle.manifest(df, 5).collect()), key=str) == plain(rows)


def test_repeated_rows_and_proofs(spark):
    rows = [(3, "x", "en", "s", 1)] * 20 + [(3, "y", "en", "s", 1)] * 3
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), proofs=True).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == plain(rows)
    assert all(merkle.fold(r["leaf"], r["proof"]) == r["root"] for r in got)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h()


def test_sql(docs):
    own = [r for r in ROWS if r[0] is not None]
    documents = pa.table({c: pa.array([r[i] for r in own], t) for c, i, t in (("doc_id", 0, pa.int64()), ("text", 1, pa.string()), ("lang", 2, pa.string()), ("source", 3, pa.string()), ("n_chars", 4, pa.int64()))})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(merkle.SQL)
    at = [want.columns.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    assert sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str) == plain(own)
