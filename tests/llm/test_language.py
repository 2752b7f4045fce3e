"""Languages: sums over all segmentations by hand, expected counts by their definition, and what is learned from."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lexisift.llm import language

SCHEMA = "doc_id long, text string, lang string"
TRIE = language.trie()
VOCABULARY = {}


@pytest.fixture(scope="module", autouse=True)
def vocabulary():
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(language.PIECES), "rb") as f:
        VOCABULARY.update({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def segmentations(b):
    """All ways to cut b into pieces."""
    for cuts in itertools.product([0, 1], repeat=len(b) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(b)]
        parts = [b[x:y] for x, y in zip(at, at[1:])]
        if all(p in VOCABULARY for p in parts):
            yield [VOCABULARY[p] for p in parts]


def chances(kinds, seed=1):
    c = np.random.default_rng(seed).random((kinds, TRIE.size)) ** 4
    return c / c.sum(1, keepdims=True)


def test_all_segmentations_are_summed():
    words, c = ["das", "Straße", "a", "niño", "the", "wwww"], chances(3)
    raw, edge = language._packed(pa.array(words))
    got = language.scores(TRIE, raw, edge, c)
    for i, w in enumerate(words):
        ways = list(segmentations(f" {w}".encode()))
        assert len(ways) > 1 and np.allclose(got[:, i], [np.log(sum(np.prod(c[k][way]) for way in ways)) for k in range(3)])


def test_expected_counts_are_shares_of_segmentations():
    words, c = ["das", "niño", "the", "das"], chances(2, 4)
    count, kind = np.array([3.0, 1.0, 2.0, 5.0]), np.array([0, 1, 0, 1])
    raw, edge = language._packed(pa.array(words))
    want = np.zeros(c.shape)
    for w, n, k in zip(words, count, kind, strict=True):
        ways = list(segmentations(f" {w}".encode()))
        p = np.array([np.prod(c[k][way]) for way in ways])
        for way, share in zip(ways, p / p.sum(), strict=True):
            np.add.at(want[k], way, n * share)
    assert np.allclose(language.expected(TRIE, raw, edge, count, kind, c), want)


def test_long_words_do_not_vanish():
    c = np.full((2, TRIE.size), 1e-9)
    words = ["z" * 3000, "qj" * 40, "a"]
    raw, edge = language._packed(pa.array(words))
    got = language.scores(TRIE, raw, edge, c)
    for i, w in enumerate(words):
        b = f" {w}".encode()
        log = np.full(len(b) + 1, -np.inf)
        log[0] = 0
        for j in range(1, len(b) + 1):
            log[j] = np.logaddexp.reduce([log[i] + np.log(1e-9) for i in range(max(0, j - 40), j) if b[i:j] in VOCABULARY])
        assert np.allclose(got[:, i], log[-1])
    share = language.expected(TRIE, raw, edge, np.ones(3), np.zeros(3, np.int64), c)
    sizes = np.zeros(TRIE.size)
    for piece, r in VOCABULARY.items():
        sizes[r] = len(piece)
    assert np.isclose((share[0] * sizes).sum(), len(raw))  # the pieces of every segmentation cover the word


def test_words():
    r = random.Random(3)
    texts = ["".join(r.choice("aB é Éñ中̧́ _1.Σσ'\n\U0001f600ⅧKſ\U0001d49c") for _ in range(r.randrange(0, 40))) for _ in range(2000)] + [None, ""]
    row, word = language.words_of(texts)
    assert list(zip(row.tolist(), word.to_pylist(), strict=True)) == [(i, x) for i, t in enumerate(texts) for x in regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 4 == 2


def documents():
    r = random.Random(9)
    own = {"aa": "kala maka tula sama rano".split(), "bb": "grint schlopf brunz tscher wolt".split(), "cc": "ñolé viña paña leñó".split()}
    rows = [(i, " ".join(r.choice(own[k]) + r.choice(["", ".", "!"]) for _ in range(r.randrange(3, 30))), k) for i, k in enumerate(r.choice(["aa", "bb", "cc"]) for _ in range(300))]
    return rows


def test_held_out_documents_teach_nothing(spark):
    rows = documents()
    other = [(d, t, "zz" if held(d) else k) for d, t, k in rows]
    frames = [spark.createDataFrame(x + [(None, "kala sama", "aa"), (900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "grint wolt brunz", None), (903, "grint wolt brunz", None)], SCHEMA).withColumn("score", F.lit("x")) for x in (rows, other)]
    a, b = (sorted(map(str, map(tuple, language.identified(f, rounds=2).collect()))) for f in frames)
    assert a == b
    got = language.identified(frames[0], rounds=2).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    true = {d: k for d, _, k in rows}
    assert all(r["lang_pred"] == true[r["doc_id"]] and 0 < r["score"] <= 1 for r in got if r["doc_id"] in true)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 903] == ["bb"] * 2
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], SCHEMA)
    assert tuple(language.identified(df).first())[2:] == ("und", 0.0)
    assert language.identified(df.where("doc_id > 5")).count() == 0


def test_counts_are_those_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "KEPT", 5)
    got = {(r["lang"], r["word"]): r["n"] for r in language.counted(spark.createDataFrame(documents(), SCHEMA).repartition(3)).collect()}
    want = {}
    for _, t, k in documents():
        for w in regex.findall(r"\p{L}+", t):
            want[k, w] = want.get((k, w), 0) + 1
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language.identified(docs).collect() if r["held_out"]]
    assert len(got) > 200 and sum(r["lang_pred"] == true[r["doc_id"]] for r in got) >= 0.98 * len(got)
