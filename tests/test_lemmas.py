"""Lemmas by rules, against a plain version, with a word list of half a million."""

import pytest
from pyspark.sql import functions as F

from lexisift.operators import lemmas as le

WORDS = {"n": "cat glass box church wolf man city dish quiz use class news leaves leaf".split(), "v": "run make use try fix walk bake read".split(), "a": "big fine great nice".split()}
CASES = [
    ("cats", "n", "cat"), ("glasses", "n", "glass"), ("boxes", "n", "box"), ("churches", "n", "church"), ("wolves", "n", "wolf"), ("men", "n", "man"), ("cities", "n", "city"), ("news", "n", "news"),
    ("leaves", "n", "leaf"), ("gloop", "n", "gloop"), ("gloops", "n", "gloops"), ("s", "n", "s"), ("making", "v", "make"), ("uses", "v", "use"), ("tries", "v", "try"), ("fixes", "v", "fix"), ("walked", "v", "walk"),
    ("baked", "v", "bake"), ("readings", "v", "read"), ("cats", "v", "cats"), ("nicest", "a", "nice"), ("greater", "a", "great"), ("went", "v", "go"), ("better", "a", "good"), ("quizzes", "n", "quizzes"),
]


@pytest.fixture(scope="module")
def known(spark):
    some = spark.createDataFrame([(w, c) for c, ws in WORDS.items() for w in ws], "word string, class string")
    return some.unionByName(spark.range(500_000).selectExpr("concat('zz', id) AS word", "'n' AS class"))


def test_rules(spark, known):
    words = spark.createDataFrame([(w, c) for w, c, _ in CASES], "word string, class string")
    given = spark.createDataFrame([("went", "v", "go"), ("better", "a", "good")], "word string, class string, lemma string")
    got = {(r["word"], r["class"]): r["lemma"] for r in le.lemmas(words, known, given).collect()}
    assert got == {(w, c): lemma for w, c, lemma in CASES}


@pytest.mark.parametrize("sent", [50_000, 1])
def test_tokens(spark, known, monkeypatch, sent):
    monkeypatch.setattr(le, "SENT", sent)
    table = le.lemmas(spark.createDataFrame([("cats", "n"), ("boxes", "n"), ("cat", "n")], "word string, class string"), known)
    tokens = spark.createDataFrame([(1, "cats"), (1, "cat"), (2, "boxes"), (2, "other"), (3, None)] + [(4, "cats")] * 100, "doc_id long, word string")
    got = sorted(map(str, (tuple(r) for r in le.lemmatized(tokens, table, F.lit("n")).collect())))
    to = {"cats": "cat", "boxes": "box"}
    assert got == sorted(str((d, w, to.get(w, w))) for d, w in [(1, "cats"), (1, "cat"), (2, "boxes"), (2, "other"), (3, None)] + [(4, "cats")] * 100)
