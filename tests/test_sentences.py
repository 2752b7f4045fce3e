"""Sentence boundaries: abbreviations learned from plain text."""

import pytest

from lexisift.operators import sentences as se


@pytest.fixture(scope="module")
def known(spark):
    base = "we went out late and saw nothing but fine rain today when they came back here".split()
    other = [f"{' '.join(base[(i + j) % len(base)] for j in range(6)).capitalize()}." for i in range(len(base))]
    rows = [(i, f"{['Dr.', 'Prof.', 'e.g.'][i % 3]} {['Smith', 'Jones', 'apples'][i % 3]} came. {other[i % len(other)]} {other[(i + 2) % len(other)]}") for i in range(150)]
    return se.abbreviations(se.tokens(spark.createDataFrame(rows, "doc_id long, text string"))).cache()


def cut(spark, known, text):
    words = text.split()
    ends = sorted(r["i"] for r in se.boundaries(spark.createDataFrame([(1, text)], "doc_id long, text string"), known).collect())
    out, at = [], 0
    for e in ends:
        out.append(" ".join(words[at : e + 1]))
        at = e + 1
    assert at == len(words)
    return out


def test_abbreviations_are_learned(known):
    assert {r["word"] for r in known.collect()} == {"dr", "prof", "e.g"}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith came.", ["Dr. Smith came."]),
        ("He saw Prof. Jones. She did not.", ["He saw Prof. Jones.", "She did not."]),
        ("J. Doe sat down. (He was tired.) Why? I don't know!", ["J. Doe sat down.", "(He was tired.)", "Why?", "I don't know!"]),
        ("About 3.5 percent. of it", ["About 3.5 percent. of it"]),
        ("Fruit, e.g. apples", ["Fruit, e.g. apples"]),
        ("It ended with Dr.", ["It ended with Dr."]),
        ('"Go." She went', ['"Go."', "She went"]),
        ("", []),
    ],
)
def test_boundaries(spark, known, text, want):
    assert cut(spark, known, text) == want


def test_many_abbreviations_are_joined(spark, known, monkeypatch):
    monkeypatch.setattr(se, "SENT", 1)
    assert cut(spark, known, "Dr. Smith came. So did I.") == ["Dr. Smith came.", "So did I."]
    none = spark.createDataFrame([(1, None), (2, "no stop")], "doc_id long, text string")
    assert [tuple(r) for r in se.boundaries(none).collect()] == [(2, 1)]


def test_texts_are_cut_twice_at_most(spark):
    """Once to learn the abbreviations and once to mark the ends."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, "Dr. Smith came. We went out.") for i in range(100)], "doc_id long, text string")
    assert se.boundaries(rows.mapInArrow(run, rows.schema)).count() >= 100
    assert seen.value <= 200
