"""Sources and sinks, and what may be loaded in place of the engine's own tables."""

import json

import pytest
from pyspark.sql import functions as F

from lexisift.functions import text as tx
from lexisift.plans import catalog as ct
from lexisift.sources import io


def test_matrix_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(1, [0, 3], [0.5, 2.0]), (2, [], [])], "doc_id long, at array<int>, v array<double>")
    io.write_matrix(df, f"file://{tmp_path}/m", 5)
    got = {r["key"]: r["vector"].toArray().tolist() for r in io.read_matrix(spark, f"file://{tmp_path}/m").collect()}
    assert got == {1: [0.5, 0, 0, 2.0, 0], 2: [0.0] * 5}
    wide = spark.createDataFrame([(i, [j * (i % 7) for j in range(i % 7 and 40)], [float(j + 1) for j in range(i % 7 and 40)]) for i in range(300)], df.schema)
    io.write_matrix(wide, f"file://{tmp_path}/w", 20_011)
    for r in io.read_matrix(spark, f"file://{tmp_path}/w").collect():
        i, v = r["key"], r["vector"]
        assert type(v).__name__ == "SparseVector" and v.size == 20_011 and v.indices.tolist() == [j * (i % 7) for j in range(i % 7 and 40)]
    with pytest.raises(ValueError):
        io.write_matrix(df.drop("v"), f"file://{tmp_path}/n", 5)


def test_tables_lexicon_preview_and_missing(spark, tmp_path):
    words = spark.createDataFrame([("fine", 0.5, 0.4), ("vile", -0.9, 1.0)], "word string, polarity double, subjectivity double")
    io.write_tables({"words": words, "few": io.preview(words, 1, "word")}, f"file://{tmp_path}/t")
    assert io.read_reviews(spark, f"file://{tmp_path}/t/few").collect()[0]["word"] == "fine"
    own = io.read_lexicon(spark, f"file://{tmp_path}/t/words")
    assert own == {"fine": (0.5, 0.4), "vile": (-0.9, 1.0)}
    p, s = tx.sentiment(F.col("w"), own)
    row = spark.createDataFrame([(["fine", "vile", "good"],)], "w array<string>").select(p.alias("p"), s.alias("s")).first()
    assert row["p"] == pytest.approx(-0.2) and row["s"] == pytest.approx(0.7)
    with pytest.raises(ValueError):
        io.read_lexicon(spark, f"file://{tmp_path}/t/words", 1)
    made = []
    for _ in range(2):
        got = io.build_if_missing(spark, f"file://{tmp_path}/b", lambda: made.append(1) or words)
        assert got.count() == 2 and made == [1]


def test_basis_and_tags(spark, tmp_path):
    (tmp_path / "basis.json").write_text(json.dumps({"review_length": {"min": 5, "max": 90}, "extra": {"optimal": 1}}))
    got = {r["feature"]: r.asDict() for r in io.read_basis(spark, f"file://{tmp_path}/basis.json", ct.profile(spark)).collect()}
    assert (got["review_length"]["low"], got["review_length"]["high"], got["review_length"]["optimal"]) == (5, 90, 50)
    assert got["word_entropy"]["low"] == 2 and got["extra"]["optimal"] == 1
    df = spark.createDataFrame([(["running", "dogs", "dog"],)], "w array<string>")
    lemma = {("running", "v"): "run", ("dogs", "n"): "dog", ("dog", "v"): "follow"}
    assert df.select(tx.tagged_lemmas(F.col("w"), lemma)).first()[0] == ["run", "dog", "dog"]
    every_noun = lambda w: F.lit("NN")
    assert df.select(tx.tagged_lemmas(F.col("w"), lemma, every_noun)).first()[0] == ["running", "dog", "dog"]
