"""Hand-checked cases, and random texts against one-line definitions."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisift.functions import features as ft
from lexisift.functions import predicates as pr
from lexisift.functions import text as tx
from lexisift.operators import clustering, scoring
from lexisift.sources import io


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["adadada", "aaaa", "qweasd", "kjashduikqweha"])
def test_gibberish(spark, text):
    assert one(spark, text, pr.gibberish)


@pytest.mark.parametrize("text,want", [("look at it", True), ("Panget", False), ("éna", False), ("a fine day", False)])
def test_tagalog(spark, text, want):
    assert one(spark, text, pr.tagalog) is want


@pytest.mark.parametrize("word,n", [("the", 1), ("make", 1), ("beautiful", 3)])
def test_syllables(spark, word, n):
    assert one(spark, word, tx.syllables) == n


def test_entropy_keeps_its_epsilon(spark):
    own = lambda t: tx.entropy(tx.tokens(t))
    assert one(spark, "good fine", own) == pytest.approx(0.9999999997114609, abs=1e-13)
    assert one(spark, "a b c d", own) == pytest.approx(1.9999999994229218, abs=1e-12)
    assert one(spark, "", own) == 0


def test_two_tokens_are_forced(spark):
    df = spark.createDataFrame([(1, "good fine"), (2, "")], "doc_id long, text string")
    got = ft.model_features(df).select(ft.forced(F.lit(False), F.lit("good")).alias("x")).collect()
    assert [r["x"] for r in got] == [True, True]


def test_published_matrix(spark):
    df = spark.createDataFrame([(2078, 1083, 685, 1547)], "tp long, fp long, fn long, tn long")
    got = scoring.with_metrics(df).first()
    assert [round(got[c], 4) for c in ("precision", "recall", "specificity", "accuracy", "f1_score")] == [0.6574, 0.7521, 0.5882, 0.6722, 0.7016]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcé XY_.!?\n", max_size=40), min_size=1, max_size=8))
def test_definitions(spark, texts):
    import re

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    w = tx.tokens(tx.clean(F.col("t")))
    got = df.select("i", w.alias("w"), tx.entropy(w).alias("h"), F.size(tx.words(F.col("t"))).alias("n")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        own = re.findall(r"\w+", re.sub(r"[^\w\s]", "", t.lower()))
        k = Counter(own)
        assert r["w"] == own and r["n"] == len(t.split())
        assert r["h"] == pytest.approx(-sum(c / len(own) * math.log2(c / len(own) + 1e-10) for c in k.values()), abs=1e-9)


def test_density_clusters(spark):
    points = [(i, [1.0, 0.001 * i, 0.0]) for i in range(12)] + [(50 + i, [0.0, 0.001 * i, 1.0]) for i in range(11)] + [(99, [-1.0, 0.0, 0.0])]
    z = spark.createDataFrame(points, "vec_id long, z array<double>").select("vec_id", F.lit(0).alias("label"), scoring.unit(F.col("z")).alias("z"))
    got = {r["vec_id"]: r["cluster"] for r in clustering.density_labels(z).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[50 + i] for i in range(11)} == {1} and got[99] == -1


def test_sources(spark, tmp_path):
    (tmp_path / "raw.csv").write_bytes('review;label\n"café; two\nlines";CG\n'.encode("iso-8859-2"))
    assert [tuple(r) for r in io.read_raw_reviews(spark, str(tmp_path / "raw.csv")).collect()] == [("café; two\nlines", "CG")]
    df = spark.createDataFrame([(1, ["a", "b"])], "id long, w array<string>")
    io.write_reviews(df, str(tmp_path / "out"), "csv")
    assert io.read_reviews(spark, str(tmp_path / "out")).first()["w"] == '["a","b"]'
    io.write_report(df, str(tmp_path / "report"))
    assert io.read_report(spark, str(tmp_path / "report")).count() == 1
    with pytest.raises(ValueError):
        io.required(df, "missing")


def test_rounding_is_that_of_the_sql(spark):
    """531 / 800 is a half by its digits, and less as a double times 10,000."""
    import duckdb

    from lexisift.plans import catalog

    rows = [(n, k / n) for n in (128, 160, 640, 800, 3200, 16_000) for k in range(1, n)] + [(0, None), (0, -0.66375)]
    df = spark.createDataFrame(rows, "n int, x double")
    got = df.select(catalog.rounded("x", 4).alias("a"), catalog.r(F.col("x")).alias("b")).collect()
    want = duckdb.sql("SELECT round(x, 4), round(x, 6) FROM (SELECT unnest(?) AS x)", params=[[x for _, x in rows]]).fetchall()
    assert [tuple(r) for r in got] == want


def test_lemmas_are_whole(spark):
    """Entries that once left the table, and the SQL with it."""
    words = F.array(*[F.lit(w) for w in ("entes", "inges", "mores", "ones", "uses", "other")])
    assert spark.range(1).select(tx.lemmas(words).alias("x")).first()["x"] == ["ente", "inge", "more", "one", "use", "other"]


def test_rules_cut_a_text_into_tokens_twice(spark):
    """Once as it is for gibberish, once cleaned for the features; each use of the tokens cut it anew before."""
    from lexisift.plans import catalog

    plan = catalog.rule_verdicts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tx.WORD + "+") == 2


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcdé𝒜", min_size=1, max_size=14) | st.text("ab", min_size=1, max_size=12) | st.text("abcdefghij", min_size=8, max_size=14), min_size=1, max_size=30))
def test_odd_words(spark, words):
    def odd(w):
        n, most, distinct = len(w), max(Counter(w).values()), len(set(w))
        return any(w.count(w[:k]) >= 3 and n >= 2 * k for k in (2, 3)) or (n >= 4 and most / n > 0.7) or (n >= 4 and distinct / n < 0.4) or (n >= 6 and distinct <= 3)

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", pr._odd(F.col("w")).alias("x")).collect()
    assert [(r["w"], r["x"]) for r in got] == [(w, odd(w)) for w in words]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdefghijkl"), max_size=40), min_size=1, max_size=12))
def test_entropies_under_a_limit(spark, rows):
    df = spark.createDataFrame([(w,) for w in [*rows, ["a"] * 60 + ["b"], list("abcd")]], "w array<string>")
    for limit, epsilon in ((1.5, 0.0), (2.0, 1e-10)):
        for r in df.select(tx.entropy(F.col("w"), epsilon).alias("x"), tx.entropy_under(F.col("w"), limit, epsilon).alias("y")).collect():
            assert r["x"] == r["y"] or (r["x"] >= limit and r["y"] >= limit)


@pytest.mark.parametrize("text", ["write to a.b@c.de or", "@a b@ c@@ @@d @e@f", "x y@z\nq@ @ r@s@t,u", "none here", "@", ""])
def test_emails_go_run_by_run(spark, text):
    import re

    assert one(spark, text, tx.without_emails) == re.sub(r"[^ \t\n\r\f\x0b]+@[^ \t\n\r\f\x0b]+", "", text)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("aeytré𝒜7", min_size=1, max_size=9), max_size=12), min_size=1, max_size=8))
def test_syllables_of_all_words(spark, rows):
    own = spark.createDataFrame([(w,) for w in [*rows, ["tree", "there", "brrr", "able", "the"], []]], "w array<string>")
    each = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + tx.syllables(w))
    assert [r for r in own.select(each.alias("x"), tx.all_syllables(F.col("w")).alias("y")).collect() if r["x"] != r["y"]] == []


@pytest.mark.parametrize("text", ["see http://a.b/c or www.d.e, f@g.h <b>it's</b> don't", "a < b, it's @ home", "plain words", "", None])
def test_what_is_not_there_is_not_replaced(spark, text):
    import re

    blank = r"[^ \t\n\r\f\x0b]"
    want = None if text is None else re.sub("<[^>]+>", "", re.sub(f"http{blank}+|www{blank}+", "", text))
    assert one(spark, text, lambda t: tx.without_tags(tx.without_urls(t))) == want
    assert one(spark, text, tx.expanded) == (text and text.replace("don't", "do not"))


def test_widths_need_no_quantiles(spark, monkeypatch):
    from lexisift.operators import quantiles
    from lexisift.plans import catalog

    monkeypatch.setattr(quantiles, "_round", lambda *a: pytest.fail("a round of counting"))
    monkeypatch.setattr(quantiles, "_few", lambda *a: pytest.fail("values fetched"))
    assert catalog.catalog()["range_widths"][0](spark, "/root/testdata/sf0.001").count() == 11
