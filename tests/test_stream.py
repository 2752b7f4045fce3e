"""The stream reads the table that it is given, and no other; models are stored whole and taken up between batches."""

import shutil

import numpy as np
import pytest

from lexisift.operators import lexicons as lx
from lexisift.operators import model as mo
from lexisift.operators import store as st
from lexisift.streaming import scoring as sg
from lexisift.streaming.scoring import scored_stream


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def some(spark, a, b):
    return spark.range(a, b).selectExpr("id AS doc_id", "concat('A fine review, number ', id) AS text")


def test_folder_beside_others(spark, tmp_path):
    for name, a, b in (("documents.parquet", 0, 10), ("documents.parquet_old", 100, 125)):
        some(spark, a, b).repartition(3).write.parquet(f"{tmp_path}/{name}")
    assert ids(scored_stream(spark, f"{tmp_path}/documents.parquet")) == list(range(10))


def test_file_beside_others(spark, tmp_path):
    for name, a, b in (("documents.parquet", 0, 10), ("documents.parquet_old", 100, 125), ("old_documents.parquet", 200, 210)):
        some(spark, a, b).coalesce(1).write.parquet(f"{tmp_path}/tmp-{name}")
        part = next((tmp_path / f"tmp-{name}").glob("part-*.parquet"))
        shutil.copy(part, tmp_path / name)
    assert ids(scored_stream(spark, f"{tmp_path}/documents.parquet")) == list(range(10))
    assert ids(scored_stream(spark, f"file://{tmp_path}/old_documents.parquet/")) == list(range(200, 210))


def small(seed):
    """A model of a few words."""
    r = np.random.default_rng(seed)
    words = ["fine", "review", "number", "fine review", "bad"]
    wide = len(words) + len(lx.FEATURES)
    c = r.normal(size=(3, 4))
    return mo.ReviewModel(mo.Encoder(words, r.random(5) + 1, r.random(11), r.random(11) + 0.5), r.normal(size=(wide, 4)), r.random(4), c / np.linalg.norm(c, axis=1, keepdims=True), 0.3 + seed / 10, 0.5)


def test_a_stream_takes_up_a_newer_model(spark, tmp_path):
    root, source, out = f"file://{tmp_path}/store", tmp_path / "in", f"file://{tmp_path}/out"
    assert st.publish(spark, small(1), root) == 1
    some(spark, 0, 20).coalesce(1).write.parquet(str(source))
    read = lambda: sg.opened(spark, str(source))
    sg.score_by_model(read(), root, out).awaitTermination()
    assert st.publish(spark, small(2), root) == 2
    some(spark, 20, 50).coalesce(1).write.mode("append").parquet(str(source))
    sg.score_by_model(read(), root, out).awaitTermination()
    near = lambda x: {k: round(v, 9) if isinstance(v, float) else v for k, v in x.items()}  # noqa: E731  sums of another batch
    show = lambda df: sorted(map(str, (near(r.asDict(True)) for r in df.collect())))
    got = spark.read.parquet(out).drop("batch")
    for version, a, b in ((1, 0, 20), (2, 20, 50)):
        assert show(got.where(f"version = {version}").drop("version")) == show(mo.scored(some(spark, a, b), small(version)))


def test_one_running_query_changes_models(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    st.publish(spark, small(1), root)
    by = sg.Newest(spark, root)
    first = by.scored(some(spark, 0, 5)).collect()
    sent = by.sent
    by.scored(some(spark, 0, 5)).collect()
    assert by.sent is sent  # sent out once for a version
    st.publish(spark, small(2), root)
    second = by.scored(some(spark, 0, 5)).collect()
    assert {r["version"] for r in first} == {1} and {r["version"] for r in second} == {2} and by.sent is not sent


def test_a_save_cut_off_is_never_loaded(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    with pytest.raises(LookupError):
        st.load(spark, root)
    st.publish(spark, small(1), root)
    told = st._told
    monkeypatch.setattr(st, "_told", lambda df: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        st.publish(spark, small(2), root)
    monkeypatch.setattr(st, "_told", told)
    assert st.newest(spark, root) == 1 and st.load(spark, root).threshold == small(1).threshold
    assert np.array_equal(st.load(spark, root, 1).basis, small(1).basis)


@pytest.mark.parametrize("how", ["gone", "rows", "values", "schema"])
def test_a_broken_table_is_named(spark, tmp_path, how):
    root = f"file://{tmp_path}/store"
    st.publish(spark, small(1), root)
    name = st.manifests(spark, root).first()["name"]
    at = f"{tmp_path}/store/models/{name}/centroids"
    df = spark.createDataFrame(spark.read.parquet(at).collect(), "cluster int, c array<double>")
    shutil.rmtree(at)
    if how == "rows":
        df.where("cluster > 0").write.parquet(at)
    elif how == "values":
        df.selectExpr("cluster", "transform(c, x -> x + if(cluster = 1, 1e-9, 0)) AS c").write.parquet(at)
    elif how == "schema":
        df.selectExpr("cluster", "cast(c AS array<float>) AS c").write.parquet(at)
    with pytest.raises(st.BrokenModel, match="centroids"):
        st.load(spark, root)
