"""The queries that fit models, against their definitions."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexisift.operators import clustering as cl
from lexisift.operators import density as dn
from lexisift.operators import model as mo
from lexisift.operators import scoring
from lexisift.plans import catalog as ct
from lexisift.plans import clustering as pc

DATA = "/root/testdata/sf0.001"
ct.catalog()


def test_vocabulary_is_whole(spark):
    rows = mo.prepared(pc.labelled_docs(spark, DATA, "train"), ("doc_id",))
    seen = Counter(t for r in rows.select("words").collect() for t in {" ".join(r["words"][i : i + n]) for n in (1, 2, 3) for i in range(len(r["words"]) - n + 1)})
    shared = sum(n >= 2 for n in seen.values())
    encoder = mo.fit_encoder(rows)
    assert shared > 2000 and len(encoder.terms) == min(shared, 20_000)
    n = [r["n_entries"] for r in ct.catalog()["combined_features"][0](spark, DATA).collect()]
    assert sum(n) > ct.weights(spark, DATA, 2000).count() + 11 * len(n)


def test_latent_vectors_are_those_of_the_whole_matrix(spark):
    encoder, rows, v, s = pc.latent(spark, DATA)
    n, ids = rows.count(), {}
    x = np.zeros((n, v.shape[0]))
    for i, r in enumerate(rows.collect()):
        ids[r["doc_id"]] = i
        x[i, r["at"]] = r["v"]
    gram = np.linalg.eigvalsh(x @ x.T)[::-1]
    rank = int((gram > 1e-12 * gram[0]).sum())
    assert len(s) == v.shape[1] == min(200, rank) and rank > 20
    assert np.allclose(s**2, gram[: len(s)], rtol=1e-6, atol=1e-6 * gram[0])
    t = x @ v
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    z = np.zeros_like(t)
    for r in mo.projected(mo.prepared(pc.labelled_docs(spark, DATA, "train"), ("doc_id",)), encoder, v, ("doc_id",)).collect():
        z[ids[r["doc_id"]]] = r["z"]
    assert np.allclose(z, t, atol=1e-6)
    got = ct.catalog()["svd_explained_variance"][0](spark, DATA).first()
    assert got["k"] == len(s) and abs(got["explained_variance_ratio"] - (x @ v).var(0).sum() / x.var(0).sum()) < 1e-6


SAMPLES = [
    "Love this! Well made, sturdy, and very comfortable. I love it! Very pretty",
    "Love it, a great upgrade from the original. I've had mine for a couple of years",
    "Panget",
    "Not impossible to put together by yourself. Only scratched one place in a not very noticeable place. Get many compliments on it and has lots of storage.",
    "AMAZING PRODUCT!!! BUY NOW!!! BEST DEAL EVER!!! \u2b50\u2b50\u2b50\u2b50\u2b50",
    "good",
]


def test_a_loaded_model_scores_new_reviews(spark, tmp_path):
    model = mo.fit(pc.labelled_docs(spark, DATA, "train"), k=30)
    mo.save(spark, model, f"file://{tmp_path}/model")
    again = mo.load(spark, f"file://{tmp_path}/model")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*SAMPLES, None, ""])], "id long, review string")
    rows = {r["id"]: r for r in mo.scored(df, again, "id", "review").collect()}
    assert rows == {r["id"]: r for r in mo.scored(df, model, "id", "review").collect()}
    assert [rows[i]["prediction"] for i in (2, 4, 5)] == ["Anomalous"] * 3  # a word, three marks, two tokens
    for i in range(6):
        r = rows[i]
        assert r["error"] is None and 0 <= r["distance"] <= 2 and 0 <= r["cluster"] < len(model.centroids) and 0 <= r["confidence"] <= 100
        assert r["distance"] <= r["threshold"] or r["prediction"] == "Anomalous"
    assert rows[4]["features"]["exclamation_count"] == 9 and rows[5]["processed_text"] == "good"
    assert all(rows[i]["prediction"] is None and rows[i]["error"] for i in (6, 7))


def test_neighbours_lose_no_pair(spark):
    x = np.random.default_rng(1).normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = spark.createDataFrame([(i, 0, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label int, z array<double>")
    for eps in (0.02, 0.2):
        got = sorted((r["a"], r["b"]) for r in dn.neighbours(z, eps).collect())
        assert got == sorted(zip(*(c.tolist() for c in np.nonzero(np.round(1 - x @ x.T, 9) <= eps)), strict=True))
    assert dn.neighbours(z.where("vec_id < 0")).count() == 0


def points(spark):
    """One dense cluster, and noise in two directions that lie far apart."""
    near = [(i, [1.0, 0.001 * i, 0.0, 0.0]) for i in range(12)]
    far = [(100 + i, [-1.0, 0.0, 0.6 * (i % 3 - 1), 0.6 * (i // 3 - 1)]) for i in range(6)] + [(200 + i, [0.0, -1.0, 0.6 * (i % 3 - 1), 0.6 * (i // 3 - 1)]) for i in range(6)]
    z = spark.createDataFrame(near + far, "vec_id long, z array<double>")
    return z.select("vec_id", F.lit(0).alias("label"), scoring.unit(F.col("z")).alias("z"))


def test_main_model_clusters_the_noise(spark, monkeypatch):
    z = points(spark)
    begun = []
    swarm, batches = cl.swarm_centroids, cl.mini_batches
    monkeypatch.setattr(cl, "swarm_centroids", lambda x, k, *a: begun.append((sorted(r["vec_id"] for r in x.collect()), k)) or swarm(x, k, *a))
    monkeypatch.setattr(cl, "mini_batches", lambda x, c, *a: begun.append(c) or batches(x, c, *a))
    got = {r["vec_id"]: r["cluster"] for r in cl.main_labels(z).collect()}
    ids = [100 + i for i in range(6)] + [200 + i for i in range(6)]
    assert begun[0][0] == ids and len(begun[1]) == begun[0][1]
    assert sorted(got) == list(range(12)) + ids and {got[i] for i in range(12)} == {0}
    assert len({got[i] for i in ids}) >= 2 and min(got[i] for i in ids) >= 1
    assert not {got[i] for i in ids[:6]} & {got[i] for i in ids[6:]}
    few = {r["vec_id"]: r["cluster"] for r in cl.main_labels(z.where("vec_id < 102")).collect()}
    assert few[100] == few[101] == 1
    none = {r["cluster"] for r in cl.main_labels(z.where("vec_id < 12")).collect()}
    assert none == {0}


def test_kmeans_starts_from_the_given_centroids(spark):
    z = points(spark).where("vec_id >= 100")
    got = {r["vec_id"]: r["cluster"] for r in cl.started(z, [[0.0, -1.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]).collect()}
    assert {got[200 + i] for i in range(6)} == {0} and {got[100 + i] for i in range(6)} == {1}


def test_batches_come_near_to_all_rows(spark):
    """Cost within 5 % of k-means over all rows; the same seed gives the same centroids."""
    z = cl.staged(scoring.normalised(ct.emb(spark, "/root/testdata/sf0.1")).select("vec_id", "z"))
    x = {r["vec_id"]: np.array(r["z"]) for r in z.collect()}
    begin = np.array([x[i] for i in sorted(x)[:10]])

    def cost(labels):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r["cluster"], []).append(x[r["vec_id"]])
        return sum(((np.array(g) - np.mean(g, 0)) ** 2).sum() for g in groups.values())

    c = cl.mini_batches(z, begin, size=300)
    assert cost(cl.assigned(z, c)) <= 1.05 * cost(cl.started(z, begin))
    assert (c == cl.mini_batches(z, begin, size=300)).all()


def test_the_swarm_is_that_of_one_machine(spark):
    """Against the same swarm over the same rows in numpy."""
    z = cl.staged(points(spark).repartition(3))
    x = np.array([r["z"] for r in z.collect()])
    low, high = x.min(0), x.max(0)
    high = np.where(high == low, low + 1e-6, high)
    rng = np.random.default_rng(42)
    at = rng.uniform(low, high, (6, 3, x.shape[1]))
    speed = np.zeros_like(at)

    def cost(c):
        c = c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-10)
        return (1 - (x @ c.T).max(1)).sum()

    own, own_cost = at.copy(), np.array([cost(c) for c in at])
    for _ in range(4):
        lead = own[own_cost.argmin()]
        speed = 0.5 * speed + 0.5 * rng.random(at.shape) * (own - at) + 0.5 * rng.random(at.shape) * (lead - at)
        at = np.clip(at + speed, low, high)
        now = np.array([cost(c) for c in at])
        better = now < own_cost
        own[better], own_cost[better] = at[better], now[better]
    c, least = cl.swarm_centroids(z, 3, 6, 4)
    assert np.allclose(c, own[own_cost.argmin()]) and np.isclose(least, own_cost.min())


def test_ten_starts(spark, monkeypatch):
    seen = []
    real = cl.KMeans
    monkeypatch.setattr(cl, "KMeans", lambda **a: seen.append(a) or real(**a))
    cl.clustered(points(spark), 2)
    assert len({a["seed"] for a in seen}) == 10 and min(a["maxIter"] for a in seen) >= 200


def test_select_k_searches_the_whole_range(spark, monkeypatch):
    monkeypatch.setattr(cl, "silhouette", lambda z, k: -abs(k - 10.0))
    got = ct.catalog()["select_k"][0](spark, DATA).collect()
    assert [r["k"] for r in got] == list(range(2, 13)) and cl.best_k([(r["k"], r["silhouette"]) for r in got]) == 10


def test_comparison_fits_each_model(spark, monkeypatch):
    """Each model's distances are set apart from the others' by a stand-in for its labels; metrics follow by hand."""
    z = spark.createDataFrame([(i, 9 if i >= 6 else 0, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(8)], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(pc, "emb", lambda spark, d: z)
    labels = lambda c: lambda x, *a: x.select("vec_id", c.cast("int").alias("cluster"))
    v = F.col("vec_id")
    monkeypatch.setattr(cl, "density_labels", labels(F.when(v < 6, 0).otherwise(-1)))  # the anomalies are noise, far from cluster 0
    monkeypatch.setattr(cl, "clustered", labels(F.lit(0)))  # one cluster, to which the anomalies are farther
    monkeypatch.setattr(cl, "main_labels", labels(v))  # every vector its own centroid
    got = {r["model"]: r for r in ct.catalog()["model_comparison"][0](spark, DATA).collect()}
    assert list(got) == ["density", "k-means", "combined"]
    assert got["density"]["f1_score"] == got["k-means"]["f1_score"] == 1.0
    assert got["combined"]["recall"] == 0.0 and got["combined"]["accuracy"] == 0.75


def test_fits_of_all_numbers_read_one_table(spark, monkeypatch):
    """The rows are written once, however many fits there are, and not at all for each silhouette."""
    z = spark.createDataFrame([(i, [float(i % 3), 1.0 + i % 2]) for i in range(12)], "vec_id long, z array<double>")
    written, staged = [], cl.staged
    monkeypatch.setattr(cl, "staged", lambda df: written.append(df.columns) or staged(df))
    assert [k for k, _ in cl.select_k(z, 4)] == [2, 3, 4]
    assert written == [["vec_id", "z"]]


def test_comparison_finds_density_clusters_once(spark, monkeypatch):
    z = spark.createDataFrame([(i, 9 if i >= 6 else 0, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(8)], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(pc, "emb", lambda spark, d: z)
    monkeypatch.setattr(cl, "clustered", lambda x, *a: x.select("vec_id", F.lit(0).alias("cluster")))
    found = []

    def once(x, *a):
        found.append(a)
        return x.select("vec_id", F.when(F.col("vec_id") < 6, 0).otherwise(-1).cast("int").alias("cluster"))

    monkeypatch.setattr(cl, "density_labels", once)
    got = {r["model"]: r["f1_score"] for r in ct.catalog()["model_comparison"][0](spark, DATA).collect()}
    assert len(found) == 1 and got["density"] == 1.0 and len(got) == 3


def test_a_pass_is_a_round_of_all_starts(spark, monkeypatch):
    """Ten starts read the rows as often as the longest of them, each as if it were alone."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, (60, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0])])
    z = cl.staged(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, z array<double>").repartition(3))
    starts, passes, sums = [cl.KMeans(k=4, seed=i, maxIter=300) for i in range(10)], [], cl._sums
    monkeypatch.setattr(cl, "_sums", lambda z, sets: passes.append(len(sets)) or sums(z, sets))
    got = cl.fitted(z, starts)
    assert passes[0] == 10 and sorted(passes, reverse=True) == passes and len(passes) < 60
    for c, cost in got:
        apart = ((x[:, None] - c[None]) ** 2).sum(2)
        own = apart.argmin(1)
        assert len(c) == 4 and np.isclose(cost, apart.min(1).sum()) and np.allclose(c, [x[own == i].mean(0) for i in range(4)])
    alone = cl.fitted(z, starts[3:4])[0]
    assert np.allclose(alone[0], got[3][0]) and np.isclose(alone[1], got[3][1])


def test_silhouettes_are_those_of_spark(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(6).normal(size=(80, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = cl.staged(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, z array<double>"))
    for k in (2, 5):
        c = cl.fitted(z, [cl._searched(k)])[0][0]
        rows = z.join(cl.assigned(z, c), "vec_id").select(array_to_vector("z").alias("features"), F.col("cluster").alias("prediction"))
        assert np.isclose(cl.silhouette(z, k), ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows))
        assert np.isclose(cl.silhouette(cl.Fits(z, {k: c}), k), cl.silhouette(z, k))
    assert cl.silhouette(z.where("vec_id < 1"), 2) == -1.0
