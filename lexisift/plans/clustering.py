"""Queries that fit models: rows only where SQL can't express the fit, beside SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators import clustering as cl
from lexisift.operators import density as dn
from lexisift.operators import lexicons as lx
from lexisift.operators import matrix as mx
from lexisift.operators import model as mo
from lexisift.operators import scoring as so
from lexisift.plans import sqltext as q
from lexisift.plans.catalog import base, bucket, docs, emb, query, r, table

def _pairs_sql(eps: float) -> str:
    return f"""WITH {q.VEC}, pr AS (SELECT x.vec_id AS a, y.vec_id AS b FROM z x, z y WHERE round(1 - list_sum(list_transform(range(1, 65), lambda i: x.z[i] * y.z[i])), 9) <= {eps})"""


#: The model's reach, and one within which the test vectors have neighbours.
REACHES = {"": cl.EPS, "_wide": cl.WIDE}


def _density(suffix: str, eps: float) -> None:
    z = lambda spark, d: so.normalised(emb(spark, d))
    core = f"{_pairs_sql(eps)}, co AS (SELECT a AS vec_id, count(*)::BIGINT AS n, count(*) >= 10 AS is_core FROM pr GROUP BY a)"
    # components by the least core that is reached; a border point takes the least beside it
    labels = f"""{core}, RECURSIVE_E AS (SELECT a, b FROM pr JOIN co x ON x.vec_id = a AND x.is_core JOIN co y ON y.vec_id = b AND y.is_core),
rs AS (SELECT a, b FROM RECURSIVE_E UNION SELECT rs.a, e.b FROM rs JOIN RECURSIVE_E e ON rs.b = e.a), lo AS (SELECT a AS vec_id, min(b) AS low FROM rs GROUP BY a),
be AS (SELECT b AS vec_id, min(low) AS low FROM pr JOIN lo ON lo.vec_id = a GROUP BY b), al AS (SELECT co.vec_id, is_core, coalesce(lo.low, be.low) AS low FROM co LEFT JOIN lo ON lo.vec_id = co.vec_id LEFT JOIN be ON be.vec_id = co.vec_id),
nm AS (SELECT low, row_number() OVER (ORDER BY low) - 1 AS k FROM (SELECT DISTINCT low FROM lo)), lb AS (SELECT vec_id, is_core, coalesce(k, -1)::INT AS cluster FROM al LEFT JOIN nm ON nm.low = al.low)""".replace("WITH ", "WITH RECURSIVE ", 1)
    query(f"eps_neighbors{suffix}", f"{_pairs_sql(eps)} SELECT a, b FROM pr")(lambda spark, d: dn.neighbours(z(spark, d), eps))
    query(f"dbscan_core{suffix}", f"{core} SELECT * FROM co")(lambda spark, d: dn.counts(z(spark, d), eps))
    query(f"dbscan_labels{suffix}", f"{labels} SELECT vec_id, cluster FROM lb")(lambda spark, d: cl.density_labels(z(spark, d), eps))
    summary = "SELECT count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters, count_if(is_core)::BIGINT AS core, count_if(cluster < 0)::BIGINT AS noise, count_if(cluster >= 0 AND NOT is_core)::BIGINT AS border FROM lb"
    query(f"dbscan_summary{suffix}", f"{labels} {summary}")(lambda spark, d: dn.summary(z(spark, d), eps))
    masks = f"{labels} SELECT vec_id, cluster = -1 AS is_noise, cluster <> -1 AS is_core FROM lb"
    query(f"dbscan_masks{suffix}", masks)(lambda spark, d: cl.density_labels(z(spark, d), eps).select("vec_id", (F.col("cluster") == -1).alias("is_noise"), (F.col("cluster") != -1).alias("is_core")))


for _suffix, _eps in REACHES.items():
    _density(_suffix, _eps)


@query("kmeans_labels")
def _(spark, d):
    return cl.clustered(so.normalised(emb(spark, d)), 8)


@query("kmeans_final")
def _(spark, d):
    """The first coordinate of each centroid of the main model: density clusters, then k-means of the noise from the swarm."""
    z = so.normalised(emb(spark, d))
    return so.centroids(z.join(cl.main_labels(z), "vec_id"), "cluster").select("cluster", r(F.get("c", F.lit(0))).alias("c1"))


@query("silhouette")
def _(spark, d):
    return spark.createDataFrame([(8, cl.silhouette(cl.staged(so.normalised(emb(spark, d))), 8))], "k int, silhouette double")


@query("select_k")
def _(spark, d):
    return spark.createDataFrame(cl.select_k(so.normalised(emb(spark, d))), "k int, silhouette double")


@query("pso_centroids")
def _(spark, d):
    """Where the swarm starts the k-means of the noise; no rows under three points of noise."""
    z = so.normalised(emb(spark, d))
    rest = cl.staged(cl.noise(z, cl.density_labels(z)))
    c, cost = cl.noise_swarm(rest) if rest.count() >= 3 else ([], 0.0)
    return spark.createDataFrame([(i, [float(x) for x in row], cost) for i, row in enumerate(c)], "cluster int, c array<double>, cost double")


def labelled_docs(spark, d, part: str | None = None) -> DataFrame:
    """(doc_id, text, true_label) of all documents, or of those that the split by doc_id puts in the part."""
    known = table(spark, d, "labels").where("quality IN (0, 1)").select("doc_id", F.when(F.col("quality") == 0, "Anomalous").otherwise("Normal").alias("true_label"))
    df = docs(spark, d)
    if part:
        df = df.where((bucket("doc_id") < 7) if part == "train" else (bucket("doc_id") >= 7))
    return df.join(known, "doc_id", "left")


def combined(spark, d):
    """(encoder, rows): fitted on the training part; sparse vectors (doc_id, at, v) of all documents."""
    encoder = mo.fit_encoder(cl.staged(mo.prepared(labelled_docs(spark, d, "train"), ("doc_id",))))
    return encoder, mo.encoded(mo.prepared(docs(spark, d), ("doc_id",)), encoder, "doc_id")


@query("combined_features")
def _(spark, d):
    return combined(spark, d)[1].select("doc_id", F.size("at").cast("long").alias("n_entries"))


@query("combined_vectors")
def _(spark, d):
    return combined(spark, d)[1].select("doc_id", F.to_json(F.arrays_zip("at", "v")).alias("vector"))


def latent(spark, d, k: int = mo.LATENT):
    """(encoder, rows, v, s): singular vectors and values of the training part's matrix, and its rows."""
    rows = cl.staged(mo.prepared(labelled_docs(spark, d, "train"), ("doc_id",)))
    encoder = mo.fit_encoder(rows)
    vectors = cl.staged(mo.encoded(rows, encoder, "doc_id"))
    return encoder, vectors, *mx.singular(vectors, len(encoder.terms) + len(lx.FEATURES), k)


@query("svd_embed")
def _(spark, d):
    encoder, _, v, _ = latent(spark, d)
    rows = mo.prepared(docs(spark, d), ("doc_id",))
    return mo.projected(rows, encoder, v, ("doc_id",)).select(F.col("doc_id").alias("vec_id"), "z")


@query("svd_explained_variance")
def _(spark, d):
    """The share of the variance that the latent vectors keep: E[t^2] is s^2 / n, E[t] the projected mean."""
    _, rows, v, s = latent(spark, d)
    n = rows.count()
    sums = rows.select(F.explode(F.arrays_zip("at", "v")).alias("e")).groupBy("e.at").agg(F.sum("e.v").alias("x"), F.sum(F.col("e.v") * F.col("e.v")).alias("xx")).collect()  # a row per column
    mean = sum(v[e["at"]] * (e["x"] / n) for e in sums)
    total = sum(e["xx"] / n - (e["x"] / n) ** 2 for e in sums)
    return spark.createDataFrame([(len(s), float((s**2 / n - mean**2).sum() / total))], "k int, explained_variance_ratio double")


@query("predict_review")
def _(spark, d):
    """All documents scored by the model of the training part."""
    model = mo.fit(labelled_docs(spark, d, "train"))
    return mo.scored(docs(spark, d), model).select("doc_id", "prediction", "cluster", "distance", "threshold", "confidence")


@query("model_comparison")
def _(spark, d):
    """Density clusters, k-means and the main model, each by its own distances at the threshold of its own sweep."""
    z = so.normalised(emb(spark, d))
    true = z.select("vec_id", F.when(F.col("label") >= 7, "Anomalous").otherwise("Normal").alias("true_label"))
    out, dense = None, cl.staged(cl.density_labels(z))  # the main model starts from the same density clusters
    for name, labels, steps in (("density", lambda: dense, 200), ("k-means", lambda: cl.staged(cl.clustered(z)), 200), ("combined", lambda: cl.staged(cl.main_labels(z, dense)), 100)):
        sc = cl.own_distance(z, labels()).withColumn("distance", F.round("distance", 6))
        sc = cl.staged(sc.join(true, "vec_id"))
        th = F.broadcast(so.best(so.sweep(sc, steps)).select("threshold"))
        yes = F.when(F.col("distance") > F.col("threshold"), "Anomalous").otherwise("Normal")
        row = so.with_metrics(so.confusion(sc.join(th), yes, F.col("true_label"))).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1_score")
        out = row if out is None else out.unionByName(row)
    return out


@query("score_stream", f"SELECT doc_id, warning_count, forced FROM ({base()['predict_rules'][1]})")
def _(spark, d):
    from lexisift.streaming.scoring import scored_stream

    return scored_stream(spark, f"{d}/documents.parquet")


