"""The review model as a value: fitted on one table, saved, loaded, and applied to any other.

Fitting takes the vocabulary, the idf, the scaler and the singular vectors from the training rows alone, then the clusters of
their vectors, their centroids and the threshold with the best F1 on the labelled ones. All parts are bounded by parameters
(terms, vectors) or by the number of clusters, never by the rows. Scoring is one pass over the rows without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import features as ft
from lexisift.functions import predicates as pr
from lexisift.functions import text as tx
from lexisift.operators import clustering as cl
from lexisift.operators import lexicons as lx
from lexisift.operators import matrix as mx
from lexisift.operators import scoring as so
from lexisift.operators import terms as te
from lexisift.operators.stages import in_batches, staged

#: Terms of the vocabulary; singular vectors kept, where the matrix has as many; the threshold where no row has a label.
VOCABULARY, LATENT, PUBLISHED = te.VOCABULARY, 200, 0.54


class Encoder(NamedTuple):
    """What turns a text into a sparse vector: terms with their idf, then the scaled features."""

    terms: list
    idf: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


class ReviewModel(NamedTuple):
    encoder: Encoder
    basis: np.ndarray  # (terms and features, singular vectors)
    singular: np.ndarray
    centroids: np.ndarray  # of unit length, by cluster
    threshold: float
    f1_score: float | None


def grams(words: Column, n: int) -> Column:
    last = F.size(words) - F.lit(n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))


def prepared(df: DataFrame, keep: tuple, text: str = "text") -> DataFrame:
    """The columns to keep, the model's features, ``processed`` tokens and ``words``, those of two characters or more; no shuffle."""
    own = df.withColumn("processed", F.explode(F.array(tx.preprocessed(F.coalesce(F.col(text), F.lit(""))))))  # once a row
    return ft.model_features(own, text, (*keep, "processed")).withColumn("words", long_words("processed"))


def long_words(processed: str) -> Column:
    return F.filter(processed, lambda w: F.char_length(w) > 1)


def smoothed(n, df):
    return np.log((1 + n) / (1 + df)) + 1


def fit_encoder(rows: DataFrame, most: int = VOCABULARY, least: int = te.LEAST) -> Encoder:
    """rows: as ``prepared``."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in lx.FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    found = sorted(te.top_terms(rows, most, least).collect(), key=lambda r: r["term"])  # at most ``most`` rows
    part = lambda k: np.array([stats[f"{k}_{c}"] or 0.0 for c in lx.FEATURES], float)
    return Encoder([r["term"] for r in found], smoothed(stats["n"], np.array([r["df"] for r in found], float)), part("m"), part("s"))


def _weights(lists, n: int, idf: np.ndarray, known: pa.Array):
    """Row, place and tf-idf weight, of unit length in each row, of the n-grams of a batch of lists of words."""
    row, term = te.grams(lists)
    at = pc.fill_null(pc.index_in(term, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(len(known), 1)
    cell, count = np.unique((row * size + at)[at >= 0], return_counts=True)
    row, at = cell // size, cell % size
    value = count * idf[at] if len(at) else np.zeros(0)
    return row, at, value / np.sqrt(np.bincount(row, value**2, n))[row] if len(at) else value


def in_lots(batches, column: str = "words"):
    """Slices of the batches with about ``te.LOT`` words, so that a task's memory hangs neither on the rows of a batch nor on their length."""
    for batch in batches:
        for a, b in te.lots(batch.column(column)):
            yield batch.slice(a, b - a)


def tfidf(rows: DataFrame, words: list, idf: np.ndarray, key: str) -> DataFrame:
    """(key, term, weight): one row per entry, in one pass over the rows."""
    sent = rows.sparkSession.sparkContext.broadcast((words, idf))

    def run(batches):
        known = pa.array(sent.value[0], pa.large_string())
        for batch in in_lots(batches):
            row, at, value = _weights(batch.column("words"), batch.num_rows, sent.value[1], known)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), known.take(pa.array(at)).cast(pa.string()), pa.array(value, pa.float64())], [key, "term", "weight"])

    return in_batches(rows.select(key, "words"), run, f"{key} {rows.schema[key].dataType.simpleString()}, term string, weight double")


def _sparse(batch, encoder: Encoder, known: pa.Array):
    """Row, place and value of the terms of a batch, and its scaled features."""
    row, at, value = _weights(batch.column("words"), batch.num_rows, encoder.idf, known)
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in lx.FEATURES])
    return row, at, value, (x - encoder.mean) / np.where(encoder.deviation == 0, 1.0, encoder.deviation)


def encoded(rows: DataFrame, encoder: Encoder, key: str) -> DataFrame:
    """(key, at, v): the sparse vectors, entries by place."""
    sent = rows.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        known = pa.array(sent.value.terms, pa.large_string())
        for batch in in_lots(batches):
            row, at, value, scaled = _sparse(batch, sent.value, known)
            n, width = scaled.shape
            row = np.concatenate([row, np.repeat(np.arange(n), width)])
            order = np.argsort(row, kind="stable")
            at = np.concatenate([at, np.tile(len(known) + np.arange(width), n)])[order]
            edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (at.astype(np.int32), np.concatenate([value, scaled.ravel()])[order])]
            yield pa.RecordBatch.from_arrays([batch.column(key), *lists], [key, "at", "v"])

    kind = rows.schema[key].dataType.simpleString()
    return in_batches(rows.select(key, "words", *lx.FEATURES), run, f"{key} {kind}, at array<int>, v array<double>")


def sent_out(spark: SparkSession, model: ReviewModel):
    """What scoring needs of the model in its tasks: 32 MB at most at the default sizes. A worker reads it once."""
    return spark.sparkContext.broadcast((model.encoder, model.basis))


def projected(rows: DataFrame, encoder: Encoder, basis: np.ndarray, keep: tuple, out: str = "z", sent=None) -> DataFrame:
    """The columns to keep and the latent vector at length 1; a sparse product for each Arrow batch."""
    sent = sent or rows.sparkSession.sparkContext.broadcast((encoder, basis))

    def run(batches):
        own, v = sent.value
        known = pa.array(own.terms, pa.large_string())
        for whole in in_lots(batches):
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                row, at, value, scaled = _sparse(batch, own, known)
                t = scaled @ v[len(known) :]
                if len(row):
                    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    for lot in np.array_split(np.arange(len(edge)), max(1, len(row) // 20_000)):
                        if len(lot):
                            to = edge[lot[-1] + 1] if lot[-1] + 1 < len(edge) else len(row)
                            s = slice(edge[lot[0]], to)
                            t[row[edge[lot]]] += np.add.reduceat(value[s, None] * v[at[s]], edge[lot] - edge[lot[0]])
                length = np.linalg.norm(t, axis=1, keepdims=True)
                t = t / np.where(length == 0, 1.0, length)
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], z], [*keep, out])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    more = [c for c in ("words", *lx.FEATURES) if c not in keep]
    return in_batches(rows.select(*keep, *more), run, f"{kinds}, {out} array<double>")


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "true_label", vocabulary: int = VOCABULARY, k: int = LATENT, steps: int = 100) -> ReviewModel:
    """train: key, text and label ('Anomalous', 'Normal' or null). Rows without a label help to fit all but the threshold."""
    rows = staged(prepared(train.select(F.col(key).cast("long").alias("vec_id"), text, label), ("vec_id", label), text))
    encoder = fit_encoder(rows, vocabulary)
    basis, values = mx.singular(staged(encoded(rows, encoder, "vec_id")), len(encoder.terms) + len(lx.FEATURES), k)
    z = staged(projected(rows, encoder, basis, ("vec_id", label))).withColumn("label", F.lit(0))
    own = staged(cl.main_labels(z.select("vec_id", "label", "z")))
    cents = staged(so.centroids(z.join(own, "vec_id").select("cluster", "z"), "cluster"))
    near = so.nearest(z.where(F.col(label).isNotNull()).select("vec_id", "z", F.col(label).alias("label")), cents).select("distance", F.col("label").alias("true_label"))
    best = so.best(so.sweep(near, steps)).first()
    table = [r["c"] for r in cents.orderBy("cluster").collect()]  # a row per cluster
    th = best["threshold"]
    return ReviewModel(encoder, basis, values, np.array(table, float).reshape(len(table), basis.shape[1]), PUBLISHED if th is None else float(th), best["f1_score"])


def scored(df: DataFrame, model: ReviewModel, key: str = "doc_id", text: str = "text", sent=None) -> DataFrame:
    """For each row of df: prediction, cluster, distance, threshold, confidence, processed_text and features. A null or empty text has
    no prediction and says so in ``error``."""
    blank = F.col(text).isNull() | (F.col(text) == "")
    base = df.select(key, text, F.when(blank, "Review text must not be empty").alias("error"), pr.gibberish(F.coalesce(F.col(text), F.lit(""))).alias("gibberish"))
    keep = (key, "error", "gibberish", "processed", *lx.FEATURES)
    z = projected(prepared(base, (key, "error", "gibberish"), text), model.encoder, model.basis, keep, sent=sent)
    spark = df.sparkSession
    cents = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.centroids)], "cluster int, c array<double>")
    table = cents.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("table"))
    best = F.array_min(F.transform("table", lambda t: F.struct((F.lit(1.0) - so.dot(F.col("z"), t["c"])).alias("d"), t["cluster"].alias("cluster"))))
    near = z.join(F.broadcast(table)).withColumn("near", F.explode(F.array(best)))
    th = F.lit(float(model.threshold))
    distance = F.col("near.d")
    bad = (distance > th) | ft.forced(F.col("gibberish"), F.coalesce(F.get("processed", F.lit(0)), F.lit("")))
    far = F.least(F.abs(distance - th) / F.greatest(th, F.lit(1e-12)) * 100, F.lit(100.0))
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return near.select(
        key,
        ok(F.when(bad, "Anomalous").otherwise("Normal")).alias("prediction"),
        ok(F.col("near.cluster")).alias("cluster"),
        ok(distance).alias("distance"),
        th.alias("threshold"),
        ok(far).alias("confidence"),
        F.array_join("processed", " ").alias("processed_text"),
        F.struct(*lx.FEATURES).alias("features"),
        "error",
    )


def save(spark: SparkSession, model: ReviewModel, path: str, mode: str = "error") -> None:
    """Five tables under path, each as small as the model."""
    e, put = model.encoder, lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(f"{path}/{name}")
    put([(i, t, float(x)) for i, (t, x) in enumerate(zip(e.terms, e.idf, strict=True))], "at int, term string, idf double", "vocabulary")
    put([(i, c, float(m), float(s)) for i, (c, m, s) in enumerate(zip(lx.FEATURES, e.mean, e.deviation, strict=True))], "at int, feature string, mean double, deviation double", "scaler")
    put(pa.table({"at": pa.array(range(len(model.basis)), pa.int32()), "row": pa.array(list(model.basis), pa.list_(pa.float64()))}), None, "basis")
    put([(i, [float(x) for x in c]) for i, c in enumerate(model.centroids)], "cluster int, c array<double>", "centroids")
    put([(float(model.threshold), None if model.f1_score is None else float(model.f1_score), [float(x) for x in model.singular])], "threshold double, f1_score double, singular array<double>", "threshold")


def load(spark: SparkSession, path: str) -> ReviewModel:
    get = lambda name, by: spark.read.parquet(f"{path}/{name}").orderBy(by).collect()
    words, scale, rows, cents, th = get("vocabulary", "at"), get("scaler", "at"), get("basis", "at"), get("centroids", "cluster"), get("threshold", "threshold")[0]
    encoder = Encoder([r["term"] for r in words], np.array([r["idf"] for r in words], float), np.array([r["mean"] for r in scale]), np.array([r["deviation"] for r in scale]))
    basis = np.array([r["row"] for r in rows], float)
    return ReviewModel(encoder, basis, np.array(th["singular"], float), np.array([r["c"] for r in cents], float).reshape(len(cents), basis.shape[1]), th["threshold"], th["f1_score"])
