"""Everything that is said of one model, as one record; and two thresholds beside each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.operators import scoring as so

MATRIX = ("tp", "fp", "fn", "tn")
METRICS = ("accuracy", "precision", "recall", "specificity", "false_alarm_rate", "f1_score")


def at_threshold(sc: DataFrame, threshold: Column) -> DataFrame:
    """One row: the matrix and its metrics, where distances over the threshold are anomalies."""
    return so.with_metrics(so.confusion(sc, F.when(F.col("distance") > threshold, "Anomalous").otherwise("Normal"), F.col("true_label")))


def distances(sc: DataFrame) -> DataFrame:
    """One row: statistics of the distances of normal and of anomalous rows, and the ratio of their means."""
    parts = []
    for name, label in (("normal", "Normal"), ("anomalous", "Anomalous")):
        own = F.when(F.col("true_label") == label, F.col("distance"))
        parts += [f(own).alias(f"{name}_{k}") for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    df = sc.agg(*parts)
    return df.withColumn("separation", F.when(F.col("normal_mean") == 0, F.lit(float("inf"))).otherwise(F.col("anomalous_mean") / F.col("normal_mean")))


def record(sc: DataFrame, threshold: float, steps: int = 100) -> DataFrame:
    """One row of structs: metrics at the threshold, area under the curve, average precision, distance statistics, and the
    sweep's best threshold beside the one in use. All parts are one-row tables, so that joining them moves no data."""
    own = at_threshold(sc, F.lit(threshold)).select(F.struct(*MATRIX, *METRICS).alias("metrics"))
    best = so.best(so.sweep(sc, steps)).select(F.struct(F.lit(float(threshold)).alias("in_use"), F.col("threshold").alias("best"), "f1_score", "precision", "recall").alias("threshold_analysis"))
    stats = distances(sc)
    one = own.crossJoin(so.roc_auc(sc).select(F.col("roc_auc").cast("double").alias("roc_auc"))).crossJoin(so.average_precision(sc))
    return one.crossJoin(stats.select(F.struct(*stats.columns).alias("distance_statistics"))).crossJoin(best)


def improvement(sc: DataFrame, threshold: float, steps: int = 500) -> DataFrame:
    """One row per metric and cell: before, at the threshold; after, at the sweep's best; and the difference."""
    best = F.broadcast(so.best(so.sweep(sc, steps)).select("threshold"))
    names = (*MATRIX, *METRICS)
    before = at_threshold(sc, F.lit(threshold)).select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "metric", "before")
    after = at_threshold(sc.join(best), F.col("threshold")).select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "metric", "after")
    return before.join(after, "metric").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("gain"))
