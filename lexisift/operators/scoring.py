"""Vectors, centroids, distances, thresholds and metrics of the anomaly model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexisift.operators.stages import staged


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def normalised(df: DataFrame) -> DataFrame:
    wide = df.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    long_ = wide.withColumn("n", F.explode(F.array(F.sqrt(dot(F.col("e"), F.col("e"))))))  # once a row, not once an element
    return long_.select("vec_id", "label", F.transform("e", lambda x: F.when(F.col("n") == 0, 0.0).otherwise(x / F.col("n"))).alias("z"))


def centroids(z: DataFrame, cluster: str = "label") -> DataFrame:
    """One row per cluster: the members' mean at length 1; -1, noise, has none. As many rows as clusters."""
    parts = z.where(F.col(cluster) >= 0).select(F.col(cluster).alias("cluster"), F.posexplode("z").alias("pos", "x"))
    mean = parts.groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    rows = mean.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p"))
    raw = F.transform("p", lambda s: s["m"])
    return rows.select("cluster", raw.alias("raw")).select("cluster", F.transform("raw", lambda x: x / (F.sqrt(dot(F.col("raw"), F.col("raw"))) + F.lit(1e-10))).alias("c"))


def nearest(z: DataFrame, cents: DataFrame) -> DataFrame:
    """Each vector beside its nearest centroid; ties go to the lower cluster. There are few clusters, whatever the rows:
    they are gathered into one array, so that no vector is copied and nothing shuffles."""
    table = cents.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("table"))
    best = F.array_min(F.transform("table", lambda t: F.struct((F.lit(1.0) - dot(F.col("z"), t["c"])).alias("d"), t["cluster"].alias("cluster"))))
    return z.join(F.broadcast(table)).withColumn("_b", best).select("vec_id", "label", F.col("_b.cluster").alias("cluster"), F.col("_b.d").alias("distance"), "z")


def scored(embeddings: DataFrame, normal_below: int = 7) -> DataFrame:
    """vec_id, cluster, distance, true_label: labels of normal_below and more are the anomalies, with no centroid."""
    z = normalised(embeddings)
    near = nearest(z, centroids(z).where(F.col("cluster") < normal_below))
    return near.select("vec_id", "cluster", F.round("distance", 6).alias("distance"), F.when(F.col("label") >= normal_below, "Anomalous").otherwise("Normal").alias("true_label"))


def sweep(sc: DataFrame, n: int = 100) -> DataFrame:
    """Metrics at n thresholds, least to largest distance, from one pass: rows fall into the step that first excludes
    them, and sums over the steps after give the counts."""
    edge = sc.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    grid = edge.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "lo", "hi").select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(n - 1)).alias("threshold"))
    table = grid.agg(F.sort_array(F.collect_list("threshold")).alias("grid"))
    # the number of thresholds below a distance, found from the step width and set right by its neighbours
    step = F.size(F.filter("grid", lambda t: t < F.col("distance")))
    per = sc.join(F.broadcast(table)).groupBy(step.alias("step")).agg(
        F.count_if(F.col("true_label") == "Anomalous").alias("a"), F.count_if(F.col("true_label") != "Anomalous").alias("b")
    )
    joined = grid.join(per, per.step > grid.i, "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("tp"), F.coalesce(F.sum("b"), F.lit(0)).alias("fp"))
    totals = sc.agg(F.count_if(F.col("true_label") == "Anomalous").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = joined.join(F.broadcast(totals)).select("i", "threshold", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("n") - F.col("pos") - F.col("fp")).alias("tn"))
    return with_metrics(counts)


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_metrics(df: DataFrame) -> DataFrame:
    """tp, fp, fn, tn -> accuracy and so on; 0 where there is nothing to divide by."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "specificity": safe(tn, tn + fp), "false_alarm_rate": safe(fp, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1_score", safe(p * r * 2, p + r))


def confusion(sc: DataFrame, predicted: Column, true: Column) -> DataFrame:
    yes, real = predicted == "Anomalous", true == "Anomalous"
    return sc.agg(F.count_if(yes & real).alias("tp"), F.count_if(yes & ~real).alias("fp"), F.count_if(~yes & real).alias("fn"), F.count_if(~yes & ~real).alias("tn"))


def running(df: DataFrame, by: Column, *names: str) -> DataFrame:
    """``before_x`` for each name x: its sum over all rows that come before by the given order. Rows are sorted by range; what lies
    before a partition is summed up over one row for each partition, so no task sees all rows."""
    rows = staged(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()))
    w = W.orderBy("_at")
    totals = rows.groupBy(F.col("_part").alias("_at")).agg(*[F.sum(x).alias(f"_{x}") for x in names])
    totals = totals.select("_at", *[(F.sum(f"_{x}").over(w) - F.col(f"_{x}")).alias(f"_{x}") for x in names])
    own = W.partitionBy("_part").orderBy(by)
    local = rows.withColumns({f"_own_{x}": F.sum(x).over(own) - F.col(x) for x in names})
    both = local.join(F.broadcast(totals), F.col("_part") == F.col("_at"))
    return both.select(*df.columns, *[(F.col(f"_own_{x}") + F.col(f"_{x}")).alias(f"before_{x}") for x in names])


def _per_distance(sc: DataFrame) -> DataFrame:
    return sc.groupBy("distance").agg(F.count_if(F.col("true_label") == "Anomalous").alias("a"), F.count(F.lit(1)).alias("k"))


def roc_auc(sc: DataFrame) -> DataFrame:
    """By rank sums with mean ranks for ties; rows are counted per distance first."""
    ranked = running(_per_distance(sc), F.col("distance").asc(), "k")
    sums = ranked.agg(F.sum(F.col("a") * (F.col("before_k") + (F.col("k") + 1) / 2)).alias("s"), F.sum("a").alias("p"), F.sum("k").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(((F.col("s") - p * (p + 1) / 2) / (p * q)).alias("roc_auc"))


def average_precision(sc: DataFrame) -> DataFrame:
    """The sum of precision over steps of recall, by falling distance."""
    at = running(_per_distance(sc), F.col("distance").desc(), "a", "k")
    a, tp, n = F.col("a"), F.col("before_a") + F.col("a"), F.col("before_k") + F.col("k")
    return at.agg((F.sum(a * tp / n) / F.sum("a")).alias("average_precision"))


def best(swept: DataFrame) -> DataFrame:
    """The first threshold with the largest F1."""
    return swept.agg(F.max_by(F.struct("threshold", "f1_score", "precision", "recall"), F.struct(F.round("f1_score", 9), -F.col("i"))).alias("b")).select("b.*")
