"""Tables between the rounds of an iteration, in a folder that driver and executors share, and the package for their workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def fresh(spark: SparkSession, kind: str = "review") -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        base = "file://" + tempfile.mkdtemp(prefix="lexisift-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        if alone:
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, fresh(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the package: on this machine from where it lies, elsewhere from a copy that Spark hands out."""
    sc = spark.sparkContext
    env = sc.environment
    if HOME not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (HOME, env.get("PYTHONPATH", "")) if x)
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if alone or getattr(sc, "_lexisift_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexisift-"), "lexisift.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(HOME, "lexisift")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, HOME))
    sc.addPyFile(path)
    sc._lexisift_shipped = True


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the Arrow batches of each partition, by workers that can import the package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer partitions than there are; a larger table stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
