"""What the corpus operators share: stage tables, Arrow helpers and small plan pieces."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session has it. Only a session without one that runs in a single
    process gets a folder of its own; elsewhere the warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="lexisift-")
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    return spark.conf.get("spark.sql.warehouse.dir")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor then costs only its own tasks.

    Row groups of 32 MB bound what each writing task holds in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the package: on this machine from where it lies, elsewhere from a copy that Spark hands out."""
    sc = spark.sparkContext
    env = sc.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if alone or getattr(sc, "_lexisift_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexisift-"), "lexisift.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(REPO, "lexisift")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, REPO))
    sc.addPyFile(path)
    sc._lexisift_shipped = True


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges whose texts have about ``most`` bytes together; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def partitions_for(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """How many partitions ``size`` bytes make at ``each`` apiece, the session's number of shuffle partitions at least."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def rank_within(df: DataFrame, group: str, bucket: str, order: list, out: str) -> DataFrame:
    """``out``: rows numbered from 0 without gaps in each ``group``, by ``bucket``, then ``order``.

    No group meets in one task: only a (group, bucket) pair does, and buckets are hashes. The counts of the pairs
    are summed up over a table of one row per pair.
    """
    from pyspark.sql import Window as W

    local = df.withColumn("_at", F.row_number().over(W.partitionBy(group, bucket).orderBy(*order)) - F.lit(1))
    sizes = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        F.col(group).alias("_g"),
        F.col(bucket).alias("_b"),
        (F.sum("_n").over(W.partitionBy(group).orderBy(bucket)) - F.col("_n")).alias("_before"),
    )
    joined = local.join(before, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_at", "_g", "_b", "_before")
