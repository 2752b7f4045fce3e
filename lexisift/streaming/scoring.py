"""Verdicts on a stream, by the rules or by the newest fitted model. Both are stateless expressions, the same as on a table, so no
watermark is needed."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import features as ft
from lexisift.functions import predicates as pr
from lexisift.operators import model as mo
from lexisift.operators import store as st
from lexisift.operators.stages import fresh

SCHEMA = "doc_id bigint, text string"


def verdicts(stream: DataFrame) -> DataFrame:
    base = stream.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("gibberish", pr.gibberish(F.col("text")))
    f = ft.rule_features(base, keep=("doc_id", "gibberish"))
    return f.select("doc_id", ft.warnings().cast("long").alias("warning_count"), ft.forced(F.col("gibberish"), F.col("first")).alias("forced"))


def opened(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream over the Parquet files of the folder ``path``, or over that one file. A stream reads folders, so of a single file's
    folder it takes what has exactly the file's name; tables beside it are not read."""
    path = path.rstrip("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    plain = unquote(urlparse(path).path)
    alone = len(files) == 1 and (found := unquote(urlparse(files[0]).path)) in (plain, f"{os.getcwd()}/{plain}")
    source = spark.readStream.schema(schema)
    if not alone:
        return source.option("pathGlobFilter", "*.parquet").parquet(path)
    folder, _, name = found.rpartition("/")
    scheme = path[: len(path) - len(urlparse(path).path)] if urlparse(path).scheme else ""
    return source.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", name)).parquet(f"{scheme}{folder}")


def scored_stream(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """All files there now, scored once through a stream into a table in the shared folder; ``out`` names another folder."""
    out = out or fresh(spark, "stream")
    run = verdicts(opened(spark, path)).writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").outputMode("append").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema("doc_id bigint, warning_count bigint, forced boolean").parquet(out)


class Newest:
    """Scores one micro-batch after another by the newest model of a store. The model is loaded and sent out once for each version:
    a newer one takes its place between two batches, and the batch in work is scored by one model throughout."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.root, self.key, self.text = spark, root, key, text
        self.version, self.model, self.sent = None, None, None

    def refresh(self) -> None:
        version = st.newest(self.spark, self.root)
        if version == self.version and self.model is not None:
            return
        self.model = st.load(self.spark, self.root, version)
        if self.sent is not None:
            self.sent.unpersist()
        self.version, self.sent = version, mo.sent_out(self.spark, self.model)

    def scored(self, batch: DataFrame) -> DataFrame:
        self.refresh()
        return mo.scored(batch, self.model, self.key, self.text, self.sent).withColumn("version", F.lit(self.version).cast("long"))


def score_by_model(stream: DataFrame, root: str, out: str, key: str = "doc_id", text: str = "text", **trigger):
    """Start a query that writes the verdicts of every micro-batch to ``out``, a folder for each batch, so that a batch that is run again after
    a failure replaces its own rows. ``trigger`` as of ``DataStreamWriter.trigger``; all that is there now, by default."""
    by = Newest(stream.sparkSession, root, key, text)

    def write(batch: DataFrame, number: int) -> None:
        by.scored(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}-progress").trigger(**(trigger or {"availableNow": True})).start()
