"""A store of fitted models: versions that are whole or not there at all.

A version's tables are written to a folder of its own; then one row about it is appended to the manifests: its number and, of each
table, schema, rows and a checksum. Spark commits that row at once, so a save that is cut off leaves tables that
no manifest names, and the version before stays the newest. Loading holds every table against the manifest and
names the first one that is missing or differs.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.operators import model as mo

TABLES = ("vocabulary", "scaler", "basis", "centroids", "threshold")
_MANIFEST = "version long, name string, tables array<struct<name: string, schema: string, rows: long, checksum: string>>"


class BrokenModel(ValueError):
    """A part of a stored model is missing or is not what was saved."""


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(version, name, tables) of all whole versions."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def newest(spark: SparkSession, root: str) -> int | None:
    return manifests(spark, root).agg(F.max("version")).first()[0]


def _told(df: DataFrame) -> tuple[str, int, str]:
    """Schema, rows and checksum of a table."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("h")).first()
    return df.schema.simpleString(), got["n"], got["h"] or "0"


def publish(spark: SparkSession, model: mo.ReviewModel, root: str) -> int:
    """Save the model as the newest version, whose number is returned."""
    name = uuid.uuid4().hex
    folder = f"{root}/models/{name}"
    mo.save(spark, model, folder)
    tables = [(t, *_told(spark.read.parquet(f"{folder}/{t}"))) for t in TABLES]
    version = (newest(spark, root) or 0) + 1
    spark.createDataFrame([(version, name, tables)], _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")
    return version


def load(spark: SparkSession, root: str, version: int | None = None) -> mo.ReviewModel:
    """The model of a version, of the newest where none is given."""
    found = manifests(spark, root)
    rows = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version"), F.desc("name")).limit(1).collect()
    if not rows:
        raise LookupError(f"no version {'' if version is None else f'{version} '}under {root}")
    folder = f"{root}/models/{rows[0]['name']}"
    for t in rows[0]["tables"]:
        try:
            schema, n, checksum = _told(spark.read.parquet(f"{folder}/{t['name']}"))
        except Exception as e:
            raise BrokenModel(f"table {t['name']} of version {rows[0]['version']} can't be read") from e
        for what, now, then in (("schema", schema, t["schema"]), ("rows", n, t["rows"]), ("checksum", checksum, t["checksum"])):
            if now != then:
                raise BrokenModel(f"table {t['name']} of version {rows[0]['version']}: {what} {now}, saved {then}")
    return mo.load(spark, folder)
