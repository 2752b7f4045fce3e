"""Readers and writers of reviews, vectors and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RAW = "review string, label string"


def read_raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons, Latin-2, quoted texts over several lines. Spark reads Latin-2 only where all Java charsets are allowed."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, schema=RAW, sep=";", header=True, encoding="ISO-8859-2", multiLine=True, escape='"')


def read_reviews(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_reviews(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """mode 'ignore' builds only what is missing."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).csv(path, header=True, escape='"')
    else:
        df.write.mode(mode).format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document of one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_matrix(df: DataFrame, path: str, width: int, key: str = "doc_id", mode: str = "error") -> None:
    """Sparse rows (key, at array<int>, v array<double>) of a matrix that is ``width`` wide, laid out as the ML library's vectors."""
    required(df, key, "at", "v")
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"), F.col("at").cast("array<int>").alias("indices"), F.col("v").cast("array<double>").alias("values"))
    df.select(F.col(key).alias("key"), vector.alias("vector")).write.mode(mode).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector): the rows as sparse vectors of the ML library, as they lie there."""
    from pyspark.ml.linalg import VectorUDT

    return spark.read.schema(StructType([StructField("key", LongType()), StructField("vector", VectorUDT())])).parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Named tables beside each other as CSV with headers, in place of the sheets of one file."""
    for name, df in tables.items():
        df.coalesce(1).write.mode(mode).csv(f"{path}/{name}", header=True, escape='"')


def read_lexicon(spark: SparkSession, path: str, most: int = 50_000) -> dict[str, tuple[float, float]]:
    """A lexicon from CSV (word, polarity, subjectivity); one with more than ``most`` words is refused, as it goes to every task."""
    rows = read_reviews(spark, path, "word string, polarity double, subjectivity double").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} words")
    return {r["word"]: (r["polarity"], r["subjectivity"]) for r in rows}


def read_basis(spark: SparkSession, path: str, profile: DataFrame) -> DataFrame:
    """The profile with the values that a JSON document {feature: {min, max, optimal}} gives in their place. Features unknown to
    the profile are added with what they have."""
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<min: double, max: double, optimal: double>>")).alias("feature", "b"))
    df = profile.join(F.broadcast(own), "feature", "full")
    return df.select("feature", *[F.coalesce(F.col(f"b.{new}"), F.col(old)).alias(old) for new, old in (("min", "low"), ("max", "high"), ("optimal", "optimal"))])


def preview(df: DataFrame, n: int = 5, *by: str) -> DataFrame:
    """The first n rows by the given columns, or by the first column."""
    return df.orderBy(*(by or df.columns[:1])).limit(n)


def build_if_missing(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; where there is none, ``build()`` is written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def text_column(df: DataFrame) -> str:
    """original_review where there is one, else review."""
    for name in ("original_review", "review", "text"):
        if name in df.columns:
            return name
    raise ValueError(f"no text column among {df.columns}")


def required(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
