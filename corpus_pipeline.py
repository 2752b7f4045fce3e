"""From raw documents to packed token sequences, in five stages.

1. quality_rules: documents that the rules reject go.
2. ngram_jaccard_join: of each group of linked documents the one with the smallest doc_id stays.
3. suffix_dedup: stretches of 100 bytes or more that occurred earlier are cut out; a document left empty goes.
4. secret_scan: every secret is replaced by a mark.
5. best_fit_packing: token pieces, their sequences and places; the only stage whose rows are not documents.

Each stage reads all that the one before kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from lexisift.llm.common import documents, ship_package, staged


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_dedup.deduplicated_documents(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", filter_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The Jaccard join's components, the repeats' byte positions and the tokenizer are beyond SQL;
#: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
