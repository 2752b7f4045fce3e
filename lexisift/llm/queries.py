"""The operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm.common import documents, ship_package
from lexisift.operators.stages import spread

#: query -> (module, function of the documents)
_BY_DOCUMENTS = {
    "op1_ngram_jaccard_join": ("ngram_join", "links"),
    "op2_suffix_dedup": ("suffix_dedup", "deduplicated"),
    "op3_pii": ("pii", "personal"),
    "op4_rendezvous_sharding": ("sharding", "sharded"),
    "op5_best_fit_packing": ("packing", "packed"),
    "op6_quality_rules": ("quality_rules", "quality"),
    "op7_byte_bpe": ("byte_bpe", "encoded"),
    "op9_fingerprints": ("fingerprint", "fingerprints"),
    "op10_secret_scan": ("secret_scan", "secrets"),
    "op11_merkle_manifest": ("merkle", "manifest"),
    "op12_periodic_runs": ("periodic", "periodic"),
    "op13_language_id": ("language", "identified"),
}


#: Those that work in Python row by row of the scan: a table with fewer partitions than cores is dealt out first.
_SPREAD = {"byte_bpe", "fingerprint", "language", "ngram_join", "packing", "periodic", "suffix_dedup"}


def _query(module: str, function: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir)
        return getattr(import_module(f"lexisift.llm.{module}"), function)(spread(docs) if module in _SPREAD else docs)

    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ship_package(spark)
    return corpus_pipeline.run(spark, sf_dir)


def _classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexisift.llm.quality_classifier import query

    return query(spark, sf_dir)


def queries() -> dict:
    return {name: _query(*at) for name, at in _BY_DOCUMENTS.items()} | {"op8_quality_classifier": _classifier, "pipeline": _pipeline}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"lexisift.llm.{module}"), "SQL", None) for name, (module, _) in _BY_DOCUMENTS.items()}
    return {name: sql for name, sql in found.items() if sql}
