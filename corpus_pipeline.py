"""A corpus pipeline: each stage calls one operator of ``soilcast.llm`` on everything its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; it is written as Parquet to the shared folder and reread as
the next stage's documents. All but the last return the columns of ``documents``; the last returns pieces with their
places in packed sequences. A document that mixing takes twice is two rows with one doc_id from there on."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soilcast.llm import mixing, packing, pii, quality, simhash
from soilcast.llm.common import run_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or whose posterior quality is below the threshold go."""
    return quality.accept(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the new text."""
    return pii.replace(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: whole documents once or twice, parts of a document at the ends of a run of blocks."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup),
          ("pii_surrogates", pii_surrogates), ("source_mixing", source_mixing),
          ("best_fit_packing", best_fit_packing)]

# EM, XXH64 fingerprints and the tokenizer have no DuckDB form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents`` to packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = run_folder(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
