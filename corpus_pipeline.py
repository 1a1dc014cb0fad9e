"""The corpus pipeline: toxicity, SimHash near-dedup, substring dedup, best-fit packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.llm import common, packing, simhash_dedup, substring_dedup, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't predict as toxic; it learns from the labels beside the documents."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row, that with the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts lose the words of windows that a document with a smaller doc_id has, and n_chars follows."""
    out = substring_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each in its sequence."""
    return packing.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash_dedup", simhash_stage), ("substring_dedup", substring_stage), ("best_fit_packing", packing_stage)]

#: The stages' hashes, training and tokens are beyond SQL; tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
