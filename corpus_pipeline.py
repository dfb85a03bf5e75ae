"""A training corpus from ``documents``: quality, exact and near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.llm.common import lower_ascii, table
from assetspark.llm.exact_dedup import drop_copies
from assetspark.llm.mixing import mixed_documents
from assetspark.llm.near_dedup import drop_near_copies
from assetspark.llm.packing import pack
from assetspark.llm.quality_model import quality_selection
from assetspark.llm.queries import WEIGHTS, tokenizer_path
from assetspark.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    kept = quality_selection(docs, table(spark, sf_dir, "labels")).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the smallest id stays."""
    return drop_copies(docs, lower_ascii(F.coalesce("text", F.lit(""))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity 0.8 or more."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as the source mix takes them."""
    return mixed_documents(docs, WEIGHTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", mix),
    ("best_fit_packing", sequences),
]

#: A tokenizer and hashed models are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
