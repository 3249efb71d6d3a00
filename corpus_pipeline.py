"""A corpus from raw documents to packed sequences: stages that build on each other.

Language ID drops documents without any language, quality rules drop what fails them,
SimHash keeps one document of each near-duplicate group, and packing cuts the rest into
token sequences.  All stages but the last return the columns that they were given.
Null texts, languages, sources and IDs, repeated rows and empty tables have the results
that the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specframe.llm import langid, packing, quality, simhash
from specframe.runtime import materialize

LEAST_LANGUAGE_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter, or that no known language explains at
    least as well as all others together.  A corpus without any labelled text drops all."""
    model = langid.train(docs.filter(langid.crc_mod(F.col("doc_id"), 3) != 1))
    return langid.keep_identified(docs, model, LEAST_LANGUAGE_SHARE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or are outliers of their language and source."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("packing", packing_stage),
]
#: SQL has no byte-context trees, fingerprints or tokenizer; the tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
