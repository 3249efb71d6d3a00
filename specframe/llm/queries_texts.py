"""Queries on whole texts and vectors."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, packing, quality, simhash, topk, toxicity
from .registry import query, table


@query("op4_bpe")
def byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), vocabulary, decoded=True))


@query("op7_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_TOP = 20
_TOP_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= {_TOP}
"""


@query("op5_topk", _TOP_SQL)
def top_rows(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantised(F.col("embedding")).alias("q"))
    return topk.exact_top(vectors, _TOP, F.col("vec_id") % 20 == 0)


@query("op9_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(docs.filter(langid.crc_mod(F.col("doc_id"), 3) != 1))
    return langid.identify(docs, model)


@query("op6_quality")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


@query("op8_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    seen = langid.crc_mod(F.col("doc_id"), toxicity.FOLDS) != 0
    return toxicity.score(docs, toxicity.train(docs.filter(seen), labels.filter(seen)))
