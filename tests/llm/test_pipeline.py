"""The stages against plain versions of them, and what the whole run returns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specframe.llm import packing, quality, sharding, simhash
from specframe.llm.chat import expand

from .test_packing import PATH, check_packed
from .test_simhash import components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows in and out of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [name for name, _, _ in stages] == ["language_id", "quality_rules", "simhash_dedup", "packing"]
    for name, docs, after in stages[:-1]:
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0, name


def test_language_stage_keeps_texts_with_letters(stages):
    _, docs, after = stages[0]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}


def test_quality_stage_follows_the_verdicts(stages):
    _, docs, after = stages[1]
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and 0 < len(kept) < docs.count()


def test_dedup_stage_keeps_one_of_each_component(stages):
    _, docs, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    first = components(np.array([slow_fingerprint(text) for _, text in rows], dtype=np.uint64), simhash.RADIUS)
    assert {r["doc_id"] for r in after.collect()} == {rows[i][0] for i in first}


def test_packing_stage_packs_what_is_left(stages):
    _, docs, after = stages[3]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, pieces, _ = check_packed(after.collect(), texts)
    assert pieces.keys() == texts.keys() == ids.keys()


def test_run_returns_the_last_stage(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert corpus_pipeline.run(spark, FOLDER).select(key).exceptAll(stages[-1][2].select(key)).count() == 0


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, FOLDER)
            assert after.count() >= 0
            if name != "packing":
                assert after.columns == docs.columns


def test_native_operators_plan_no_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    for df in (sharding.interleave(docs, 40), expand(conversations), docs.select(quality.base_counts(F.col("text")))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert "MapInArrow" in packing.cut_pieces(docs, packing.TokenizerFile.of(spark, PATH))._jdf.queryExecution().toString()
