"""The pipeline's stages: columns, decisions and what they keep."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geolith.llm import jaccard_join, language_id, line_dedup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_only_drop(spark, docs):
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= before.count()
        before = after


def test_decisions_take_effect(spark, docs):
    rejected = language_id.predict(docs, language_id.fit(docs)).where("__rejected").select("doc_id")
    assert corpus_pipeline.language(spark, docs, SF).join(rejected, "doc_id", "left_semi").count() == 0
    low = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where(F.col("__score") < 0.3).select("doc_id")
    assert corpus_pipeline.good_quality(spark, docs, SF).join(low, "doc_id", "left_semi").count() == 0
    lines = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, docs, SF).collect()} == lines
    groups = jaccard_join.jaccard_components(docs, percent=80, n=5).select("component_id").distinct().count()
    assert corpus_pipeline.no_near_copies(spark, docs, SF).count() == groups


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    most, least, n = out.agg(F.max(F.col("offset") + F.col("length")), F.min("offset"), F.count("*")).first()
    assert most <= 2048 and least == 0 and n > 0


def test_empty_input(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
