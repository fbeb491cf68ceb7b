import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steplake.llm import decontam, lines, rules, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, SF).cache()
    kept = rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    two = stages["line_dedup"](spark, one, SF).cache()
    assert two.columns == docs.columns and two.count() == one.count()
    want = {r.doc_id: r.k for r in lines.line_dedup(one).select("doc_id", F.col("_lines.kept").alias("k")).collect()}
    assert {r.doc_id: r.text for r in two.collect()} == want
    three = stages["near_dedup"](spark, two, SF).cache()
    assert {r.doc_id for r in three.collect()} == {r.component_id for r in simhash.similar_documents(two).collect()}
    four = stages["decontamination"](spark, three, SF).cache()
    bad = {r.doc_id for r in decontam.contaminated(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - bad
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in four.collect()}
