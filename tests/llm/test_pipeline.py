"""The pipeline against a plain version of its steps, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import minhash, pii, quality

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "sentence_pieces"]
    verdicts = {r.doc_id for r in quality.quality_verdicts(docs).filter("kept").collect()}
    kept = docs.filter(F.col("doc_id").isin(sorted(verdicts)))
    groups = {r.doc_id for r in minhash.near_duplicates(kept, 5, 80, 32, 4).filter("kept").collect()}
    left = kept.filter(F.col("doc_id").isin(sorted(groups)))
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert {r.doc_id for r in rows} == groups  # mixing repeats and drops nothing
    assert all(r.lossless for r in rows) and len(rows) >= len(groups)
    assert len({(r.doc_id, tuple(r.pieces)) for r in rows}) == len(rows)  # each copy is drawn by itself
    clean = corpus_pipeline.personal_data(spark, left, SMALL)
    assert clean.columns == docs.columns
    bad = pii.pii_report(clean).filter("n_email + n_card + n_phone > 0").count()
    assert bad == 0
    assert clean.filter("n_chars <> length(text)").count() == 0
