"""The pipeline's stages on a small table, each on what the one before kept."""

import os

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    cols = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == cols, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0 < docs.count() <= 3 * before
        if k == 3:
            kept = before, docs.count()
    assert docs.count() == kept[1]
    rows = docs.orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
