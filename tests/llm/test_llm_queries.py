"""Queries of the subpackage against their SQL, and the pipeline's stages on their own inputs."""

import pytest
from oracle import assert_same, connect


@pytest.mark.parametrize("name", ["op2_warc", "op4_quality_rules", "op7_mixing"])
def test_oracle(spark, sf, name):
    from isogloss.llm import register

    assert_same(spark, connect(sf), register.QUERIES[name], register.ORACLE_SQL[name], sf)


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert docs.filter("text rlike '[A-Za-z0-9]@[a-z0-9]+[.]example'").isEmpty()
