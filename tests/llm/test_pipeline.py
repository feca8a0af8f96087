"""The pipeline's stages, one after the other, against each stage's operator checked on its own input."""

import corpus_pipeline as p


def test_stages(spark, sf):
    from tidemark.session import ship
    from tidemark.llm.common import stored

    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = {}
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs.count()
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert n > seen["quality_filter"] > seen["near_dedup"] == seen["repeat_dedup"] > 0
    assert seen["source_mixing"] == seen["tokenize"]
    assert docs.where("n_tokens <> size(ids)").count() == 0
    assert p.run(spark, sf).count() == seen["tokenize"]
