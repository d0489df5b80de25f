"""The corpus pipeline on sf0.001, and the registered queries' columns."""

import corpus_pipeline
from tests.conftest import DATA
from tidemark.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    ids = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == source.columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids = now
    assert docs.columns == [*source.columns, "shard", "slot"] and docs.count() >= len(ids) > 50
    assert docs.select("shard", "slot").distinct().count() == docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
