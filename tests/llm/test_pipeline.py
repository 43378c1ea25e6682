import pytest

from sparkwarden.llm import registry

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    left = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids, name
        left.append(len(now))
        ids = now
    assert left[0] > left[1] >= left[2] >= left[3] > 0
    pieces = pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in pieces} == ids


@pytest.mark.parametrize("name", ["op1_warc_index", "op2_decontamination", "op5_substring_dedup", "op6_jaccard_join"])
def test_query_equals_sql(spark, duck, small, same, name):
    assert same(registry.queries()[name](spark, small), duck, registry.oracle_sql()[name])
