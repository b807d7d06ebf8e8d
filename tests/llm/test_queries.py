import pytest

import corpus_pipeline
from tests.oracle import compare, connect
from wayframe.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, sf, name):
    compare(Q.QUERIES[name](spark, sf), connect(sf), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry_has_them_all():
    import __spark_entry__ as e

    names = e.queries()
    assert set(Q.QUERIES) | {"pipeline"} <= set(names) and set(e.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
    whole = {(r.doc_id, r.piece, r.tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r.doc_id, r.piece, r.tokens) for r in docs.collect()}


def test_pipeline_takes_odd_rows(spark, odd_docs, no_docs, tmp_path, sf):
    for k, d in enumerate((odd_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, d, sf).write.parquet(str(tmp_path / f"{k}{name}"))
            d = spark.read.parquet(str(tmp_path / f"{k}{name}"))
