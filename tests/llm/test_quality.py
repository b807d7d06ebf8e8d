import numpy as np
import pytest

from wayframe.llm import quality as Q


def test_fit_learns_tables_and_interactions():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (6000, 4))
    y = ((np.abs(x[:, 0]) < 0.5) + 1.5 * (x[:, 1] * x[:, 2] > 0) + rng.normal(0, 0.2, 6000) > 1.2).astype(float)
    m = Q.fit(x[:4000], y[:4000])
    assert ((m.score(x[4000:]) > 0) == (y[4000:] > 0)).mean() > 0.8
    assert any({i, j} == {1, 2} for i, j, *_ in m.pairs)
    # a score is the sum of table cells
    i = 17
    s = m.base + sum(t[np.searchsorted(e, x[i, j], side="right")] for j, (e, t) in enumerate(zip(m.edges, m.tables)))
    s += sum(t[np.searchsorted(a, x[i, p], side="right"), np.searchsorted(b, x[i, q], side="right")] for p, q, a, b, t in m.pairs)
    assert s == pytest.approx(m.score(x[i : i + 1])[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = Q.score(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0").withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t"), "doc_id").toPandas()
    assert len(got) > 800
    assert ((got.quality >= 0.5) == (got.q > 0)).mean() > 0.95
    assert ((got.toxic >= 0.5) == (got.t > 0)).mean() > 0.95
    assert got.keep[(got.q > 0) & (got.t == 0)].mean() > 0.97


def test_bound_of_the_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert Q.score(docs, labels, max_train=20).count() == docs.count()


def test_odd_rows(spark, odd_docs, no_docs, sf):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (4, 0, 1), (None, 1, 1), (7, 1, None), (99, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    same = [r for r in got if r.doc_id == 1]
    assert len({r.quality for r in same}) <= 2
    kept = Q.accept(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.keep for r in got)
    none = labels.where("false")
    assert all(r.keep for r in Q.score(odd_docs, none).collect())
    assert Q.score(no_docs, labels).count() == 0 and Q.accept(no_docs, none).count() == 0
