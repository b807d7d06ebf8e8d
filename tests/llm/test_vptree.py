import numpy as np

from wayframe.llm import vptree as V


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        d = np.sqrt(((x - q) ** 2).sum(1))
        near = sorted((float(a), int(j)) for a, j in zip(d, ids) if j != i)[:k]
        out[int(i)] = near
    return out


def test_factor_one_is_exact_and_recall(spark, sf):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = e.toPandas()
    want = brute(p.vec_id.to_numpy(), np.stack(p.embedding).astype(float), 10)
    for factor, least in ((1.0, 1.0), (V.FACTOR, 0.9)):
        got = {}
        for r in V.neighbours(e, factor=factor, shard=700).collect():
            got.setdefault(r.vec_id, {})[r.neighbour_id] = r.distance
        hit = [len(set(got[i]) & {j for _, j in w}) / 10 for i, w in want.items()]
        assert len(got) == len(want) and np.mean(hit) >= least
        assert all(len(g) == 10 for g in got.values())


def test_query_set_and_hot_ball(spark):
    """A third of the vectors are equal, and shards are small: the ball is split, nothing is lost."""
    rng = np.random.default_rng(2)
    x = np.concatenate((np.ones((300, 8)), rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 0.1 + 5)).astype(np.float32)
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(np.arange(900), x.astype(float), 5)
    got = {}
    for r in V.neighbours(d, k=5, factor=1.0, shard=50, every=100).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.distance, r.neighbour_id))
    assert set(got) == set(range(0, 900, 100))
    for i, g in got.items():
        assert [n for _, _, n in sorted(g)] == [j for _, j in want[i]] or np.allclose([c for _, c, _ in sorted(g)], [c for c, _ in want[i]], atol=1e-6)


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [0.0, 1.0]), (8, [1.0, 2.0, 3.0]), (3, [5.0, 5.0])]
    rows += [(100 + i, [2.0, 2.0]) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", V.F.lit(1)).withColumn("shard", V.F.lit(1)).withColumn("v", V.F.lit(1))
    for factor in (1.0, 2.0):
        got = {}
        for r in V.neighbours(d, k=2, factor=factor).orderBy("vec_id", "rank").collect():
            got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
        assert got[1] == [(1, 2, 0.0), (2, 3, 1.0)] and got[2][0] == (1, 1, 0.0)
        assert got[150] == [(1, 100, 0.0), (2, 101, 0.0)] and got[100] == [(1, 101, 0.0), (2, 102, 0.0)]
        assert set(got) == {1, 2, 3} | set(range(100, 400))
    assert V.neighbours(d.where("false")).count() == 0
