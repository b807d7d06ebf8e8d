"""What one task reads or holds, of tables that outgrow it."""

import random

import pytest
from pyspark.sql import functions as F

from wayframe.errors import PlanError
from wayframe.graph import PropertyGraph
from wayframe.operators import aggregates
from wayframe.plans.steps import percentile
from wayframe.schema import vertex_schema

_EDGES = "gid string, label string, `from` string, `to` string, data struct<w: int>"


def graph(spark, rows):
    v = rows.select(F.concat(F.lit("n"), F.monotonically_increasing_id()).alias("gid"), F.lit("N").alias("label"), F.struct("x").alias("data"))
    return PropertyGraph(v, spark.createDataFrame([], _EDGES))


def tasks(spark, run):
    """(MB of shuffle read, MB of execution memory) of the tasks that run starts, the most of each."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    none, no = sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()
    stages = lambda: {s.stageId(): s for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(no, False, False, none, no))}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = set(stages())
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    read = memory = 0
    for k in set(stages()) - before:
        for t in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.taskList(k, 0, 100_000)):
            if t.taskMetrics().isDefined():
                m = t.taskMetrics().get()
                r = m.shuffleReadMetrics()
                read, memory = max(read, r.localBytesRead() + r.remoteBytesRead()), max(memory, m.peakExecutionMemory())
    return read / 1e6, memory / 1e6


def test_no_task_reads_all_values_of_a_percentile(spark):
    n = 400_000
    t = graph(spark, spark.range(0, n, 1, 4).select((F.col("id") * 7919 % n / 8).alias("x"))).query().V().aggregate(percentile("p", "x", [0, 50, 99]))
    got = []
    read, _ = tasks(spark, lambda: got.extend(t.to_df().collect()))
    assert {r["key"]: r["value"] for r in got} == {"0": 0.0, "50": (n - 1) / 16, "99": pytest.approx((n - 1) * 0.99 / 8)}
    assert read < 1


@pytest.mark.parametrize("bounds", ["near", "far"])
def test_percentiles_are_exact_wherever_the_bounds_lie(spark, monkeypatch, bounds):
    nan, inf = float("nan"), float("inf")
    if bounds == "far":
        monkeypatch.setattr(aggregates, "NEAR", 1.0)
    ps = [0, 1, 33.3, 50, 75, 99, 100]
    for xs in ([3.5], [1.0, 2.0], [1.0] * 50 + [2.0], [nan, 1.0, None, nan], [-inf, 1.0, inf, inf], [-5.0, -0.0, 0.0, 7.0], [1e308, -1e308, 5e-324], [float(i % 40) for i in range(3000)]):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        want = df.agg(F.percentile("x", F.array(*[F.lit(p / 100) for p in ps])).alias("q")).first()["q"]
        got = [r["value"] for r in graph(spark, df).query().V().aggregate(percentile("p", "x", ps)).to_df().collect()]
        assert str(got).replace("-0.0", "0.0") == str(want).replace("-0.0", "0.0"), xs
    none = graph(spark, spark.createDataFrame([(None,)], "x double")).query().V()
    assert none.aggregate(percentile("p", "x", ps)).to_df().collect() == []
    with pytest.raises(PlanError):
        none.aggregate(percentile("p", "x", [101])).to_df()


def test_percentiles_of_travelers_that_vary_are_of_one_run(spark):
    g = graph(spark, spark.range(0, 1000, 1, 4).select(F.col("id").cast("double").alias("x")))
    dice = F.udf(lambda: random.random(), "double").asNondeterministic()
    vary = lambda df: df.where(dice() < 0.5)
    for t in (g.query().V().limit(100), g.query().V().custom(vary)):
        got = t.aggregate(percentile("p", "x", [0, 50, 100])).to_df().collect()
        assert len(got) == 3 and all(r["value"] is not None for r in got)


@pytest.mark.parametrize("typed", [True, False])
def test_no_task_sorts_all_fields_for_a_schema(spark, typed):
    fields = {"n": F.col("id"), "s": F.lit("text"), "b": F.lit(True), "xs": F.array("id"), "o": F.struct(F.col("id").alias("i"))}
    data = F.struct(*[c.alias(n) for n, c in fields.items()])
    v = spark.range(0, 600_000, 1, 1).select(F.col("id").cast("string").alias("gid"), F.lit("N").alias("label"), (data if typed else F.to_variant_object(data)).alias("data"))
    e = v.where("false").select("gid", "label", F.col("gid").alias("from"), F.col("gid").alias("to"), "data")
    got = []
    _, memory = tasks(spark, lambda: got.extend(vertex_schema(PropertyGraph(v, e)).collect()))
    assert sorted(map(tuple, got)) == [("N", "b", "BOOL"), ("N", "n", "NUMERIC"), ("N", "o", "OBJECT"), ("N", "o.i", "NUMERIC"), ("N", "s", "STRING"), ("N", "xs", "[NUMERIC]")]
    assert memory < 100


def test_schema_of_odd_fields(spark):
    v = spark.createDataFrame([("a", "L", ((1,), "x", None, None)), ("b", "M", (None, "y", None, None)), ("c", "N", (None, None, None, [])), (None, None, ((None,), None, None, None))], "gid string, label string, data struct<a: struct<b: int>, `a.b`: string, no: int, xs: array<array<int>>>")
    got = vertex_schema(PropertyGraph(v, spark.createDataFrame([], "gid string, label string, `from` string, `to` string, data struct<no: int>")))
    assert sorted(map(str, map(tuple, got.collect()))) == ["('L', 'a', 'OBJECT')", "('L', 'a.b', 'NUMERIC')", "('M', 'a.b', 'STRING')", "('N', 'xs', '[[NUMERIC]]')", "(None, 'a', 'OBJECT')"]
    w = spark.createDataFrame([("a", '{"k": null, "m": null, "e": [], "t": ["x"]}'), ("b", '{"k": 1, "t": [{}], "a": {"b": {"c": {"d": 1}}}}'), ("c", '{"k": "s"}'), ("d", "7"), ("e", None)], "gid string, j string").select("gid", F.lit("L").alias("label"), F.parse_json("j").alias("data"))
    got = vertex_schema(PropertyGraph(w, w.where("false").select("gid", "label", F.col("gid").alias("from"), F.col("gid").alias("to"), "data")))
    assert {r.field: r.type for r in got.collect()} == {"k": "NUMERIC", "m": "UNKNOWN", "e": "[UNKNOWN]", "t": "[OBJECT]", "a": "OBJECT", "a.b": "OBJECT", "a.b.c": "OBJECT"}
