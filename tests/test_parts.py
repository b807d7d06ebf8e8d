"""Mapping, files, writes, schema, jobs, catalog and streams."""

import gzip
import json

import pytest

from wayframe import writes
from wayframe.catalog import Catalog
from wayframe.errors import NotFound, PlanError
from wayframe.functions import conditions as C
from wayframe.jobs import JobStore
from wayframe.plans.steps import __, term
from wayframe.schema import edge_schema, vertex_schema
from wayframe.sources import files
from wayframe.sources.mapping import EdgeTable, ForeignKey, GraphMapping, VertexTable
from wayframe.streaming.ingest import GraphStore, file_records

V = [{"gid": "a", "label": "L", "data": {"n": 1, "in": {"x": "s"}}}, {"gid": "b", "label": "L", "data": {"n": None, "xs": [1]}}, {"gid": "c", "label": "M"}]
E = [{"gid": "e1", "label": "to", "from": "a", "to": "b", "data": {"w": 2}}, {"gid": "e2", "label": "to", "from": "b", "to": "c"}]


@pytest.fixture(scope="module")
def g(spark):
    return files.from_records(spark, V, E, "small")


def ids(t):
    return sorted(x["gid"] for x in t.collect())


def test_mapping(spark):
    users = spark.createDataFrame([(1, "x@y"), (2, None), (None, "no")], "id int, email string")
    buys = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "id int, user_id int")
    items = spark.createDataFrame([(10, 7, 2), (10, 7, 2), (11, 8, 1), (11, None, 1)], "buy int, product int, n int")
    products = spark.createDataFrame([(7, "seven")], "id int, title string")
    m = GraphMapping(
        [VertexTable("users", "User", "id", columns=("email",)), VertexTable("buys", "Buy", "id", "B-", ()), VertexTable("products", "Product", "id", columns=("title",))],
        [ForeignKey("buys", "made", "user_id", "User", reverse=True), EdgeTable("items", "has", "Buy", "buy", "Product", "product", columns=("n",))],
    )
    g = m.apply({"users": users, "buys": buys, "items": items, "products": products})
    assert ids(g.query().V()) == ["B-10", "B-11", "B-12", "Product:7", "User:1", "User:2"]
    assert ids(g.query().V("User:1").out("made")) == ["B-10", "B-11"]
    assert ids(g.query().V("User:1").out("made").out("has")) == ["Product:7", "Product:7"]
    assert len({x["gid"] for x in g.query().E().hasLabel("has").collect()}) == 3
    assert g.query().E().hasLabel("made").collect()[0]["gid"].startswith("made:buys:1")
    plan = g.query().V().hasLabel("User").count().to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan and "Union" not in plan
    for bad in (GraphMapping([VertexTable("nope", "N", "id")]), GraphMapping([VertexTable("users", "User", "nope")]), GraphMapping([VertexTable("users", "User", "id")], [ForeignKey("users", "x", "email", "Nope")])):
        with pytest.raises(PlanError):
            bad.apply({"users": users})


def test_files(spark, tmp_path, g):
    v, e = tmp_path / "x.vertex.json.gz", tmp_path / "x.edge.json"
    with gzip.open(v, "wt") as f:
        f.write("\n".join([json.dumps(x) for x in V] + ["{bad", '{"gid": "", "label": "L"}', ""]))
    e.write_text("\n".join([json.dumps(x) for x in E] + [json.dumps({"label": "to", "from": "a", "to": "c"})]))
    got = files.read_directory(spark, str(tmp_path))
    assert ids(got.query().V()) == ["a", "b", "c"] and len(got.query().E().collect()) == 3
    assert files.bad_lines(spark, str(v), False).count() == 2
    assert got.getVertex("a")["data"] == V[0]["data"]
    files.write_jsonl(got, str(tmp_path / "v"), str(tmp_path / "e"))
    assert ids(files.read_jsonl(spark, str(tmp_path / "v"), str(tmp_path / "e")).query().V("a").out()) == ["b", "c"]
    files.write_parquet(got, str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).query().V().hasLabel("L").count().collect() == [2]
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"graph": "d", "vertices": V, "edges": E}))
    assert files.read_document(spark, str(doc)).name == "d"
    rdf = tmp_path / "t.rdf"
    rdf.write_text(
        '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://o.example/">'
        '<o:Thing r:about="http://o.example/1"><o:title>One</o:title><o:next r:resource="http://o.example/2"/></o:Thing>'
        '<r:Description r:about="http://o.example/2"><o:title>Two</o:title></r:Description></r:RDF>'
    )
    t = files.read_rdf(spark, str(rdf))
    assert t.query().V().hasLabel("Thing").out("next").collect() == [{"gid": "http://o.example/2", "label": "Resource", "data": {"title": "Two"}}]


def test_writes(g):
    h = writes.addVertex(g, "a", "Z", {"only": 1})
    assert h.getVertex("a") == {"gid": "a", "label": "Z", "data": {"only": 1}} and g.getVertex("a")["label"] == "L"
    h = writes.bulkAdd(g, [{"gid": "n", "label": "N", "data": {"v": 1}}, {"gid": "n", "label": "N", "data": {"v": 2}}, {"gid": "", "label": "N"}], [{"label": "to", "from": "n", "to": "a"}])
    assert h.getVertex("n")["data"] == {"v": 2} and len(h.query().V().collect()) == 4 and ids(h.query().V("n").out()) == ["a"]
    h = writes.deleteVertex(g, "b")
    assert ids(h.query().V()) == ["a", "c"] and h.query().E().collect() == []
    assert ids(writes.deleteEdge(g, "e1").query().E()) == ["e2"]
    assert ids(writes.addEdge(g, "c", "a", "back", {"k": 1}, "e9").query().V("c").out("back")) == ["a"]


def test_schema(g):
    got = {(r.label, r.field): r.type for r in vertex_schema(g).collect()}
    assert got == {("L", "n"): "NUMERIC", ("L", "in"): "OBJECT", ("L", "in.x"): "STRING", ("L", "xs"): "[NUMERIC]"}
    e = {(r["from"], r.label, r.to): (r.field, r.type) for r in edge_schema(g).collect()}
    assert e == {("L", "to", "L"): ("w", "NUMERIC"), ("L", "to", "M"): (None, None)}
    assert vertex_schema(g, 1).count() <= 4


def test_jobs(g, tmp_path):
    jobs = JobStore(str(tmp_path))
    t = g.query().V().hasLabel("L").as_("s").out("to")
    job = jobs.submit(t, wait=True)
    assert jobs.list("small") == [job] and jobs.get("small", job)["state"] == "COMPLETE" and jobs.get("small", job)["count"] == 2
    assert sorted(x["gid"] for x in jobs.view(g, job)) == ["b", "c"]
    longer = t.has(C.eq("_label", "M")).select("s")
    assert [s["id"] for s in jobs.search(longer)] == [job] and jobs.search(g.query().V().out()) == []
    assert [r["gid"] for r in jobs.run(longer).collect()] == ["b"] == [r["gid"] for r in jobs.resume(g, job, __.has(C.eq("_label", "M")).select("s")).collect()]
    again = JobStore(str(tmp_path))
    assert again.list("small") == [job]
    again.delete("small", job)
    assert again.list("small") == []
    with pytest.raises(NotFound):
        again.get("small", job)


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.addGraph("one")
    before = c.getTimestamp("one")
    c.bulkAdd("one", V, E)
    assert c.listGraphs() == ["one"] and c.getTimestamp("one") > before
    assert c.graph("one").query().V().count().collect() == [3]
    assert c.deleteVertex("one", "a").query().V().count().collect() == [2]
    c.addIndex("one", "L", "n")
    assert c.listIndices("one") == [{"label": "L", "field": "n"}]
    c.deleteIndex("one", "L", "n")
    assert c.listIndices("one") == []
    c.addSchema("one", {"L": {}})
    assert c.getSchema("one") == {"L": {}}
    for bad in ("a b", "_x", ""):
        with pytest.raises(PlanError):
            c.addGraph(bad)
    with pytest.raises(PlanError):
        c.addGraph("one")
    c.deleteGraph("one")
    with pytest.raises(NotFound):
        c.graph("one")


def test_stream(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    with pytest.raises(NotFound):
        store.graph()
    for k, (records, edges) in enumerate((([{"gid": "a", "label": "L", "data": {"n": 1}}, {"gid": "b", "label": "L"}, {"label": "L"}], False), (E[:1], True), ([{"gid": "a", "label": "L", "data": {"n": 2}}], False))):
        folder = tmp_path / ("e" if edges else "v")
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
        store.start(file_records(spark, str(folder), edges), edges, str(tmp_path / f"ck{edges}")).awaitTermination()
    g = store.graph()
    assert ids(g.query().V()) == ["a", "b"] and g.getVertex("a")["data"] == {"n": 2}
    assert ids(g.query().V("a").out("to")) == ["b"]


def test_typed_aggregate_by_name(spark):
    v = spark.createDataFrame([("a", "L", (1.0, "x")), ("b", "L", (None, "x"))], "gid string, label string, data struct<n: double, s: string>")
    e = spark.createDataFrame([], "gid string, label string, `from` string, `to` string, data struct<w: int>")
    from wayframe.graph import PropertyGraph

    g = PropertyGraph(v, e)
    assert [tuple(r) for r in g.query().V().aggregate(term("t", "s")).to_df().collect()] == [("t", "x", 2.0)]
    assert ids(g.query().V().hasKey("n")) == ["a"]
    with pytest.raises(PlanError):
        PropertyGraph(v.drop("label"), e)
