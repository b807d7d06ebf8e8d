"""Traversal semantics on a small schemaless graph with all the odd cases."""

import json
from collections import Counter

import pytest

from wayframe.errors import NotFound, PlanError
from wayframe.frontends.cypher import parse_cypher
from wayframe.frontends.graphql import parse_graphql
from wayframe.frontends.text import parse_chain
from wayframe.functions import conditions as C
from wayframe.functions.paths import parse
from wayframe.plans.compiler import liveness
from wayframe.plans.steps import Traversal, __, count, field, histogram, percentile, term, type_
from wayframe.sources.files import from_records

V = [
    ("p1", "Person", {"name": "Ann", "age": 30, "tags": ["x", "y"], "home": {"city": "Rome"}, "nick": None}),
    ("p2", "Person", {"name": "Bob", "age": 40.5, "tags": [], "home": {"city": "Oslo"}, "jobs": [{"at": "A"}, {"at": "B"}]}),
    ("p3", "Person", {"name": "Cy", "age": "50", "active": True}),
    ("p4", "Person", {"name": "Di", "tags": "none"}),
    ("c1", "City", {"name": "Rome", "size": 3}),
    ("c2", "City", {"name": "Oslo", "size": 1}),
    ("w1", "Work", {}),
    ("wf1", "Workflow", {"name": "w"}),
]
E = [
    ("e1", "knows", "p1", "p2", {"w": 1}),
    ("e2", "knows", "p2", "p3", {"w": 2}),
    ("e3", "knows", "p3", "p1", {}),
    ("e4", "knows", "p1", "p1", {"w": 9}),
    ("e5", "lives", "p1", "c1", {}),
    ("e6", "lives", "p2", "c2", {}),
    ("e7", "lives", "p1", "c1", {"again": True}),
    ("e8", "lives", "p4", "gone", {}),
]


@pytest.fixture(scope="module")
def g(spark):
    graph = from_records(spark, [{"gid": a, "label": b, "data": d} for a, b, d in V], [{"gid": a, "label": b, "from": f, "to": t, "data": d} for a, b, f, t, d in E])
    graph._parts = ({"": [graph.vertices.cache()]}, {"": [graph.edges.cache()]})
    return graph


def ids(t):
    return sorted(x["gid"] if x else None for x in t.collect()) if None not in (r := t.collect()) else Counter(x["gid"] if x else None for x in r)


def q(g):
    return g.query()


def test_starts(g):
    assert ids(q(g).V("p1", "p1", "zz", "c1")) == ["c1", "p1", "p1"]
    assert ids(q(g).E("e4")) == ["e4"] and len(q(g).E().collect()) == 8
    assert g.getVertex("c1")["data"] == {"name": "Rome", "size": 3} and g.getEdge("e1")["from"] == "p1"
    with pytest.raises(NotFound):
        g.getVertex("nobody")
    assert g.listLabels() == {"vertexLabels": ["City", "Person", "Work", "Workflow"], "edgeLabels": ["knows", "lives"]}


def test_hops_keep_multiplicity_and_drop_dangling(g):
    assert ids(q(g).V("p1").out()) == ["c1", "c1", "p1", "p2"]
    assert ids(q(g).V("p1").out("knows")) == ["p1", "p2"]
    assert ids(q(g).V("p1").in_()) == ["p1", "p3"]
    assert ids(q(g).V("p1").both("knows")) == ["p1", "p1", "p2", "p3"]
    assert ids(q(g).V("p4").out()) == [] and ids(q(g).V("p4").outE()) == ["e8"]
    assert ids(q(g).V("p1").bothE("knows")) == ["e1", "e3", "e4", "e4"]
    assert ids(q(g).E("e1").out("ignored")) == ["p2"] and ids(q(g).E("e1").in_()) == ["p1"] and ids(q(g).E("e1").both()) == ["p1", "p2"]
    with pytest.raises(PlanError):
        q(g).E().outE().collect()


def test_outer_hops(g):
    assert ids(q(g).V("p3", "p4").outNull("lives")) == Counter({None: 2})
    assert ids(q(g).V("p1", "c1").inNull("knows")) == Counter({"p1": 1, "p3": 1, None: 1})
    assert ids(q(g).V("p3", "p4").outENull("lives")) == Counter({"e8": 1, None: 1})
    assert ids(q(g).V("p3").inENull("lives")) == Counter({None: 1})
    # a null element goes nowhere, matches nothing, and shows empty attributes
    nothing = q(g).V("p3").as_("a").outNull("lives")
    assert nothing.out().collect() == [] and nothing.hasLabel("City").collect() == [] and nothing.outNull().collect() == [None]
    assert nothing.as_("b").render(["$a._gid", "$b._gid"]).collect() == [["p3", ""]]


@pytest.mark.parametrize(
    "cond,want",
    [
        (C.eq("age", 30), "p1"),
        (C.eq("age", "50"), "p3"),
        (C.eq("age", 50), ""),
        (C.eq("active", True), "p3"),
        (C.eq("active", 1), ""),
        (C.eq("nick", None), "c1 c2 p1 p2 p3 p4 w1 wf1"),
        (C.eq("tags", ["x", "y"]), "p1"),
        (C.eq("home", {"city": "Rome"}), "p1"),
        (C.neq("age", 30), "c1 c2 p2 p3 p4 w1 wf1"),
        (C.gt("age", 30), "p2 p3"),
        (C.gte("age", 30), "p1 p2 p3"),
        (C.lt("age", 41), "p1 p2"),
        (C.lte("age", 30), "p1"),
        (C.lt("name", 5), ""),
        (C.inside("age", 30, 50), "p2"),
        (C.outside("age", 35, 45), "p1 p3"),
        (C.between("age", 30, 50), "p1 p2"),
        ({"condition": {"key": "age", "value": [1], "condition": "BETWEEN"}}, ""),
        (C.within("name", ["Ann", "Rome"]), "c1 p1"),
        (C.within("age", ["30", 40.5]), "p2"),
        (C.within("name", "Bob"), "p2"),
        (C.without("name", ["Ann", "Bob", "Cy", "Di", "w"]), "c1 c2 w1"),
        ({"condition": {"key": "name", "value": None, "condition": "WITHOUT"}}, "c1 c2 p1 p2 p3 p4 w1 wf1"),
        (C.contains("tags", "x"), "p1"),
        (C.contains("name", "Ann"), ""),
        (C.not_(C.contains("tags", "x")), "c1 c2 p2 p3 p4 w1 wf1"),
        (C.not_(C.not_(C.gt("age", 30))), "p2 p3"),
        (C.and_(C.eq("_label", "Person"), C.or_(C.eq("_gid", "p4"), C.eq("home.city", "Oslo"))), "p2 p4"),
        (C.eq("jobs[1].at", "B"), "p2"),
        (C.contains("jobs.at", "B"), "p2"),
        (C.contains("jobs[:].at", "A"), "p2"),
    ],
)
def test_conditions(g, cond, want):
    assert ids(q(g).V().has(cond)) == want.split()


def test_filters(g):
    assert ids(q(g).V().hasLabel("Work")) == ["w1"] and ids(q(g).V().hasId("p1", "p1")) == ["p1"]
    assert ids(q(g).V().hasKey("nick")) == ["p1"] and ids(q(g).V().hasKey("name", "size")) == ["c1", "c2"]
    assert len(q(g).V("p1").as_("a").out("lives").hasKey("$a.age").collect()) == 2
    for bad in (q(g).V().hasLabel(), q(g).V().hasId(), q(g).out(), q(g).V().V(), q(g), q(g).V().as_("a b"), q(g).V().count().out(), q(g).V().select("nope"), q(g).V().aggregate(count("a"), count("a"))):
        with pytest.raises(PlanError):
            bad.collect()


def test_shapes(g):
    p1 = q(g).V("p1")
    assert p1.fields("name", "home.city", "zz").collect()[0]["data"] == {"name": "Ann", "home": {"city": "Rome"}}
    assert sorted(p1.fields("-name", "-tags").collect()[0]["data"]) == ["age", "home", "nick"]
    assert p1.fields().collect()[0]["data"] == {} and p1.fields("-_gid", "name").collect()[0]["data"] == {"name": "Ann"}
    assert p1.render({"a": "name", "b": ["_label", "home.city", 5], "c": "nope", "d": "tags[1]"}).collect() == [{"a": "Ann", "b": ["Person", "Rome", None], "c": None, "d": "y"}]
    assert p1.as_("m").out("knows").render("$m").collect()[0]["data"]["age"] == 30
    assert sorted(map(str, q(g).V().hasLabel("Person").unwind("tags").render("tags").collect())) == ["None", "None", "None", "x", "y"]
    assert p1.out("lives").path().collect() == [[{"vertex": "p1"}, {"vertex": "c1"}]] * 2
    assert p1.outE("lives").out().path().collect()[0][1:] in ([{"edge": "e5"}, {"vertex": "c1"}], [{"edge": "e7"}, {"vertex": "c1"}])
    assert p1.fields("name").out("lives").path().collect() == [[{}, {"vertex": "c1"}]] * 2
    assert p1.as_("a").out("lives").select("a").path().collect() == [[{"vertex": "p1"}, {"vertex": "c1"}, {"vertex": "p1"}]] * 2
    two = p1.as_("a").out("lives").as_("b").select("a", "b", "nope").collect()
    assert len(two) == 2 and two[0]["b"]["data"]["size"] == 3 and set(two[0]) == {"a", "b"}
    assert p1.custom(lambda df: df.limit(0)).collect() == []


def test_set_and_increment(g):
    p1 = q(g).V("p1")
    assert p1.as_("a").set("n", 3).render(["$a.n", "n"]).collect() == [[3, 3]]
    assert p1.as_("a").increment("age", 2).render(["$a.age", "age"]).collect() == [[30, 32]]
    assert p1.set("n", 0).as_("a").out("knows").increment("$a.n").render(["$a.n", "n"]).collect() == [[1, None]] * 2
    assert p1.set("name", "Zed").collect()[0]["data"] == {**V[0][2], "name": "Zed"}
    assert p1.set("_gid", "no").collect()[0]["gid"] == "p1"
    assert q(g).V("p3").increment("age").render("age").collect() == [51]


def test_distinct_and_slices(g):
    assert ids(q(g).V("p1").out().distinct()) == ["c1", "p1", "p2"]
    assert len(q(g).V().distinct("nick").collect()) == 1 and ids(q(g).V().distinct("age")) == ["p1", "p2", "p3"]
    assert len(q(g).V("p1").as_("a").out().distinct("$a._gid").collect()) == 1 and q(g).V().distinct("nope").collect() == []
    s = lambda t: [x["gid"] for x in t.collect(stable=True)]
    assert s(q(g).V().limit(2)) == ["c1", "c2"] and s(q(g).V().skip(6)) == ["w1", "wf1"]
    assert s(q(g).V().range(1, 3)) == ["c2", "p1"] and s(q(g).V().range(6, -1)) == ["w1", "wf1"]


def agg(t):
    return sorted((r["name"], r["key"], r["value"]) for r in t.collect())


def test_aggregations(g):
    v = q(g).V()
    assert agg(v.aggregate(term("t", "home.city"))) == [("t", "Oslo", 1.0), ("t", "Rome", 1.0)]
    assert agg(v.aggregate(term("t", "tags"))) == [("t", "none", 1.0)] and agg(v.aggregate(term("t", "_label", 1))) == [("t", "Person", 4.0)]
    assert agg(v.aggregate(histogram("h", "age", 10))) == [("h", "30.0", 1.0), ("h", "40.0", 1.0), ("h", "50.0", 1.0)]
    assert agg(v.hasId("p1", "p3").aggregate(histogram("h", "age", 10))) == [("h", "30.0", 1.0), ("h", "40.0", 0.0), ("h", "50.0", 1.0)]
    assert agg(v.hasLabel("Work").aggregate(histogram("h", "age", 10), percentile("p", "age"), term("t", "age"))) == []
    assert agg(v.aggregate(percentile("p", "age", [50]))) == [("p", "50", 40.5)]
    assert agg(v.aggregate(type_("k", "age"))) == [("k", "NUMERIC", 2.0), ("k", "STRING", 1.0), ("k", "UNKNOWN", 5.0)]
    assert agg(v.hasId("p1").aggregate(field("f", "_data"), field("h", "home"), count("n"))) == [("f", k, 1.0) for k in ("age", "home", "name", "nick", "tags")] + [("h", "city", 1.0), ("n", "count", 1.0)]
    assert v.hasLabel("nobody").count().collect() == [0]


def walks(start, rounds):
    """Plain Python: the ends of all walks of 1 to n knows-edges."""
    out, now = [], [start]
    for _ in range(rounds):
        now = [t for x in now for _, lab, f, t, _ in E if f == x and lab == "knows"]
        out += now
    return sorted(out)


def test_loops(g):
    loop = q(g).V("p1").set("n", 0).as_("s").mark("a").out("knows").increment("$s.n").jump("a", C.lt("$s.n", 4), True)
    assert ids(loop) == walks("p1", 4)
    assert loop.count().collect() == [len(walks("p1", 4))]
    assert ids(q(g).V("p1").jump("end", C.eq("_gid", "p1"), True).out("knows").mark("end")) == ["p1", "p1", "p2"]
    assert q(g).V("p1").jump("end", None, False).out().mark("end").collect()[0]["gid"] == "p1"
    assert len(q(g).V("p1").mark("a").out("knows").jump("a", None, True).limit(25).collect()) == 25
    assert q(g).V("p1").mark("a").out("lives").jump("a", None, False).collect() == []


def test_other_notations(g):
    t = q(g).V().hasLabel("Person").has(C.gt("age", 35)).out("knows").as_("x").limit(5)
    again = Traversal.from_json(json.loads(t.to_json()), g)
    assert again.steps == t.steps
    assert g.run(__.V("p1").out("lives").count()).collect() == [2]
    assert Traversal.from_json([{"v": []}, {"in_e_null": []}]).steps[1][0] == "inENull"
    assert ids(parse_chain("g.V('p1').out('knows').has(not_(eq('name', 'Ann')))", g)) == ["p2"]
    for bad in ("V().nope()", "__import__('os')", "V(open('x'))", "V(", "1 + 1", "V().custom(1)"):
        with pytest.raises(PlanError):
            parse_chain(bad, g)
    assert parse_cypher("MATCH (a:Person {name: 'Ann'})-[:knows]->(b) WHERE b.name <> 'Ann' RETURN a.name, b.name AS other LIMIT 3", g).collect() == [{"a.name": "Ann", "other": "Bob"}]
    assert parse_cypher("MATCH (a:City {name: 'Oslo'})<-[r:lives]-(b) RETURN b", g).collect()[0]["name"] == "Bob"
    rows = parse_graphql('{ Person(name: "Ann", first: 5) { id name lives { name } knows(id: "p2") { age } } }', g).collect()
    assert rows == [{"id": "p1", "name": "Ann", "lives": {"name": "Rome"}, "knows": {"age": 40.5}}] * 2
    assert agg(parse_graphql("{ Person_aggregation { _totalCount name } }", g))[0] == ("_totalCount", "count", 4.0)


def test_liveness_and_paths():
    steps = __.V().hasLabel("A").as_("a").out("x").has(C.gt("n", 1)).out("y").count().steps
    needs = liveness(steps, None)
    assert needs[0] == frozenset() and needs[3] == {"n"} and needs[5] == frozenset()
    assert liveness(__.V().as_("a").out().render(["$a.p.q", "r"]).steps, None)[0] == {"p"}
    assert parse("$m._data.a[1].b[:]").parts == ("a", 1, "b", ":") and parse("_from").root == "from"
    with pytest.raises(PlanError):
        parse("")


def _files(df):
    return {f.rsplit("/", 1)[-1].removesuffix(".parquet") for f in df.inputFiles()}


def test_hops_plan_only_tables_that_they_can_reach(spark):
    from wayframe.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    assert not _files(Q.QUERIES["hop_both"](spark, sf)) & {"lineitem", "orders", "events", "documents", "labels", "part"}
    assert _files(Q.QUERIES["edge_out"](spark, sf)) <= {"lineitem", "part", "orders"}
    g = Q.load(spark, sf)
    assert g.query().V().hasLabel("Region").out("placed").count().to_df().first()["count"] == 0
    assert g.query().V().hasLabel("Nation").both().hasLabel("Part").count().to_df().first()["count"] == 0


def test_loop_rounds_are_a_parameter(spark):
    from wayframe.errors import PlanError
    from wayframe.plans import queries as Q

    g = Q.load(spark, "/root/testdata/sf0.001")
    q = lambda: g.query().V("Customer:1").mark("a").out("customer_of", "in_region").jump("a", None, True).count().to_df().first()["count"]
    g.loop_rounds = 1
    with pytest.raises(PlanError):
        q()
    g.loop_rounds = None
    assert q() == 2
