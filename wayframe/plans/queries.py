"""The registered graph queries, and SQL with the same results.

The tables are mapped to one graph: regions, nations, customers, suppliers,
parts, orders, documents, their labels, users and events are vertices, keys
and line items are edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, writes
from ..catalog import index_range, index_terms
from ..frontends.cypher import parse_cypher
from ..frontends.graphql import parse_graphql
from ..frontends.text import parse_chain
from ..functions import conditions as C
from ..graph import PropertyGraph
from ..sources.mapping import EdgeTable, ForeignKey, GraphMapping, VertexTable
from .steps import Traversal, count, field, histogram, percentile, term, type_

MAPPING = GraphMapping(
    [
        VertexTable("region", "Region", "r_regionkey"),
        VertexTable("nation", "Nation", "n_nationkey"),
        VertexTable("customer", "Customer", "c_custkey"),
        VertexTable("supplier", "Supplier", "s_suppkey"),
        VertexTable("part", "Part", "p_partkey"),
        VertexTable("orders", "Order", "o_orderkey"),
        VertexTable("documents", "Document", "doc_id", columns=("lang", "source", "n_chars")),
        VertexTable("labels", "Label", "doc_id", columns=("quality", "toxic")),
        VertexTable("users", "User", "user_id", columns=()),
        VertexTable("events", "Event", "event_id", columns=("ts", "event_type", "value")),
    ],
    [
        ForeignKey("nation", "in_region", "n_regionkey", "Region"),
        ForeignKey("customer", "customer_of", "c_nationkey", "Nation"),
        ForeignKey("supplier", "supplier_of", "s_nationkey", "Nation"),
        ForeignKey("orders", "placed", "o_custkey", "Customer", reverse=True),
        ForeignKey("events", "did", "user_id", "User", reverse=True),
        ForeignKey("labels", "rated", "doc_id", "Document", reverse=True),
        EdgeTable("lineitem", "contains", "Order", "l_orderkey", "Part", "l_partkey", columns=("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")),
        EdgeTable("lineitem", "supplied_by", "Order", "l_orderkey", "Supplier", "l_suppkey"),
    ],
    integrity=True,
)
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "events")


def load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    tables["users"] = tables["events"].select("user_id").distinct()
    tables["part"] = tables["part"].withColumn("p_words", F.split("p_type", " "))
    return MAPPING.apply(tables, "shop")


def load_props(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Events with their JSON properties as schemaless payload."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = e.select(F.concat(F.lit("Event:"), F.col("event_id").cast("string")).alias("gid"), F.col("event_type").alias("label"), F.parse_json("props").alias("data"))
    return PropertyGraph(v, v.where("false").select("gid", "label", F.col("gid").alias("from"), F.col("gid").alias("to"), "data"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None, source: Callable = load) -> Callable:
    def add(fn: Callable[[PropertyGraph], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _walk(name: str, sql: str, build: Callable[[Traversal], Traversal], source: Callable = load, stable: bool = False, /, **columns: str) -> None:
    """A traversal whose elements are shown as flat columns."""
    _register(name, sql, source)(lambda g: build(g.query()).table(stable, **columns))


def _count(name: str, sql: str, build: Callable[[Traversal], Traversal], source: Callable = load) -> None:
    _register(name, sql, source)(lambda g: build(g.query()).count().to_df())


def _agg(name: str, sql: str, build: Callable[[Traversal], Traversal], source: Callable = load) -> None:
    _register(name, sql, source)(lambda g: build(g.query()).to_df())


_N = lambda sql: f"SELECT count(*) AS count FROM ({sql})"

# start steps
_count("scan_vertices", "SELECT sum(n)::BIGINT AS count FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in _TABLES if t != "lineitem") + " UNION ALL SELECT count(DISTINCT user_id) FROM events)", lambda q: q.V())
_count("scan_edges", "SELECT sum(n)::BIGINT AS count FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in ("nation", "customer", "supplier", "orders", "events", "labels", "lineitem", "lineitem")) + ")", lambda q: q.E())
_walk("scan_edge_rows", "SELECT 'Order:' || l_orderkey AS source, 'Part:' || l_partkey AS target, l_quantity AS qty FROM lineitem", lambda q: q.E().hasLabel("contains"), source="_from", target="_to", qty="l_quantity")
_walk("lookup_ids", "SELECT 'Customer:' || c_custkey AS gid, c_name AS name FROM customer, (VALUES (1), (1), (3), (999999999)) k(i) WHERE c_custkey = i", lambda q: q.V("Customer:1", "Customer:1", "Customer:3", "Customer:999999999"), gid="_gid", name="c_name")
_walk("lookup_labels", "SELECT 'Supplier:' || s_suppkey AS gid, s_acctbal AS balance FROM supplier", lambda q: q.V().hasLabel("Supplier"), gid="_gid", balance="s_acctbal")

# hops
_walk("hop_out", "SELECT 'Order:' || o_orderkey AS gid, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", lambda q: q.V().hasLabel("Customer").has(C.eq("c_mktsegment", "BUILDING")).out("placed"), gid="_gid", price="o_totalprice")
_walk("hop_in", "SELECT 'Order:' || l_orderkey AS gid FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40", lambda q: q.V().hasLabel("Part").has(C.gt("p_size", 40)).in_("contains"), gid="_gid")
_walk("hop_both", "SELECT 'Region:' || n_regionkey AS gid, 'Region' AS label FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier' FROM supplier", lambda q: q.V().hasLabel("Nation").both(), gid="_gid", label="_label")
_walk("hop_out_edges", "SELECT 'Order:' || l_orderkey AS source, 'Part:' || l_partkey AS target, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'", lambda q: q.V().hasLabel("Order").has(C.eq("o_orderstatus", "F")).outE("contains"), source="_from", target="_to", qty="l_quantity")
_walk("hop_in_edges", "SELECT 'Order:' || l_orderkey AS source FROM supplier JOIN lineitem ON l_suppkey = s_suppkey", lambda q: q.V().hasLabel("Supplier").inE("supplied_by"), source="_from")
_walk("hop_both_edges", "SELECT 'in_region' AS label, 'Nation:' || n_nationkey AS source FROM nation UNION ALL SELECT 'customer_of', 'Customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier_of', 'Supplier:' || s_suppkey FROM supplier", lambda q: q.V().hasLabel("Nation").bothE(), label="_label", source="_from")
_walk("edge_out", "SELECT 'Part:' || p_partkey AS gid, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45", lambda q: q.E().hasLabel("contains").has(C.gt("l_quantity", 45)).out(), gid="_gid", brand="p_brand")
_walk("edge_in", "SELECT 'Order:' || o_orderkey AS gid, o_orderpriority AS priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45", lambda q: q.E().hasLabel("contains").has(C.gt("l_quantity", 45)).in_(), gid="_gid", priority="o_orderpriority")
_walk("edge_both", "SELECT 'Nation:' || n_nationkey AS gid FROM nation UNION ALL SELECT 'Region:' || n_regionkey FROM nation", lambda q: q.E().hasLabel("in_region").both(), gid="_gid")
_walk("hop_out_null", "SELECT 'Document:' || d.doc_id AS doc, coalesce('Label:' || l.doc_id, '') AS gid, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda q: q.V().hasLabel("Document").as_("a").outNull("rated").as_("b"), doc="$a._gid", gid="$b._gid", quality="$b.quality")
_walk("hop_in_null", "SELECT 'Nation:' || n_nationkey AS place, coalesce('Supplier:' || s_suppkey, '') AS gid FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 'Region:' || r_regionkey, '' FROM region", lambda q: q.V().hasLabel("Nation", "Region").as_("a").inNull("supplier_of").as_("b"), place="$a._gid", gid="$b._gid")
_walk("has_null_element", "SELECT 'Document:' || doc_id AS doc, 'Label:' || doc_id AS gid FROM labels WHERE quality <> 1", lambda q: q.V().hasLabel("Document").as_("a").outNull("rated").has(C.neq("quality", 1)), doc="$a._gid", gid="_gid")
_walk("has_null_element_on_mark", "SELECT 'Document:' || d.doc_id AS doc, coalesce('Label:' || l.doc_id, '') AS gid FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en'", lambda q: q.V().hasLabel("Document").as_("a").outNull("rated").has(C.eq("$a.lang", "en")), doc="$a._gid", gid="_gid")
_walk("hop_out_edge_null", "SELECT 'Document:' || d.doc_id AS doc, coalesce('Label:' || l.doc_id, '') AS target FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda q: q.V().hasLabel("Document").as_("a").outENull("rated"), doc="$a._gid", target="_to")
_walk("hop_in_edge_null", "SELECT 'Label:' || doc_id AS label_id, 'Document:' || doc_id AS source FROM labels UNION ALL SELECT 'Region:' || r_regionkey, '' FROM region", lambda q: q.V().hasLabel("Label", "Region").as_("a").inENull("rated"), label_id="$a._gid", source="_from")

# filters
_PRICE = "SELECT 'Order:' || o_orderkey AS gid FROM orders WHERE "
for _name, _cond, _where in (
    ("has_eq", C.eq("o_orderstatus", "O"), "o_orderstatus = 'O'"),
    ("has_eq_number", C.eq("o_custkey", 7), "o_custkey = 7"),
    ("has_eq_other_type", C.eq("o_custkey", "7"), "false"),
    ("has_neq", C.neq("o_orderstatus", "O"), "o_orderstatus <> 'O'"),
    ("has_gt", C.gt("o_totalprice", 200000), "o_totalprice > 200000"),
    ("has_gte", C.gte("o_custkey", 100), "o_custkey >= 100"),
    ("has_lt", C.lt("o_totalprice", 50000), "o_totalprice < 50000"),
    ("has_lte", C.lte("o_custkey", 10), "o_custkey <= 10"),
    ("has_inside", C.inside("o_custkey", 10, 20), "o_custkey > 10 AND o_custkey < 20"),
    ("has_outside", C.outside("o_custkey", 10, 140), "o_custkey < 10 OR o_custkey > 140"),
    ("has_between", C.between("o_custkey", 10, 20), "o_custkey >= 10 AND o_custkey < 20"),
    ("has_within", C.within("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("has_without", C.without("o_orderpriority", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("has_and_or_not", C.and_(C.or_(C.eq("o_orderstatus", "F"), C.gt("o_totalprice", 100000)), C.not_(C.lt("o_custkey", 50))), "(o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_custkey < 50"),
    ("has_not_missing", C.not_(C.gt("p_size", 3)), "true"),
):
    _walk(_name, _PRICE + _where, lambda q, c=_cond: q.V().hasLabel("Order").has(c), gid="_gid")
_walk("has_neq_missing", "SELECT 'Region:' || r_regionkey AS gid FROM region", lambda q: q.V().hasLabel("Region").has(C.neq("p_size", 1)), gid="_gid")
_walk("has_contains", "SELECT 'Part:' || p_partkey AS gid FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO')", lambda q: q.V().hasLabel("Part").has(C.contains("p_words", "PROMO")), gid="_gid")
_walk("has_id", "SELECT 'Part:' || p_partkey AS gid FROM part WHERE p_partkey IN (2, 4, 6)", lambda q: q.V().hasId("Part:2", "Part:4", "Part:4", "Part:6"), gid="_gid")
_walk("has_key", "SELECT 'Supplier:' || s_suppkey AS gid FROM supplier", lambda q: q.V().hasKey("s_name", "s_acctbal"), gid="_gid")
_walk("has_on_mark", "SELECT 'Order:' || o_orderkey AS gid, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0", lambda q: q.V().hasLabel("Customer").as_("c").out("placed").has(C.lt("$c.c_acctbal", 0)), gid="_gid", name="$c.c_name")

# shape
_walk("mark_select", "SELECT 'Customer:' || o_custkey AS gid, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey", lambda q: q.V().hasLabel("Customer").as_("c").out("placed").select("c"), gid="_gid", name="c_name")
_register("select_marks", "SELECT 'Nation:' || n_nationkey AS a, 'Region:' || r_regionkey AS b, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")(
    lambda g: g.query().V().hasLabel("Nation").as_("a").out("in_region").as_("b").select("a", "b").to_df().select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"), F.col("b.data.r_name").alias("r_name"))
)
_register("render", "SELECT 'Supplier:' || s_suppkey AS gid, s_name AS name, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")(
    lambda g: g.query().V().hasLabel("Supplier").as_("s").out("supplier_of").render({"gid": "$s._gid", "who": {"name": "$s.s_name"}, "at": ["n_name"]}).to_df().select("render.gid", "render.who.name", F.col("render.at._0").alias("nation"))
)
_register("fields_include", "SELECT 'Part:' || p_partkey AS gid, p_brand, p_size FROM part")(lambda g: g.query().V().hasLabel("Part").fields("p_brand", "p_size", "nothing").to_df().select("gid", "data.*"))
_register("fields_exclude", "SELECT 'Region:' || r_regionkey AS gid, r_regionkey FROM region")(lambda g: g.query().V().hasLabel("Region").fields("-r_name").to_df().select("gid", "data.r_regionkey"))
_register("path", "SELECT 'Nation:' || n_nationkey || '>' || 'Region:' || n_regionkey || '>Nation:' || m AS path FROM nation a JOIN (SELECT n_nationkey AS m, n_regionkey AS r FROM nation) b ON a.n_regionkey = b.r")(
    lambda g: g.query().V().hasLabel("Nation").out("in_region").in_("in_region").path().to_df().select(F.array_join(F.transform("path", lambda p: p["vertex"]), ">").alias("path"))
)
_walk("unwind", "SELECT 'Part:' || p_partkey AS gid, unnest(string_split(p_type, ' ')) AS word FROM part", lambda q: q.V().hasLabel("Part").unwind("p_words"), gid="_gid", word="p_words")
_walk("set_increment", "SELECT 'Nation:' || n_nationkey AS gid, CAST(7 AS BIGINT) AS level, CAST(n_regionkey + 2 AS INTEGER) AS key FROM nation", lambda q: q.V().hasLabel("Nation").set("level", 4).increment("level", 3).increment("n_regionkey", 2), gid="_gid", level="level", key="n_regionkey")

# how many
_walk("distinct", "SELECT DISTINCT p_brand AS brand FROM part", lambda q: q.V().hasLabel("Part").distinct("p_brand"), brand="p_brand")
_walk("distinct_pairs", "SELECT DISTINCT 'Customer:' || o_custkey AS customer, o_orderpriority AS priority FROM orders", lambda q: q.V().hasLabel("Customer").as_("c").out("placed").distinct("$c._gid", "o_orderpriority"), customer="$c._gid", priority="o_orderpriority")
_walk("distinct_missing", "SELECT 'Part:' || p_partkey AS gid FROM part", lambda q: q.V().hasLabel("Part", "Region").distinct("p_partkey"), gid="_gid")
_ORDERED = "SELECT 'Customer:' || c_custkey AS gid FROM customer ORDER BY 1 "
_walk("limit", _ORDERED + "LIMIT 7", lambda q: q.V().hasLabel("Customer").limit(7), load, True, gid="_gid")
_walk("skip", _ORDERED + "OFFSET 7", lambda q: q.V().hasLabel("Customer").skip(7), load, True, gid="_gid")
_walk("range", _ORDERED + "LIMIT 6 OFFSET 3", lambda q: q.V().hasLabel("Customer").range(3, 9), load, True, gid="_gid")
_walk("range_open", _ORDERED + "OFFSET 3", lambda q: q.V().hasLabel("Customer").range(3, -1), load, True, gid="_gid")
_count("count_empty", "SELECT CAST(0 AS BIGINT) AS count", lambda q: q.V().hasLabel("Nobody"))
_count("count_hops", _N("SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey"), lambda q: q.V().hasLabel("Customer").out("placed"))
_count("three_hops", _N("SELECT 1 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'"), lambda q: q.V().hasLabel("Region").has(C.eq("r_name", "ASIA")).in_("in_region").in_("customer_of").out("placed"))

# aggregations
_agg("agg_term", "SELECT 'status' AS name, o_orderstatus AS key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL", lambda q: q.V().hasLabel("Order").aggregate(term("status", "o_orderstatus")))
_agg("agg_term_size", "SELECT 'brand' AS name, p_brand AS key, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY ALL ORDER BY value DESC, key LIMIT 5", lambda q: q.V().hasLabel("Part").aggregate(term("brand", "p_brand", 5)))
_agg(
    "agg_histogram",
    "WITH b AS (SELECT floor(l_quantity / 8) * 8 AS k FROM lineitem WHERE l_quantity > 30 OR l_quantity < 10), r AS (SELECT unnest(range(0, ((SELECT max(k) - min(k) FROM b) / 8)::BIGINT + 1)) * 8.0 + (SELECT min(k) FROM b) AS k) SELECT 'qty' AS name, CAST(CAST(r.k AS DOUBLE) AS VARCHAR) AS key, CAST(count(b.k) AS DOUBLE) AS value FROM r LEFT JOIN b ON b.k = r.k GROUP BY ALL",
    lambda q: q.E().hasLabel("contains").has(C.outside("l_quantity", 10, 30)).aggregate(histogram("qty", "l_quantity", 8)),
)
_agg("agg_percentile", "SELECT 'price' AS name, CAST(p AS VARCHAR) AS key, q AS value FROM (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS p, unnest(quantile_cont(o_totalprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS q FROM orders)", lambda q: q.V().hasLabel("Order").aggregate(percentile("price", "o_totalprice")))
_agg("agg_type", "SELECT 'kind' AS name, k AS key, CAST(sum(n) AS DOUBLE) AS value FROM (SELECT 'NUMERIC' AS k, count(*) AS n FROM part UNION ALL SELECT 'UNKNOWN', count(*) FROM region) GROUP BY ALL", lambda q: q.V().hasLabel("Part", "Region").aggregate(type_("kind", "p_size")))
_agg("agg_count", "SELECT 'n' AS name, 'count' AS key, CAST(count(*) AS DOUBLE) AS value FROM orders", lambda q: q.V().hasLabel("Order").aggregate(count("n")))
_agg("agg_field", "SELECT 'f' AS name, k AS key, CAST((SELECT count(*) FROM region) AS DOUBLE) AS value FROM (VALUES ('r_regionkey'), ('r_name')) v(k)", lambda q: q.V().hasLabel("Region").aggregate(field("f", "_data")))
_agg(
    "agg_many",
    "SELECT 'flag' AS name, l_returnflag AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL UNION ALL SELECT 'n', 'count', count(*) FROM lineitem UNION ALL SELECT 'half', '50', quantile_cont(l_extendedprice, 0.5) FROM lineitem",
    lambda q: q.E().hasLabel("contains").aggregate(term("flag", "l_returnflag"), count("n"), percentile("half", "l_extendedprice", [50])),
)
_agg("two_hop_terms", "SELECT 'brand' AS name, p_brand AS key, CAST(count(*) AS DOUBLE) AS value FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' GROUP BY ALL", lambda q: q.V().hasLabel("Customer").has(C.eq("c_mktsegment", "MACHINERY")).out("placed").out("contains").aggregate(term("brand", "p_brand")))

# loops
_LEVELS = "SELECT 'Nation:' || n_nationkey AS gid FROM nation UNION ALL SELECT 'Customer:' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'Supplier:' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"
_walk("loop", _LEVELS, lambda q: q.V().hasLabel("Region").mark("a").in_("in_region", "customer_of", "supplier_of").jump("a", None, True), gid="_gid")
_walk("loop_counter", "SELECT 'Nation:' || n_nationkey AS gid, CAST(1 AS BIGINT) AS depth FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT 'Supplier:' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey", lambda q: q.V().hasLabel("Region").set("depth", 0).as_("s").mark("a").in_("in_region", "customer_of", "supplier_of").increment("$s.depth").jump("a", C.lt("$s.depth", 2), True), gid="_gid", depth="$s.depth")
_walk("loop_forward", "SELECT 'Nation:' || n_nationkey AS gid FROM nation UNION ALL SELECT 'Region:' || n_regionkey FROM nation", lambda q: q.V().hasLabel("Nation").jump("skip", None, True).out("in_region").mark("skip"), gid="_gid")
_count("loop_limit", "SELECT CAST(40 AS BIGINT) AS count", lambda q: q.V().hasLabel("Nation").mark("a").out("in_region").in_("in_region").jump("a", None, True).limit(40))

# schemaless payloads
_walk("variant_compare", "SELECT 'Event:' || event_id AS gid FROM events WHERE CAST(props->>'$.k' AS DOUBLE) >= 50", lambda q: q.V().has(C.gte("k", 50)), load_props, gid="_gid")
_walk("variant_strict", "SELECT 'Event:' || event_id AS gid FROM events WHERE CAST(props->>'$.k' AS DOUBLE) IN (1, 2)", lambda q: q.V().has(C.and_(C.within("k", [1, 2, "3"]), C.not_(C.eq("k", "1")))), load_props, gid="_gid")
_agg("variant_term", "SELECT 'k' AS name, props->>'$.k' AS key, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL UNION ALL SELECT 't', 'NUMERIC', count(*) FROM events UNION ALL SELECT 'f', 'k', count(*) FROM events", lambda q: q.V().aggregate(term("k", "k"), type_("t", "k"), field("f", "_data")), load_props)
_count("variant_distinct", "SELECT count(DISTINCT props->>'$.k') AS count FROM events", lambda q: q.V().distinct("k"), load_props)

# writes
_CUSTOMERS = "SELECT 'Customer:' || c_custkey AS gid, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_name END AS name FROM customer"


@_register("upsert", _CUSTOMERS + " UNION ALL SELECT 'Customer:new', 'added'")
def _upsert(g: PropertyGraph) -> DataFrame:
    c = g.query().V().hasLabel("Customer").has(C.lt("c_acctbal", 0)).table(gid="_gid")
    new = c.select("gid", F.lit('{"c_name": "old"}').alias("data"), F.lit(1).alias("seq")).unionByName(c.select("gid", F.lit('{"c_name": "changed"}').alias("data"), F.lit(2).alias("seq")))
    new = new.unionByName(g.spark.range(1).select(F.lit("Customer:new").alias("gid"), F.lit('{"c_name": "added"}').alias("data"), F.lit(1).alias("seq")))
    out = writes.upsert(g, new.withColumn("label", F.lit("Customer")), order="seq")
    return out.query().V().hasLabel("Customer").table(gid="_gid", name="c_name")


@_register("delete_vertex", "SELECT 'Customer:' || o_custkey AS source FROM orders WHERE o_custkey NOT IN (1, 2)")
def _delete(g: PropertyGraph) -> DataFrame:
    return writes.deleteVertex(g, "Customer:1", "Customer:2").query().E().hasLabel("placed").table(source="_from")


@_register("delete_edge", "SELECT 'Order:' || o_orderkey AS target FROM orders WHERE NOT (o_orderkey IN (SELECT min(o_orderkey) FROM orders))")
def _delete_edge(g: PropertyGraph) -> DataFrame:
    first = g.query().V().hasLabel("Order").table(key="o_orderkey").agg(F.min("key").alias("m")).first()["m"]
    gid = g.query().V(f"Order:{first}").inE("placed").collect()[0]["gid"]
    return writes.deleteEdge(g, gid).query().E().hasLabel("placed").table(target="_to")


@_register("upsert_edge", "SELECT 'Customer:' || o_custkey AS source, 'Order:' || o_orderkey AS target FROM orders UNION ALL SELECT 'Customer:1', 'Region:1'")
def _upsert_edge(g: PropertyGraph) -> DataFrame:
    """A new edge, written twice, and all that were there before written again."""
    old = g.query().E().hasLabel("placed").table(gid="_gid", label="_label", **{"from": "_from", "to": "_to"})
    new = g.spark.createDataFrame([("e:1", "placed", "Customer:1", "Region:0", 1), ("e:1", "placed", "Customer:1", "Region:1", 2)], "gid string, label string, `from` string, `to` string, seq int")
    rows = new.unionByName(old.withColumn("seq", F.lit(1))).withColumn("data", F.lit("{}"))
    return writes.upsert(g, None, rows, order="seq").query().E().hasLabel("placed").table(source="_from", target="_to")


# one element by its id
@_register("get_vertex", "SELECT 'Nation:3' AS gid, 'Nation' AS label, n_name AS name FROM nation WHERE n_nationkey = 3")
def _get_vertex(g: PropertyGraph) -> DataFrame:
    v = g.getVertex("Nation:3")
    return g.spark.createDataFrame([(v["gid"], v["label"], v["data"]["n_name"])], "gid string, label string, name string")


# metadata
_register("labels", "SELECT 'Region' AS label UNION ALL " + " UNION ALL ".join(f"SELECT '{v.label}'" for v in MAPPING.vertices if v.label != "Region"))(lambda g: g.vertices.select("label").distinct())
_register("schema", "SELECT * FROM (VALUES ('Region', 'r_regionkey', 'NUMERIC'), ('Region', 'r_name', 'STRING'), ('Part', 'p_partkey', 'NUMERIC'), ('Part', 'p_name', 'STRING'), ('Part', 'p_brand', 'STRING'), ('Part', 'p_type', 'STRING'), ('Part', 'p_size', 'NUMERIC'), ('Part', 'p_retailprice', 'NUMERIC'), ('Part', 'p_words', '[STRING]')) v(label, field, type)")(lambda g: schema.vertex_schema(g).where(F.col("label").isin("Region", "Part")))
_register("index_terms", "SELECT p_brand AS term, count(*) AS n FROM part GROUP BY ALL")(lambda g: index_terms(g, "Part", "p_brand"))
_register("index_range", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, count(o_totalprice) AS n FROM orders")(lambda g: index_range(g, "Order", "o_totalprice"))

# other notations
_register("wire_json", "SELECT 'Order:' || o_orderkey AS gid FROM orders WHERE o_totalprice > 300000")(
    lambda g: g.run('{"query": [{"v": []}, {"has_label": ["Order"]}, {"has": {"condition": {"key": "o_totalprice", "value": 300000, "condition": "GT"}}}]}').table(gid="_gid")
)
_register("text_chain", _N("SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50"))(lambda g: parse_chain('V().hasLabel("Order").has(and_(eq("o_orderstatus", "F"), lt("o_custkey", 50))).count()', g).to_df())
_register("cypher", "SELECT c_name AS customer, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE' AND o_totalprice > 100000")(
    lambda g: parse_cypher("MATCH (c:Customer {c_mktsegment: 'FURNITURE'})-[:placed]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_name AS customer, o.o_totalprice AS price", g).to_df().select("render.*")
)
_register("graphql", "SELECT 'Nation:' || n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 5")(
    lambda g: parse_graphql("{ Nation(filter: {gt: {n_nationkey: 5}}) { id n_name in_region { r_name } } }", g).to_df().select("render.id", F.col("render.n_name").alias("name"), F.col("render.in_region.r_name").alias("region"))
)
