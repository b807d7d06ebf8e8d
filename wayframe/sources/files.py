"""Graph files: JSON lines, graph documents, RDF/XML, and Parquet."""

from __future__ import annotations

import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..graph import PropertyGraph

_ENDS = ("from", "to")


def _lines(spark: SparkSession, path: str | list[str], edges: bool) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are none); gzip files are told by their name."""
    t = spark.read.text(path if isinstance(path, list) else [path]).where(F.trim("value") != "")
    t = t.select("value", F.try_parse_json("value").alias("v"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    names = ["gid", "label", *(_ENDS if edges else ())]
    data = F.coalesce(F.try_variant_get("v", "$.data", "variant"), F.parse_json(F.lit("{}")))
    t = t.select("value", *[text(n).alias(n) for n in names], data.alias("data"))
    good = F.lit(True)
    for n in names:
        if n != "gid" or not edges:
            good = good & F.coalesce(F.trim(F.col(f"`{n}`")) != "", F.lit(False))
    if edges:
        # without a gid of its own an edge is known by its content
        t = t.withColumn("gid", F.when(F.coalesce(F.trim("gid") != "", F.lit(False)), F.col("gid")).otherwise(F.sha2("value", 256)))
    t = t.withColumn("__good", good)
    return t.where("__good").select(*names, "data"), t.where("not __good").select("value")


def read_jsonl(spark: SparkSession, vertices: str | list[str], edges: str | list[str], name: str = "graph") -> PropertyGraph:
    """Vertex and edge files with one JSON object a line; lines that are no element are skipped (see bad_lines)."""
    return PropertyGraph(_lines(spark, vertices, False)[0], _lines(spark, edges, True)[0], name=name)


def bad_lines(spark: SparkSession, path: str | list[str], edges: bool) -> DataFrame:
    """The lines that read_jsonl skips."""
    return _lines(spark, path, edges)[1]


def read_directory(spark: SparkSession, folder: str, name: str = "graph") -> PropertyGraph:
    """All *.vertex.json and *.edge.json files of a folder, gzipped or not."""
    return read_jsonl(spark, f"{folder}/*.vertex.json*", f"{folder}/*.edge.json*", name)


def write_jsonl(graph: PropertyGraph, vertices: str, edges: str) -> None:
    """One JSON object a line, in folders of part files."""
    graph.vertices.write.mode("overwrite").json(vertices)
    graph.edges.write.mode("overwrite").json(edges)


def write_parquet(graph: PropertyGraph, folder: str) -> None:
    """Vertices and edges by label, so that scans of a label read nothing else; and an empty table that tells the types."""
    for kind, df in (("vertices", graph.vertices), ("edges", graph.edges)):
        df.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/{kind}")
        df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{kind}-types")


def read_parquet(spark: SparkSession, folder: str, name: str = "graph") -> PropertyGraph:
    def load(kind: str) -> DataFrame:
        return spark.read.schema(spark.read.parquet(f"{folder}/{kind}-types").schema).parquet(f"{folder}/{kind}")

    return PropertyGraph(load("vertices"), load("edges"), name=name)


def read_jdbc(spark: SparkSession, url: str, vertices: str, edges: str, name: str = "graph", **options: str) -> PropertyGraph:
    """Tables (gid, label, data) and (gid, label, from, to, data) of a database, data as JSON text."""
    def load(table: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().withColumn("data", F.parse_json(F.col("data").cast("string")))

    return PropertyGraph(load(vertices), load(edges), name=name)


def from_records(spark: SparkSession, vertices: list[dict], edges: list[dict], name: str = "graph") -> PropertyGraph:
    """Elements as dicts, with schemaless payloads."""
    def make(rows: list[dict], names: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "data"]])
        data = [(*[r.get(n) for n in names], json.dumps(r.get("data") or {})) for r in rows]
        return spark.createDataFrame(data, schema).withColumn("data", F.parse_json("data"))

    made = [{**e, "gid": e.get("gid") or f"{e['from']}-{e['label']}-{e['to']}-{i}"} for i, e in enumerate(edges)]
    return PropertyGraph(make(vertices, ["gid", "label"]), make(made, ["gid", "label", *_ENDS]), name=name)


def read_document(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph document, JSON or YAML: {graph, vertices: [...], edges: [...]}."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise PlanError("YAML documents need the yaml package") from e
        body = yaml.safe_load(text)
    else:
        body = json.loads(text)
    return from_records(spark, body.get("vertices") or [], body.get("edges") or [], body.get("graph") or os.path.basename(path))


_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def triples(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(subject, predicate, object, whether the object is a resource) of an RDF/XML document."""
    counter = iter(range(1 << 62))

    def node(el: ET.Element) -> Iterator[tuple[str, str, str, bool]]:
        subject = el.get(_RDF + "about") or el.get(_RDF + "nodeID") or ("#" + el.get(_RDF + "ID") if el.get(_RDF + "ID") else f"_:b{next(counter)}")
        el.set("subject", subject)
        if el.tag != _RDF + "Description":
            yield subject, _RDF + "type", el.tag, True
        for k, v in el.attrib.items():
            if not k.startswith(_RDF) and k != "subject":
                yield subject, k, v, False
        for p in el:
            to = p.get(_RDF + "resource") or p.get(_RDF + "nodeID")
            if to:
                yield subject, p.tag, to, True
            elif len(p):
                for child in p:
                    yield from node(child)
                    yield subject, p.tag, child.get("subject"), True
            else:
                yield subject, p.tag, p.text or "", False

    root = ET.fromstring(text)
    for el in root if root.tag == _RDF + "RDF" else [root]:
        yield from node(el)


def read_rdf(spark: SparkSession, path: str | list[str], default_label: str = "Resource") -> PropertyGraph:
    """RDF/XML files: literals become payload fields, rdf:type the label, resources edges.

    A file is parsed whole in one task; files are parsed side by side.
    """
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for text in b.column(0).to_pylist():
                rows = list(triples(text))
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], ["s", "p", "o", "r"])

    def local(c: Column) -> Column:
        return F.regexp_extract(c, r"([^/#}]*)$", 1)

    t = files.mapInArrow(run, "s string, p string, o string, r boolean").distinct()
    kinds = t.where(F.col("p") == _RDF + "type").groupBy("s").agg(F.min(local(F.col("o"))).alias("label"))
    facts = t.where("not r").groupBy("s", local(F.col("p")).alias("k")).agg(F.min("o").alias("o"))
    data = facts.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("k", "o"))).alias("m"))
    subjects = t.select("s").union(t.where(F.col("r") & (F.col("p") != _RDF + "type")).select("o")).distinct()
    v = subjects.join(kinds, "s", "left").join(data, "s", "left")
    v = v.select(F.col("s").alias("gid"), F.coalesce("label", F.lit(default_label)).alias("label"), F.to_variant_object(F.coalesce("m", F.expr("cast(map() as map<string,string>)"))).alias("data"))
    e = t.where(F.col("r") & (F.col("p") != _RDF + "type"))
    e = e.select(F.sha2(F.concat_ws("\n", "s", "p", "o"), 256).alias("gid"), local(F.col("p")).alias("label"), F.col("s").alias("from"), F.col("o").alias("to"), F.parse_json(F.lit("{}")).alias("data"))
    return PropertyGraph(v, e, name="rdf")
