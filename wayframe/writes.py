"""Upserts and deletes: each gives a new graph."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import PropertyGraph


def latest(df: DataFrame, order: str) -> DataFrame:
    """The last record of each gid, whole."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy("gid").agg(F.max_by(F.struct(*rest), order).alias("r")).select("r.*")


def _ok(df: DataFrame, names: list[str]) -> DataFrame:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.coalesce(F.trim(F.col(f"`{n}`")) != "", F.lit(False))
    return df.withColumn("__ok", cond)


def check(records: DataFrame, edges: bool) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records: gid, label, from and to must not be blank; a blank edge gid is made up."""
    if edges:
        made = F.when(F.coalesce(F.trim("gid") != "", F.lit(False)), F.col("gid")).otherwise(F.expr("uuid()"))
        records = records.withColumn("gid", made)
    marked = _ok(records, ["gid", "label", "from", "to"] if edges else ["gid", "label"])
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")


def _fit(graph: PropertyGraph, records: DataFrame, like: DataFrame) -> DataFrame:
    """records with the payload type of the table they go to."""
    want, have = like.schema["data"].dataType, records.schema["data"].dataType
    if want == have:
        return records
    if isinstance(want, T.VariantType):
        data = F.parse_json("data") if isinstance(have, T.StringType) else F.to_variant_object("data")
        return records.withColumn("data", data)
    if isinstance(have, T.StringType):
        return records.withColumn("data", F.from_json("data", want))
    names = set(have.names)
    return records.withColumn("data", F.struct(*[(F.col("data").getField(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]))


def upsert(graph: PropertyGraph, vertices: DataFrame | None = None, edges: DataFrame | None = None, order: str | None = None) -> PropertyGraph:
    """Records replace those of the same gid as a whole; bad records are left out.

    order: the column that tells which of several records of a gid is the last
    one; without it the greatest by content is, so give it wherever gids repeat.
    """
    def put(table: DataFrame, records: DataFrame | None, is_edge: bool) -> DataFrame:
        if records is None:
            return table
        good = _fit(graph, check(records, is_edge)[0], table)
        seq = F.col(order).cast("long") if order else F.lit(0).cast("long")
        name = "__seq" + uuid.uuid4().hex[:6]
        new = latest(good.withColumn(name, seq).select(*table.columns, name), name)
        return table.join(new.select("gid"), "gid", "left_anti").select(*table.columns).unionByName(new)

    return PropertyGraph(put(graph.vertices, vertices, False), put(graph.edges, edges, True), graph.ends, False, graph.name)


def _rows(graph: PropertyGraph, rows: list[dict[str, Any]], edge: bool) -> DataFrame:
    import json

    names = ["gid", "label", *(["from", "to"] if edge else [])]
    data = [(*[r.get(n) for n in names], json.dumps(r.get("data") or {}), i) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{n}` string" for n in names) + ", data string, seq long"
    return graph.spark.createDataFrame(data, schema)


def addVertex(graph: PropertyGraph, gid: str, label: str, data: dict | None = None) -> PropertyGraph:
    return bulkAdd(graph, vertices=[{"gid": gid, "label": label, "data": data}])


def addEdge(graph: PropertyGraph, source: str, target: str, label: str, data: dict | None = None, gid: str | None = None) -> PropertyGraph:
    return bulkAdd(graph, edges=[{"gid": gid, "label": label, "from": source, "to": target, "data": data}])


def bulkAdd(graph: PropertyGraph, vertices: list[dict] = (), edges: list[dict] = ()) -> PropertyGraph:
    """Records as dicts; a later one of the same gid wins."""
    v = _rows(graph, list(vertices), False) if vertices else None
    e = _rows(graph, list(edges), True) if edges else None
    return upsert(graph, v, e, order="seq")


def deleteVertex(graph: PropertyGraph, *gids: str) -> PropertyGraph:
    """Without these vertices and every edge at them."""
    gone = graph.spark.createDataFrame([(g,) for g in gids], "g string")
    v = graph.vertices.join(gone, F.col("gid") == F.col("g"), "left_anti")
    e = graph.edges.join(gone, F.col("from") == F.col("g"), "left_anti").join(gone, F.col("to") == F.col("g"), "left_anti")
    return PropertyGraph(v, e, graph.ends, graph.integrity, graph.name)


def deleteEdge(graph: PropertyGraph, *gids: str) -> PropertyGraph:
    gone = graph.spark.createDataFrame([(g,) for g in gids], "g string")
    return PropertyGraph(graph.vertices, graph.edges.join(gone, F.col("gid") == F.col("g"), "left_anti"), graph.ends, graph.integrity, graph.name)
