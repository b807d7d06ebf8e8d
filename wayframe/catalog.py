"""Named graphs, with their indexes, schemas and the time of their last change."""

from __future__ import annotations

import json
import os
import shutil
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import writes
from .errors import NotFound, PlanError
from .graph import PropertyGraph
from .plans.compiler import check_name
from .schema import edge_schema, vertex_schema
from .sources.files import from_records, read_parquet, write_parquet


class Catalog:
    """Graphs in a folder.  Each change writes a new version and then switches to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def _meta_path(self, name: str) -> str:
        return os.path.join(self.folder, name, "graph.json")

    def _meta(self, name: str) -> dict[str, Any]:
        try:
            with open(self._meta_path(name), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            raise NotFound(name) from None

    def _save(self, name: str, meta: dict[str, Any]) -> None:
        meta["timestamp"] = time.time_ns()
        path = self._meta_path(name)
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(meta, f)
        os.replace(path + ".new", path)

    def listGraphs(self) -> list[str]:
        return sorted(x for x in os.listdir(self.folder) if os.path.exists(self._meta_path(x)))

    def addGraph(self, name: str, graph: PropertyGraph | None = None) -> PropertyGraph:
        check_name(name, "graph")
        if name in self.listGraphs():
            raise PlanError(f"there is a graph named {name}")
        os.makedirs(os.path.join(self.folder, name), exist_ok=True)
        return self.put(name, graph or from_records(self.spark, [], []), {"version": 0, "indexes": []})

    def put(self, name: str, graph: PropertyGraph, meta: dict[str, Any] | None = None) -> PropertyGraph:
        meta = meta or self._meta(name)
        meta["version"] += 1
        write_parquet(graph, os.path.join(self.folder, name, f"v{meta['version']}"))
        self._save(name, meta)
        return self.graph(name)

    def graph(self, name: str) -> PropertyGraph:
        g = read_parquet(self.spark, os.path.join(self.folder, name, f"v{self._meta(name)['version']}"), name)
        return g

    def deleteGraph(self, name: str) -> None:
        self._meta(name)
        shutil.rmtree(os.path.join(self.folder, name))

    def getTimestamp(self, name: str) -> int:
        return self._meta(name)["timestamp"]

    def addVertex(self, name: str, gid: str, label: str, data: dict | None = None) -> PropertyGraph:
        return self.put(name, writes.addVertex(self.graph(name), gid, label, data))

    def addEdge(self, name: str, source: str, target: str, label: str, data: dict | None = None, gid: str | None = None) -> PropertyGraph:
        return self.put(name, writes.addEdge(self.graph(name), source, target, label, data, gid))

    def bulkAdd(self, name: str, vertices: list[dict] = (), edges: list[dict] = ()) -> PropertyGraph:
        return self.put(name, writes.bulkAdd(self.graph(name), vertices, edges))

    def deleteVertex(self, name: str, *gids: str) -> PropertyGraph:
        return self.put(name, writes.deleteVertex(self.graph(name), *gids))

    def deleteEdge(self, name: str, *gids: str) -> PropertyGraph:
        return self.put(name, writes.deleteEdge(self.graph(name), *gids))

    # indexes: which fields are looked up; scans prune by label anyway
    def addIndex(self, name: str, label: str, field: str) -> None:
        meta = self._meta(name)
        if [label, field] not in meta["indexes"]:
            meta["indexes"].append([label, field])
        self._save(name, meta)

    def deleteIndex(self, name: str, label: str, field: str) -> None:
        meta = self._meta(name)
        meta["indexes"] = [x for x in meta["indexes"] if x != [label, field]]
        self._save(name, meta)

    def listIndices(self, name: str) -> list[dict[str, str]]:
        return [{"label": a, "field": b} for a, b in self._meta(name)["indexes"]]

    # schemas and mappings
    def sampleSchema(self, name: str, n: int = 50) -> tuple[DataFrame, DataFrame]:
        g = self.graph(name)
        return vertex_schema(g, n), edge_schema(g, n)

    def addSchema(self, name: str, schema: dict[str, Any]) -> None:
        self._save(name, {**self._meta(name), "schema": schema})

    def getSchema(self, name: str) -> dict[str, Any]:
        meta = self._meta(name)
        if "schema" not in meta:
            raise NotFound(f"schema of {name}")
        return meta["schema"]

    def addMapping(self, name: str, mapping: dict[str, Any]) -> None:
        self._save(name, {**self._meta(name), "mapping": mapping})

    def getMapping(self, name: str) -> dict[str, Any]:
        meta = self._meta(name)
        if "mapping" not in meta:
            raise NotFound(f"mapping of {name}")
        return meta["mapping"]

    def listTables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]


def index_terms(graph: PropertyGraph, label: str, field: str) -> DataFrame:
    """(term, n): how often each value of a field occurs among the vertices of a label."""
    t = graph.query().V().hasLabel(label).table(term=field)
    return t.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


def index_range(graph: PropertyGraph, label: str, field: str) -> DataFrame:
    """(least, most, n) of a numeric field."""
    t = graph.query().V().hasLabel(label).table(x=field).select(F.col("x").cast("double").alias("x"))
    return t.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("x").alias("n"))
