"""Property graphs over two DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NotFound, PlanError
from .plans.steps import Traversal


class PropertyGraph:
    """vertices (gid, label, data) and edges (gid, label, from, to, data).

    data is a struct with the fields of all labels (typed), or a variant
    (schemaless; a null value and a missing key differ).

    ends: for edge labels that lead from one vertex label to one other, that
    pair; hops along them only read vertices of that label.  integrity: whether
    every edge's ends are known to exist; then hops whose vertices' payload
    isn't read need no vertex table at all.

    loop_rounds: after so many rounds a loop that still has travelers is an
    error; None lets it run until none is left.
    """

    loop_rounds: int | None = 100

    def __init__(self, vertices: DataFrame | None, edges: DataFrame | None, ends: dict[str, tuple[str, str]] | None = None, integrity: bool = False, name: str = "graph", parts: tuple[dict[str, list[DataFrame]], dict[str, list[DataFrame]]] | None = None):
        """parts: instead of the two DataFrames, those of each vertex and each edge label, with payloads of their own fields."""
        self.ends, self.integrity, self.name = ends or {}, integrity, name
        self._parts = parts or ({"": [vertices]}, {"": [edges]})
        self._whole: list[DataFrame | None] = [None, None]
        needs = (("gid", "label", "data"), ("gid", "label", "from", "to", "data"))
        kinds = []
        for what, group, need in zip(("vertices", "edges"), self._parts, needs):
            for label, dfs in group.items():
                for i, df in enumerate(dfs):
                    missing = [c for c in need if c not in df.columns]
                    if missing:
                        raise PlanError(f"{what} have no column {', '.join(missing)}")
                    dfs[i] = df.select(*need)
                    kinds.append(df.schema["data"].dataType)
        if any(isinstance(k, T.VariantType) for k in kinds):
            if not all(isinstance(k, T.VariantType) for k in kinds):
                raise PlanError("vertices and edges need the same kind of payload")
            self.payload = None
        else:
            fields: dict[str, T.DataType] = {}
            for k in kinds:
                for f in k.fields if isinstance(k, T.StructType) else ():
                    if f.name != "_" and fields.setdefault(f.name, f.dataType) != f.dataType:
                        raise PlanError(f"field {f.name} has two types")
            self.payload = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    def tables(self, edges: bool, labels: list[str] | None = None) -> list[DataFrame]:
        """The tables that may hold elements of these labels (all if None); others are never planned."""
        group = self._parts[edges]
        got = [df for label, dfs in group.items() if labels is None or label == "" or label in labels for df in dfs]
        return got or [df.where("false") for df in next(iter(group.values()))[:1]]

    def edge_labels(self) -> list[str] | None:
        """The labels of all edges; None if a table may hold any."""
        return None if "" in self._parts[True] else list(self._parts[True])

    def _union(self, edges: bool) -> DataFrame:
        if self._whole[edges] is None:
            dfs = self.tables(edges)
            if len(dfs) > 1:
                # every table with the fields of all of its kind
                fields = {f.name: f.dataType for df in dfs for f in df.schema["data"].dataType.fields if f.name != "_"}
                pad = lambda df: F.struct(*[(F.col("data").getField(n) if n in df.schema["data"].dataType.names else F.lit(None).cast(t)).alias(n) for n, t in fields.items()]) if fields else F.col("data")
                dfs = [df.withColumn("data", pad(df)) for df in dfs]
            self._whole[edges] = reduce(DataFrame.unionByName, dfs)
        return self._whole[edges]

    @property
    def vertices(self) -> DataFrame:
        return self._union(False)

    @property
    def edges(self) -> DataFrame:
        return self._union(True)

    @property
    def spark(self) -> SparkSession:
        return self.tables(False)[0].sparkSession

    def query(self) -> Traversal:
        return Traversal(graph=self)

    V = property(lambda self: self.query().V)
    E = property(lambda self: self.query().E)

    def run(self, traversal: Traversal | str | list | dict) -> Traversal:
        """A traversal without a graph, or its wire JSON, bound to this one."""
        t = traversal if isinstance(traversal, Traversal) else Traversal.from_json(traversal)
        return Traversal(t.steps, self)

    def _get(self, gid: str, edge: bool) -> dict[str, Any]:
        got = (self.query().E(gid) if edge else self.query().V(gid)).collect()
        if not got:
            raise NotFound(gid)
        return got[0]

    def getVertex(self, gid: str) -> dict[str, Any]:
        return self._get(gid, False)

    def getEdge(self, gid: str) -> dict[str, Any]:
        return self._get(gid, True)

    def listLabels(self) -> dict[str, list[str]]:
        tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "label").distinct()
        rows = tag(self.vertices, "vertex").unionByName(tag(self.edges, "edge")).orderBy("kind", "label").collect()
        return {"vertexLabels": [r["label"] for r in rows if r["kind"] == "vertex"], "edgeLabels": [r["label"] for r in rows if r["kind"] == "edge"]}

    def sampleSchema(self, n: int | None = None) -> tuple[DataFrame, DataFrame]:
        from .schema import edge_schema, vertex_schema

        return vertex_schema(self, n), edge_schema(self, n)
