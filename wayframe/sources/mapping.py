"""Tables as a graph: which rows are vertices, which rows or foreign keys are edges."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..graph import PropertyGraph
from ..operators.hops import NOTHING


@dataclass(frozen=True)
class VertexTable:
    """Each row is a vertex; its gid is the prefix (the label and a colon by default) and the key."""

    table: str
    label: str
    key: str
    prefix: str | None = None
    columns: tuple[str, ...] | None = None

    @property
    def start(self) -> str:
        return self.label + ":" if self.prefix is None else self.prefix


@dataclass(frozen=True)
class EdgeTable:
    """Each row is an edge between the vertices of two labels.

    gid: the column that identifies the edge; without one it is made from the
    ends, a hash of the row and a row number, so that equal rows stay apart.
    A row with a null end is no edge.
    """

    table: str
    label: str
    source: str
    source_key: str
    target: str
    target_key: str
    gid: str | None = None
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    """Each row of a vertex table whose column refers to another vertex gives an edge.

    gid: label, table, key, target table and key, joined by colons, each
    percent-encoded; reverse lets the edge lead from the referred row.
    """

    table: str
    label: str
    column: str
    target: str
    reverse: bool = False


def _gid(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


@dataclass
class GraphMapping:
    vertices: list[VertexTable]
    edges: list[EdgeTable | ForeignKey] = field(default_factory=list)
    #: that no edge dangles; see PropertyGraph
    integrity: bool = False

    def apply(self, tables: Mapping[str, DataFrame], name: str = "graph") -> PropertyGraph:
        by_label = {v.label: v for v in self.vertices}
        by_table = {v.table: v for v in self.vertices}
        if len(by_label) < len(self.vertices):
            raise PlanError("two vertex tables have the same label")

        def have(table: str, *columns: str) -> DataFrame:
            if table not in tables:
                raise PlanError(f"no table is named {table}")
            missing = [c for c in columns if c not in tables[table].columns]
            if missing:
                raise PlanError(f"table {table} has no column {', '.join(missing)}")
            return tables[table]

        def vertex(label: str) -> VertexTable:
            if label not in by_label:
                raise PlanError(f"no vertex table has the label {label}")
            return by_label[label]

        parts: list[tuple[DataFrame, list[Column], tuple[str, ...]]] = []
        for v in self.vertices:
            t = have(v.table, v.key, *(v.columns or ()))
            head = [_gid(v.start, F.col(v.key)).alias("gid"), F.lit(v.label).alias("label")]
            parts.append((t.where(F.col(v.key).isNotNull()), head, v.columns if v.columns is not None else tuple(t.columns)))
        vertex_parts = _by_label([v.label for v in self.vertices], parts)

        parts = []
        ends: dict[str, tuple[str, str]] = {}
        for e in self.edges:
            if isinstance(e, ForeignKey):
                own, far = by_table.get(e.table), vertex(e.target)
                if own is None:
                    raise PlanError(f"foreign key {e.label} is on {e.table}, which holds no vertices")
                t = have(e.table, own.key, e.column).where(F.col(e.column).isNotNull() & F.col(own.key).isNotNull())
                near, other = _gid(own.start, F.col(own.key)), _gid(far.start, F.col(e.column))
                code = [F.url_encode(x.cast("string")) for x in (F.lit(e.label), F.lit(e.table), F.col(own.key), F.lit(far.table), F.col(e.column))]
                gid, pair = F.concat_ws(":", *code), (own.label, far.label)
                if e.reverse:
                    near, other, pair = other, near, pair[::-1]
                columns: tuple[str, ...] = ()
            else:
                a, b = vertex(e.source), vertex(e.target)
                t = have(e.table, e.source_key, e.target_key, *([e.gid] if e.gid else []), *e.columns).where(F.col(e.source_key).isNotNull() & F.col(e.target_key).isNotNull())
                near, other = _gid(a.start, F.col(e.source_key)), _gid(b.start, F.col(e.target_key))
                if e.gid:
                    gid = _gid(e.label + ":", F.col(e.gid))
                else:
                    gid = F.concat_ws("-", near, F.lit(e.label), other, F.hex(F.xxhash64(*t.columns)), F.monotonically_increasing_id().cast("string"))
                pair, columns = (a.label, b.label), e.columns
            if ends.setdefault(e.label, pair) != pair:
                ends[e.label] = ("", "")
            parts.append((t, [gid.alias("gid"), F.lit(e.label).alias("label"), near.alias("from"), other.alias("to")], columns))
        known = {k: v for k, v in ends.items() if v != ("", "")}
        edge_parts = _by_label([e.label for e in self.edges], parts)
        if not edge_parts:
            none = F.lit(None).cast("string")
            v = vertex_parts[self.vertices[0].label][0].where("false")
            edge_parts = {"": [v.select("gid", "label", none.alias("from"), none.alias("to"), "data")]}
        return PropertyGraph(None, None, known, self.integrity, name, (vertex_parts, edge_parts))


def _by_label(labels: list[str], parts: list[tuple[DataFrame, list[Column], tuple[str, ...]]]) -> dict[str, list[DataFrame]]:
    out: dict[str, list[DataFrame]] = {}
    for label, (df, head, columns) in zip(labels, parts):
        data = F.struct(*columns) if columns else F.lit(None).cast(NOTHING)
        out.setdefault(label, []).append(df.select(*head, data.alias("data")))
    return out
