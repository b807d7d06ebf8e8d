"""Start steps and hops: scans and joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..plans.compiler import Context, Frame

ENTRY = "struct<vertex:string,edge:string>"
#: Stands for a struct without fields, which Parquet can't hold.
NOTHING = T.StructType([T.StructField("_", T.BooleanType())])
#: Stands for the labels of a hop that leads nowhere; no element has it.
NO_LABEL = "-"


def no_path() -> Column:
    return F.expr(f"cast(array() as array<{ENTRY}>)")


def extend(ctx: "Context", df: DataFrame, kind: str) -> DataFrame:
    """Append the current element to the path, if anything reads it."""
    if not ctx.path:
        return df
    gid = F.col("cur.gid")
    none = F.lit(None).cast("string")
    entry = F.struct((gid if kind == "vertex" else none).alias("vertex"), (gid if kind == "edge" else none).alias("edge"))
    return df.withColumn("path", F.concat("path", F.array(entry)) if "path" in df.columns else F.array(entry))


def element(ctx: "Context", df: DataFrame, needs: frozenset[str], name: str) -> DataFrame:
    """Rows of a vertex or edge table with the element struct as one more column; data has the needed fields only."""
    kind = df.schema["data"].dataType
    if isinstance(kind, T.VariantType):
        data = F.col("data") if needs else F.lit(None).cast("variant")
    else:
        every = ctx.graph.payload
        names = [x for x in every.names if "*" in needs or x in needs]
        have = set(kind.names)
        data = F.struct(*[(F.col("data").getField(x) if x in have else F.lit(None).cast(every[x].dataType)).alias(x) for x in names]) if names else F.lit(None).cast(NOTHING)
    ends = {c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string") for c in ("from", "to")}
    x = F.struct(*[F.lit(None).cast(t.dataType).alias(t.name) for t in ctx.extra.fields]) if ctx.extra.fields else F.lit(None).cast(NOTHING)
    return df.withColumn(name, F.struct(F.col("gid").alias("gid"), F.col("label").alias("label"), *[c.alias(n) for n, c in ends.items()], data.alias("data"), x.alias("x")))


def scan(ctx: "Context", edges: bool, labels: list[str] | None, needs: frozenset[str], name: str) -> DataFrame:
    """The tables of these labels as one, each read with the element struct of the whole graph."""
    parts = [element(ctx, t, needs, name).select("gid", *((F.col("from"), F.col("to")) if edges else ()), name) for t in ctx.graph.tables(edges, labels)]
    df = reduce(DataFrame.unionByName, parts)
    return df.where(F.col(name).getField("label").isin(labels)) if labels is not None else df


def _labels_after(ctx: "Context", i: int) -> list[str] | None:
    """The labels that filters right behind step i leave; None if they leave all."""
    for name, v in ctx.steps[i + 1 :]:
        if name == "hasLabel":
            return list(v)
        if name not in ("has", "hasId", "hasKey", "as"):
            return None
    return None


def start(ctx: "Context", name: str, ids: list[str], needs: frozenset[str]) -> "Frame":
    from ..plans.compiler import Frame

    kind = "vertex" if name == "v" else "edge"
    df = scan(ctx, name == "e", _labels_after(ctx, 0), needs, "cur")
    if ids:
        once = sorted(set(ids))
        df = df.where(F.col("gid").isin(once))
        if len(once) < len(ids):
            # an id that is given twice yields its element twice
            times = F.create_map(*[x for i in once for x in (F.lit(i), F.lit(ids.count(i)))])
            df = df.withColumn("__n", F.explode(F.sequence(F.lit(1), times[F.col("gid")])))
    only = _labels_after(ctx, 0)
    return Frame(extend(ctx, df.select("cur"), kind), kind, may=None if only is None else frozenset(only))


def _far_labels(ctx: "Context", labels: list[str], end: str, only: list[str] | None) -> list[str] | None:
    """Labels of the vertices that edges of these labels lead to and that the next filters leave, as far as is known."""
    known = ctx.graph.ends
    if labels and all(x in known for x in labels):
        got = {known[x][0 if end == "from" else 1] for x in labels}
        return sorted(got if only is None else got & set(only))
    return only


def _reachable(ctx: "Context", labels: list[str], near: str, may: frozenset[str] | None) -> list[str]:
    """The edge labels among these (or all) that can begin at vertices of the labels in may; empty for any."""
    have = labels or [x for x in ctx.graph.edge_labels() or ()]
    if may is None or not have:
        return labels
    known, side = ctx.graph.ends, 0 if near == "from" else 1
    return [x for x in have if x not in known or known[x][side] in may] or [NO_LABEL]


def _ends_of(ctx: "Context", labels: Iterable[str] | None, end: str) -> frozenset[str] | None:
    """Labels of the vertices at this end of edges of these labels; None if that isn't known."""
    known, side = ctx.graph.ends, 0 if end == "from" else 1
    if not labels or not all(x in known or x == NO_LABEL for x in labels):
        return None
    return frozenset(known[x][side] for x in labels if x != NO_LABEL)


def _targets(ctx: "Context", labels: list[str], near: str, far: str, needs: frozenset[str], only: list[str] | None) -> DataFrame:
    """(__k, __to): the near end's gid of each edge and the vertex at its far end; dangling edges give none."""
    known = ctx.graph.ends
    ends = [F.col(near).alias("__k"), F.col(far)]
    if ctx.integrity and not needs and labels and all(x in known for x in labels):
        # no vertex is missing and nothing of its payload is read: the edge tells gid and label
        parts = []
        for x in sorted(set(labels)):
            label = F.lit(known[x][0 if far == "from" else 1])
            e = scan(ctx, True, [x], frozenset(), "__e").select(*ends).select("__k", F.col(far).alias("gid"), label.alias("label"))
            e = e.withColumn("data", F.lit(None).cast("variant" if ctx.graph.payload is None else NOTHING))
            parts.append(element(ctx, e, needs, "__to").select("__k", "__to"))
        return reduce(DataFrame.unionByName, parts)
    v = scan(ctx, False, _far_labels(ctx, labels, far, only), needs, "__to").withColumnRenamed("gid", "__far")
    e = scan(ctx, True, labels or None, frozenset(), "__e").select(*ends).withColumnRenamed(far, "__end")
    return e.join(v, F.col("__end") == F.col("__far")).select("__k", "__to")


def _step(ctx: "Context", f: "Frame", right: DataFrame, key: Column, kind: str, outer: bool) -> DataFrame:
    df = f.df.join(right, key == F.col("__k"), "left" if outer else "inner")
    keep = [c for c in f.df.columns if c != "cur"]
    return extend(ctx, df.select(F.col("__to").alias("cur"), *keep), kind)


def hop(ctx: "Context", f: "Frame", i: int) -> "Frame":
    from dataclasses import replace

    from ..errors import PlanError

    (name, labels), needs = ctx.steps[i], ctx.needs[i]
    outer = name.endswith("Null")
    # what later filters drop needn't be read, unless a row without match would appear in its place
    only = None if outer else _labels_after(ctx, i)
    base = name.removesuffix("Null")
    to_edge = base.endswith("E")
    way = base.removesuffix("E")
    sides = {"out": ["from"], "in": ["to"], "both": ["to", "from"]}[way]
    if f.kind == "edge" and to_edge:
        raise PlanError(f"{name} needs vertices")
    parts = []
    reached: list[frozenset[str] | None] = []
    kind = "edge" if to_edge else "vertex"
    given = labels
    for near in sides:
        far = "to" if near == "from" else "from"
        if f.kind == "edge":
            # from an edge, out leads to its target and both to its two ends; labels play no part
            end = far if way != "both" else near
            end = {"to": "from", "from": "to"}[end] if way == "both" else end
            ends = _ends_of(ctx, f.may, end)
            reached.append(ends)
            there = only if ends is None else sorted(ends if only is None else ends & set(only)) or [NO_LABEL]
            v = scan(ctx, False, there, needs, "__to").withColumnRenamed("gid", "__k")
            parts.append(_step(ctx, f, v, F.col("cur").getField(end), kind, False))
            continue
        labels = _reachable(ctx, given, near, f.may)
        if to_edge:
            reached.append(frozenset(labels) if labels else None)
            e = scan(ctx, True, labels or only, needs, "__to").select(F.col(near).alias("__k"), "__to")
            parts.append(_step(ctx, f, e, F.col("cur.gid"), kind, outer))
        else:
            reached.append(_ends_of(ctx, labels, far))
            parts.append(_step(ctx, f, _targets(ctx, labels, near, far, needs, only), F.col("cur.gid"), kind, outer))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    may = None if any(x is None for x in reached) else frozenset().union(*reached)
    if only is not None:
        may = frozenset(only) if may is None else may & frozenset(only)
    return replace(f, df=df, kind=kind, same=frozenset(), may=may)
