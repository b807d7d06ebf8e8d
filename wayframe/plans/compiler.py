"""Compiles a step list to one DataFrame plan.

A traveler is a row with ``cur`` (the current element), ``m_<name>`` for each
mark, and ``path`` where a later step asks for it.  Elements are structs of
gid, label, from, to, data and x; x holds the values that set and increment
assign.  What data carries is decided before anything is read, by going
through the steps backwards (see ``liveness``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions import conditions
from ..functions.paths import Path, Value, parse, resolve
from ..operators import aggregates, hops, loops
from .steps import HOPS, START, Step

ALL = frozenset(["*"])
NONE: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Frame:
    """Travelers at one point of the plan."""

    df: DataFrame | None
    kind: str = ""  # vertex, edge, count, aggregation, selection, render or path
    marks: dict[str, str] = field(default_factory=dict)
    #: marks that hold the current element itself
    same: frozenset[str] = frozenset()
    chosen: tuple[str, ...] = ()
    #: labels that the current element may have, as far as the plan tells; None for any
    may: frozenset[str] | None = None

    def with_df(self, df: DataFrame) -> "Frame":
        return replace(self, df=df)

    def element(self, mark: str | None) -> tuple[Column, T.StructType] | None:
        name = "cur" if mark is None else "m_" + mark
        if name not in self.df.columns:
            return None
        return F.col(name), self.df.schema[name].dataType

    def value(self, text: str) -> Value:
        path = parse(text)
        found = self.element(path.mark)
        if found is None:
            return Value(None, None)
        col, kind = found
        if path.root == "data" and not path.parts:
            return payload(col, kind)
        return resolve(path, col, kind)


@dataclass(frozen=True)
class Context:
    graph: Any
    steps: tuple[Step, ...]
    needs: tuple[frozenset[str], ...]
    extra: T.StructType
    path: bool
    stable: bool
    integrity: bool


def payload(col: Column, kind: T.StructType) -> Value:
    """An element's data with what steps assigned."""
    base, data, x = kind["data"].dataType, col.getField("data"), col.getField("x")
    names = [n for n in kind["x"].dataType.names if n != "_"]
    if not names:
        return Value(data, None if isinstance(base, T.VariantType) else base)
    if isinstance(base, T.VariantType):
        own = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[x.getField(n).cast("variant") for n in names]))
        own = F.map_filter(own, lambda k, v: v.isNotNull())
        old = F.map_filter(F.try_variant_get(data, "$", "map<string,variant>"), lambda k, v: ~F.map_contains_key(own, k))
        return Value(F.to_variant_object(F.map_concat(F.coalesce(old, F.expr("cast(map() as map<string,variant>)")), own)), None)
    out, types = data, {f.name: f.dataType for f in base.fields}
    for n in names:
        v = F.coalesce(x.getField(n).cast(types.get(n, kind["x"].dataType[n].dataType)), data.getField(n)) if n in types else x.getField(n)
        out = out.withField(f"`{n}`", v)
        types.setdefault(n, kind["x"].dataType[n].dataType)
    return Value(out, T.StructType([T.StructField(n, t) for n, t in types.items()]))


# what later steps read


def _templates(t: Any) -> list[str]:
    if isinstance(t, str):
        return [t]
    if isinstance(t, dict):
        return [p for v in t.values() for p in _templates(v)]
    return [p for v in t for p in _templates(v)] if isinstance(t, (list, tuple)) else []


def reads(step: Step) -> list[str]:
    """The field paths that a step reads."""
    name, v = step
    if name == "has":
        return conditions.keys_in(v)
    if name in ("hasKey", "distinct"):
        return list(v)
    if name == "render":
        return _templates(v)
    if name == "unwind":
        return [v]
    if name in ("set", "increment"):
        return [v["key"]]
    if name == "aggregate":
        return [body["field"] for a in v["aggregations"] for k, body in a.items() if k != "name" and "field" in body]
    return []


def liveness(steps: Sequence[Step], final: tuple[str, ...] | None) -> list[frozenset[str]]:
    """For each step, the payload fields that are read of the element it makes current."""
    needs: list[frozenset[str]] = [ALL] * len(steps)
    if any(n in ("mark", "jump", "custom") for n, _ in steps):
        return needs
    last = steps[-1][0] if steps else ""
    live: dict[str | None, frozenset[str]] = {}

    def read(paths: Sequence[str]) -> None:
        for p in paths:
            path = parse(p)
            if path.root in ("data", ""):
                live[path.mark] = live.get(path.mark, NONE) | (ALL if path.top is None else {path.top})

    if final is not None:
        read(final)
    elif last not in ("count", "aggregate", "render", "path", "select"):
        live[None] = ALL
    elif last == "select" and len(steps[-1][1]["marks"]) == 1:
        live[None] = ALL
    for i in range(len(steps) - 1, -1, -1):
        name, v = steps[i]
        if name in HOPS or name in START:
            needs[i] = live.pop(None, NONE)
        elif name == "as":
            live[None] = live.get(None, NONE) | live.pop(v, NONE)
        elif name == "select":
            if len(v["marks"]) == 1:
                live[v["marks"][0]] = live.get(v["marks"][0], NONE) | live.pop(None, NONE)
            else:
                live.pop(None, None)
                live.update({m: ALL for m in v["marks"]})
        elif name in ("count", "aggregate", "render", "path"):
            live.pop(None, None)
        elif name == "fields":
            live[None] = ALL if any(x.startswith("-") for x in v) else live.get(None, NONE)
            read([x for x in v if not x.startswith(("-", "$"))])
        read(reads((name, v)))
    return needs


def _extra(steps: Sequence[Step]) -> T.StructType:
    """The type of x: one field for each path that set or increment writes."""
    kinds: dict[str, T.DataType] = {}
    for name, v in steps:
        if name in ("set", "increment"):
            path = parse(v["key"])
            if path.root != "data" or not path.parts:
                continue
            value = v["value"]
            kind = T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()
            if not isinstance(value, (bool, int, float, str)):
                raise PlanError("set takes a string, number or boolean")
            key = ".".join(map(str, path.parts))
            if kinds.setdefault(key, kind) != kind:
                raise PlanError(f"{key} is set to values of different types")
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


# validation

_NAME = "!@#$%^&*()+={}[] :;\"',.<>?/\\|~"


def check_name(name: str, what: str) -> str:
    if not name or name[0] in "_-" or any(c in _NAME for c in name):
        raise PlanError(f"{name!r} is no valid {what} name")
    return name


def validate(steps: Sequence[Step], resumed: bool = False) -> None:
    if not steps:
        raise PlanError("the traversal has no steps")
    if not resumed and steps[0][0] not in START:
        raise PlanError("a traversal starts with V or E")
    for name, v in steps[0 if resumed else 1 :]:
        if name in START:
            raise PlanError("V and E may only come first")
    for name, v in steps:
        if name in ("hasLabel", "hasId", "hasKey") and not v:
            raise PlanError(f"{name} needs at least one value")
        if name == "as":
            check_name(v, "mark")
        if name == "select" and not v["marks"]:
            raise PlanError("select needs a mark")
        if name == "aggregate":
            names = [a["name"] for a in v["aggregations"]]
            if len(set(names)) < len(names):
                raise PlanError("two aggregations have the same name")


# compilation


def compile_steps(graph: Any, steps: Sequence[Step], start: Frame | None = None, stable: bool = False, uses: tuple[str, ...] | None = None) -> Frame:
    """The Frame after all steps; start: travelers to go on with instead of V or E."""
    steps = tuple(steps)
    validate(steps, start is not None)
    loop = [i for i, (n, _) in enumerate(steps) if n in ("mark", "jump")]
    needs = liveness(steps, uses)
    path = any(n == "path" for n, _ in steps)
    ctx = Context(graph, steps, tuple(needs), _extra(steps), path, stable, graph.integrity)
    frame = start or Frame(None)
    if start is not None and path and "path" not in start.df.columns:
        frame = frame.with_df(frame.df.withColumn("path", hops.no_path()))
    if not loop:
        return run(ctx, frame, 0, len(steps))
    frame = run(ctx, frame, 0, loop[0])
    frame = loops.iterate(ctx, frame, loop[0], loop[-1] + 1, lambda f, a, b: run(ctx, f, a, b))
    return run(ctx, frame, loop[-1] + 1, len(steps))


def run(ctx: Context, frame: Frame, start: int, stop: int) -> Frame:
    for i in range(start, stop):
        frame = one(ctx, frame, i)
    return frame


def one(ctx: Context, f: Frame, i: int) -> Frame:
    name, v = ctx.steps[i]
    if name in START:
        return hops.start(ctx, name, v, ctx.needs[i])
    if f.kind not in ("vertex", "edge") and name not in ("limit", "skip", "range", "count", "custom"):
        raise PlanError(f"{name} can't follow a step that yields {f.kind}")
    df = f.df
    if name in HOPS:
        return hops.hop(ctx, f, i)
    if name == "has":
        cond = conditions.build(v, f.value)
        # a null element matches nothing; conditions on marks alone don't look at it
        if any(parse(k).mark is None for k in conditions.keys_in(v)):
            cond = F.col("cur").isNotNull() & cond
        return f.with_df(df.where(cond))
    if name == "hasLabel":
        left = frozenset(v) if f.may is None else f.may & frozenset(v)
        return replace(f, df=df.where(F.col("cur.label").isin(v)), may=left)
    if name == "hasId":
        return f.with_df(df.where(F.col("cur.gid").isin(v)))
    if name == "hasKey":
        for key in v:
            df = df.where(f.value(key).exists)
        return f.with_df(df)
    if name == "as":
        return replace(f, df=df.withColumn("m_" + v, F.col("cur")), marks={**f.marks, v: f.kind}, same=f.same | {v})
    if name == "select":
        return _select(ctx, f, v["marks"])
    if name in ("limit", "skip", "range"):
        return f.with_df(_slice(ctx, df, name, v))
    if name == "count":
        return Frame(df.agg(F.count("*").alias("count")), "count")
    if name == "distinct":
        return f.with_df(_distinct(f, v or ["_gid"]))
    if name == "fields":
        return _fields(ctx, f, v)
    if name == "unwind":
        return _unwind(ctx, f, v)
    if name == "render":
        return Frame(df.select(_render(f, v).alias("render")), "render")
    if name == "path":
        return Frame(df.select("path"), "path")
    if name == "set":
        return _assign(f, v["key"], lambda old, kind: F.lit(v["value"]).cast(kind), True)
    if name == "increment":
        return _assign(f, v["key"], lambda old, kind: (F.coalesce(conditions.number(old).cast("long"), F.lit(0)) + v["value"]).cast(kind), False)
    if name == "aggregate":
        # these may keep other travelers in each run
        steady = not any(n in ("limit", "skip", "range", "distinct", "custom") for n, _ in ctx.steps[:i])
        return Frame(aggregates.aggregate(df, v["aggregations"], f.value, steady), "aggregation")
    if name == "custom":
        return replace(f, df=df.transform(v), may=None)
    if name == "mark":
        return f
    raise PlanError(f"no step is named {name}")


def _slice(ctx: Context, df: DataFrame, name: str, v: Any) -> DataFrame:
    if ctx.stable and "cur" in df.columns:
        df = df.orderBy("cur.gid", *[F.col(c).getField("gid") for c in df.columns if c.startswith("m_")])
    if name == "limit":
        return df.limit(v)
    if name == "skip":
        return df.offset(v)
    start, stop = v["start"], v["stop"]
    if stop == -1:
        return df.offset(start)
    return df.offset(start).limit(max(stop - start, 0))


def _select(ctx: Context, f: Frame, marks: list[str]) -> Frame:
    if len(marks) > 1:
        have = [m for m in marks if m in f.marks]
        return Frame(f.df.select(*[F.col("m_" + m) for m in have]), "selection", {m: f.marks[m] for m in have}, chosen=tuple(have))
    m = marks[0]
    if m not in f.marks:
        raise PlanError(f"no mark is named {m}")
    df = f.df.withColumn("cur", F.col("m_" + m))
    kind = f.marks[m]
    return replace(f, df=hops.extend(ctx, df, kind), kind=kind, same=frozenset([m]), may=None)


def _distinct(f: Frame, paths: list[str]) -> DataFrame:
    df = f.df
    for i, p in enumerate(paths):
        v = f.value(p)
        if v.col is None:
            return df.where(F.lit(False))
        df = df.where(v.exists)
        key = aggregates.group_key(v)
        df = df.withColumn(f"__k{i}", key)
    # the survivor is the one of the least gid; partial aggregation keeps one row a key before the shuffle
    keys = [f"__k{i}" for i in range(len(paths))]
    one = F.min_by(F.struct(*f.df.columns), F.coalesce(F.col("cur.gid"), F.lit("")))
    return df.groupBy(*keys).agg(one.alias("__t")).select("__t.*")


def _unwind(ctx: Context, f: Frame, name: str) -> Frame:
    path = parse(name)
    if path.root != "data" or len(path.parts) != 1:
        raise PlanError("unwind takes the name of a field")
    key = str(path.parts[0])
    col = "cur" if path.mark is None else "m_" + path.mark
    element = f.element(path.mark)
    if element is None:
        return f
    kind = element[1]
    data = kind["data"].dataType
    if isinstance(data, T.VariantType):
        items = F.try_variant_get(F.col(col).getField("data"), f"$['{key}']", "array<variant>")
        df = f.df.withColumn("__item", F.explode_outer(items))
        old = F.coalesce(F.try_variant_get(F.col(col).getField("data"), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
        old = F.map_filter(old, lambda k, _: k != key)
        new = F.to_variant_object(F.map_concat(old, F.create_map(F.lit(key), F.coalesce(F.col("__item"), F.parse_json(F.lit("null"))))))
    elif isinstance(data, T.StructType) and key in data.names and isinstance(data[key].dataType, T.ArrayType):
        df = f.df.withColumn("__item", F.explode_outer(F.col(col).getField("data").getField(key)))
        new = F.col(col).getField("data").withField(f"`{key}`", F.col("__item"))
    else:
        df = f.df.withColumn("__item", F.lit(None))
        new = F.col(col).getField("data").withField(f"`{key}`", F.lit(None).cast("string")) if isinstance(data, T.StructType) else F.col(col).getField("data")
    df = df.withColumn(col, F.when(F.col(col).isNotNull(), F.col(col).withField("data", new))).drop("__item")
    return replace(f, df=hops.extend(ctx, df, f.kind), same=frozenset())


def _fields(ctx: Context, f: Frame, names: list[str]) -> Frame:
    cur, kind = f.element(None)
    names = [n for n in names if not n.lstrip("-").startswith("$")]
    keep = [parse(n) for n in names if not n.startswith("-")]
    drop = [parse(n[1:]) for n in names if n.startswith("-")]
    data = cur.getField("data")
    base = kind["data"].dataType
    fixed = lambda p: p.root not in ("data", "")
    out = cur
    if keep or not drop:
        tree: dict = {}
        for p in keep:
            if not fixed(p) and p.parts:
                at = tree
                for part in p.parts[:-1]:
                    at = at.setdefault(str(part), {})
                    if at is None:
                        break
                if at is not None:
                    at[str(p.parts[-1])] = None
        out = out.withField("data", _only(data, base, tree))
    else:
        for p in drop:
            if fixed(p):
                out = out.withField(p.root, F.lit(""))
        if isinstance(base, T.VariantType):
            gone = [str(p.parts[0]) for p in drop if not fixed(p) and len(p.parts) == 1]
            if gone:
                out = out.withField("data", F.to_variant_object(F.map_filter(F.try_variant_get(data, "$", "map<string,variant>"), lambda k, _: ~k.isin(gone))))
        else:
            gone = [p for p in drop if not fixed(p) and p.parts and str(p.parts[0]) in base.names]
            left = [n for n in base.names if not any(len(p.parts) == 1 and p.parts[0] == n for p in gone)]
            new = F.struct(*[data.getField(n).alias(n) for n in left]) if left else _empty(base)
            for p in gone:
                if len(p.parts) > 1 and p.parts[0] in left:
                    new = new.withField(f"`{p.parts[0]}`", data.getField(p.parts[0]).dropFields(".".join(map(str, p.parts[1:]))))
            out = out.withField("data", new)
    df = f.df.withColumn("cur", F.when(F.col("cur").isNotNull(), out))
    if ctx.path:
        df = df.withColumn("path", F.array(F.struct(F.lit(None).cast("string").alias("vertex"), F.lit(None).cast("string").alias("edge"))))
    return replace(f, df=df, same=frozenset())


def _empty(base: T.DataType) -> Column:
    return F.lit(None).cast(T.StructType([]))


def _only(data: Column, base: T.DataType, tree: dict) -> Column:
    if isinstance(base, T.VariantType):
        if not tree:
            return F.to_variant_object(F.expr("cast(map() as map<string,variant>)"))
        pairs = []
        for k, sub in tree.items():
            v = F.try_variant_get(data, f"$['{k}']", "variant")
            pairs += [F.lit(k), v if sub is None else F.when(v.isNotNull(), _only(v, base, sub))]
        return F.to_variant_object(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
    got = []
    for k, sub in tree.items():
        if isinstance(base, T.StructType) and k in base.names:
            v = data.getField(k)
            got.append((v if sub is None else _only(v, base[k].dataType, sub)).alias(k))
    return F.struct(*got) if got else _empty(base)


def _render(f: Frame, t: Any) -> Column:
    if isinstance(t, str):
        v = f.value(t)
        if v.col is None:
            return F.lit(None).cast("string")
        if parse(t).root == "":
            found = f.element(parse(t).mark)
            return F.struct(*[v.col.getField(n).alias(n) for n in ("gid", "label", "from", "to")], payload(*found).col.alias("data"))
        return v.col
    if isinstance(t, dict):
        return F.struct(*[_render(f, x).alias(k) for k, x in t.items()]) if t else F.lit(None).cast("string")
    if isinstance(t, (list, tuple)):
        return F.struct(*[_render(f, x).alias(f"_{i}") for i, x in enumerate(t)]) if t else F.array().cast("array<string>")
    return F.lit(None).cast("string")


def _assign(f: Frame, key: str, new, shared: bool) -> Frame:
    """Write into x of the element; set also reaches the marks that are the same element."""
    path = parse(key)
    if path.root != "data" or not path.parts:
        # a write to an attribute has no effect
        return f
    own = "cur" if path.mark is None else "m_" + path.mark
    if own not in f.df.columns:
        return f
    name = ".".join(map(str, path.parts))
    kind = f.df.schema[own].dataType
    value = new(f.value(key), kind["x"].dataType[name].dataType)
    x = lambda c: F.when(F.col(c).isNotNull(), F.col(c).withField("x", F.struct(*[(value if n == name else F.col(c).getField("x").getField(n)).alias(n) for n in kind["x"].dataType.names])))
    targets = [own]
    same = f.same
    if shared and (path.mark is None or path.mark in f.same):
        targets = ["cur", *("m_" + m for m in sorted(f.same))]
    elif path.mark is None:
        same = frozenset()
    else:
        same = f.same - {path.mark}
    df = f.df.withColumns({c: x(c) for c in targets})
    return replace(f, df=df, same=same)


# results


def _public(name: str, kind: str, t: T.StructType) -> list[Column]:
    c = F.col(name)
    data = payload(c, t)
    cols = [c.getField("gid").alias("gid"), c.getField("label").alias("label")]
    if kind == "edge":
        cols += [c.getField("from").alias("from"), c.getField("to").alias("to")]
    return [*cols, data.col.alias("data")]


def result(f: Frame) -> DataFrame:
    """The result rows in the shape of the traversal's final type."""
    if f.kind in ("vertex", "edge"):
        return f.df.select(*_public("cur", f.kind, f.df.schema["cur"].dataType))
    if f.kind == "selection":
        return f.df.select(*[F.struct(*_public("m_" + m, f.marks[m], f.df.schema["m_" + m].dataType)).alias(m) for m in f.chosen])
    return f.df


def flat(f: Frame, columns: dict[str, str]) -> DataFrame:
    """One column for each path."""
    if f.kind not in ("vertex", "edge"):
        raise PlanError("only elements have fields")
    got = {name: f.value(path) for name, path in columns.items()}
    return f.df.select(*[(F.lit(None).cast("string") if v.col is None else v.col).alias(n) for n, v in got.items()])


def _plain(x: Any, array: bool = False) -> Any:
    from pyspark.sql import Row
    from pyspark.sql.types import VariantVal

    if isinstance(x, VariantVal):
        return json.loads(x.toJson())
    if isinstance(x, Row):
        names = list(x.__fields__)
        if names and names == [f"_{i}" for i in range(len(names))]:
            return [_plain(v) for v in x]
        return {n: _plain(v) for n, v in zip(names, x)}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


def values(f: Frame) -> list[Any]:
    """The results as plain Python values; a null element is None."""
    out = []
    for row in result(f).collect():
        d = _plain(row)
        if f.kind in ("vertex", "edge"):
            out.append(d if d["gid"] is not None else None)
        elif f.kind == "path":
            out.append([{k: v for k, v in p.items() if v is not None} for p in d["path"]])
        elif f.kind in ("count", "render"):
            out.append(d[f.kind])
        else:
            out.append(d)
    return out
