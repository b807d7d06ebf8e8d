"""Nested selections in GraphQL notation, as one traversal that renders one row for each match."""

from __future__ import annotations

import json
import re
from typing import Any

from ..errors import PlanError
from ..functions import conditions as C
from ..plans.steps import Traversal, count, term

_TOKEN = re.compile(r'\s*(?:#[^\n]*\n\s*)*("(?:[^"\\]|\\.)*"|-?\d+\.\d+|-?\d+|\w+|[{}()\[\]:,!$])')
_OPS = {"=": C.eq, "eq": C.eq, "EQ": C.eq, ">": C.gt, "gt": C.gt, "GT": C.gt, "<": C.lt, "lt": C.lt, "LT": C.lt}
DEFAULT_LIMIT = 100


class _Field:
    def __init__(self, name: str, args: dict[str, Any], fields: list["_Field"]):
        self.name, self.args, self.fields = name, args, fields


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"can't read {text[at:at + 20]!r}")
        out.append(m.group(1))
        at = m.end()
    return [t for t in out if t != ","]


def _value(t: list[str]) -> Any:
    x = t.pop(0)
    if x == "[":
        items = []
        while t[0] != "]":
            items.append(_value(t))
        t.pop(0)
        return items
    if x == "{":
        body = {}
        while t[0] != "}":
            key = t.pop(0)
            t.pop(0)
            body[key.strip('"')] = _value(t)
        t.pop(0)
        return body
    if x[0] == '"':
        return json.loads(x)
    if x in ("true", "false", "null"):
        return {"true": True, "false": False}.get(x)
    return float(x) if "." in x else int(x) if x.lstrip("-").isdigit() else x


def _fields(t: list[str]) -> list[_Field]:
    out = []
    t.pop(0)
    while t[0] != "}":
        name, args, inner = t.pop(0), {}, []
        if t[0] == "(":
            t.pop(0)
            while t[0] != ")":
                key = t.pop(0)
                t.pop(0)
                args[key] = _value(t)
            t.pop(0)
        if t[0] == "{":
            inner = _fields(t)
        out.append(_Field(name, args, inner))
    t.pop(0)
    return out


def parse_selection(text: str) -> list[_Field]:
    t = _tokens(text)
    if t and t[0] == "query":
        while t[0] != "{":
            t.pop(0)
    if not t or t[0] != "{":
        raise PlanError("a selection begins with {")
    try:
        return _fields(t)
    except IndexError:
        raise PlanError("the selection isn't closed") from None


def _filters(t: Traversal, args: dict[str, Any]) -> Traversal:
    for key, v in args.items():
        if key in ("first", "limit", "offset"):
            continue
        if key in ("id", "ids"):
            t = t.hasId(v)
        elif key == "filter":
            t = t.has(_condition(v))
        else:
            t = t.has(C.eq(key, v))
    return t


def _condition(f: dict[str, Any]) -> dict:
    parts = []
    for op, body in f.items():
        if op in ("and", "AND", "or", "OR"):
            inner = [_condition(x) for x in body]
            parts.append(C.and_(*inner) if op.lower() == "and" else C.or_(*inner))
        elif op in _OPS:
            parts += [_OPS[op]("_gid" if k == "id" else k, v) for k, v in body.items()]
        else:
            raise PlanError(f"no filter is named {op}")
    return parts[0] if len(parts) == 1 else C.and_(*parts)


def parse_graphql(text: str, graph: Any = None, hops: dict[tuple[str, str], str] | None = None) -> Traversal:
    """The selection of one vertex label as a traversal.

    hops: for (vertex label, field) the edge label to follow; a field with a
    selection that isn't listed follows the edges of its own name.  One nested
    row comes for each match; a hop without match gives nulls.  _aggregation
    at the top counts, and counts the terms of the listed fields.
    """
    top = parse_selection(text)
    if len(top) != 1:
        raise PlanError("one label is selected at a time")
    root = top[0]
    if root.name.endswith("_aggregation"):
        label = root.name.removesuffix("_aggregation")
        t = _filters(Traversal(graph=graph).V().hasLabel(label), root.args)
        return t.aggregate([count("_totalCount") if f.name == "_totalCount" else term(f.name, f.name) for f in root.fields])
    n = iter(range(1 << 30))
    t = _filters(Traversal(graph=graph).V().hasLabel(root.name), root.args)
    t = t.skip(root.args.get("offset", 0)).limit(root.args.get("first", root.args.get("limit", DEFAULT_LIMIT)))

    def walk(t: Traversal, node: _Field, label: str) -> tuple[Traversal, dict]:
        mark = f"f{next(n)}"
        t = t.as_(mark)
        shape: dict[str, Any] = {}
        for f in node.fields:
            if not f.fields:
                shape[f.name] = f"${mark}._gid" if f.name == "id" else f"${mark}.{f.name}"
        for f in [f for f in node.fields if f.fields]:
            t = t.select(mark).outNull((hops or {}).get((label, f.name), f.name))
            if f.args:
                t = _filters(t, f.args)
            t, shape[f.name] = walk(t, f, f.name)
        return t, shape

    t, shape = walk(t, root, root.name)
    return t.render(shape)
