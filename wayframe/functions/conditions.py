"""Conditions of has: builders for the wire form, and their two-valued Columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from .paths import Value


def _condition(kind: str) -> Callable[[str, Any], dict]:
    def make(key: str, value: Any) -> dict:
        return {"condition": {"key": key, "value": value, "condition": kind}}

    return make


eq, neq, gt, gte, lt, lte = (_condition(k) for k in ("EQ", "NEQ", "GT", "GTE", "LT", "LTE"))
contains = _condition("CONTAINS")


def _ends(kind: str) -> Callable[..., dict]:
    def make(key: str, low: float, high: float) -> dict:
        return _condition(kind)(key, [low, high])

    return make


inside, outside, between = _ends("INSIDE"), _ends("OUTSIDE"), _ends("BETWEEN")


def within(key: str, values: Any) -> dict:
    return _condition("WITHIN")(key, list(values) if isinstance(values, (list, tuple, set)) else [values])


def without(key: str, values: Any) -> dict:
    return _condition("WITHOUT")(key, list(values) if isinstance(values, (list, tuple, set)) else [values])


def and_(*parts: dict) -> dict:
    return {"and": {"expressions": list(parts)}}


def or_(*parts: dict) -> dict:
    return {"or": {"expressions": list(parts)}}


def not_(part: dict) -> dict:
    return {"not": part}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bare(c: Column) -> Column:
    return c


def equals(v: Value, literal: Any, exact: bool = True) -> Column:
    """Equality without coercion between kinds; null equals null and what is missing.

    exact: never null; else null may stand for false, which lets a filter reach the scan.
    """
    sure = _sure if exact else _bare
    if v.col is None:
        return F.lit(literal is None)
    if v.variant:
        tag = F.schema_of_variant(v.col)
        if literal is None:
            return v.col.isNull() | F.is_variant_null(v.col)
        if isinstance(literal, bool):
            return sure((tag == "BOOLEAN") & (F.try_variant_get(v.col, "$", "boolean") == literal))
        if isinstance(literal, (int, float)):
            return sure(tag.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)") & (F.try_variant_get(v.col, "$", "double") == float(literal)))
        if isinstance(literal, str):
            return sure((tag == "STRING") & (F.try_variant_get(v.col, "$", "string") == literal))
        text = json.dumps(literal, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return sure(F.to_json(v.col) == text)
    kind = v.kind
    if literal is None:
        return v.col.isNull()
    if isinstance(literal, bool):
        return sure(v.col == literal) if isinstance(kind, T.BooleanType) else F.lit(False)
    if isinstance(literal, (int, float)):
        return sure(v.col == F.lit(literal)) if isinstance(kind, T.NumericType) else F.lit(False)
    if isinstance(literal, str):
        if isinstance(kind, T.StringType):
            return sure(v.col == literal)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return sure(v.col == F.lit(literal).cast(kind))
        return F.lit(False)
    if isinstance(literal, list) and isinstance(kind, T.ArrayType):
        return sure(v.col == F.array(*[F.lit(x) for x in literal]).cast(kind))
    if isinstance(literal, dict) and isinstance(kind, T.StructType):
        return sure(F.to_json(v.col) == F.to_json(F.from_json(F.lit(json.dumps(literal)), kind)))
    return F.lit(False)


def number(v: Value) -> Column:
    """The value as a double; numeric strings and booleans count, anything else is null."""
    if v.col is None:
        return F.lit(None).cast("double")
    if v.variant:
        return F.try_variant_get(v.col, "$", "double")
    if isinstance(v.kind, (T.NumericType, T.BooleanType)):
        return v.col.cast("double")
    return v.col.try_cast("double") if isinstance(v.kind, T.StringType) else F.lit(None).cast("double")


def _in_order(op: Callable[[Column, Any], Column], v: Value, limit: Any, exact: bool) -> Column:
    sure = _sure if exact else _bare
    if isinstance(limit, str) and isinstance(v.kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return sure(op(v.col, F.lit(limit).cast(v.kind)))
    try:
        limit = float(limit)
    except (TypeError, ValueError):
        return F.lit(False)
    if isinstance(v.kind, T.NumericType):
        return sure(op(v.col, F.lit(limit)))
    return sure(op(number(v), limit))


_ORDER: dict[str, Callable[[Any, Any], Any]] = {"GT": lambda x, y: x > y, "GTE": lambda x, y: x >= y, "LT": lambda x, y: x < y, "LTE": lambda x, y: x <= y}
_BOUNDS = {"INSIDE": ("GT", "LT"), "BETWEEN": ("GTE", "LT"), "OUTSIDE": ("LT", "GT")}


def compare(kind: str, v: Value, value: Any, exact: bool = True) -> Column:
    if kind == "EQ":
        return equals(v, value, exact)
    if kind == "NEQ":
        return ~equals(v, value)
    if kind in _ORDER:
        return _in_order(_ORDER[kind], v, value, exact)
    if kind in _BOUNDS:
        if not isinstance(value, list) or len(value) != 2:
            return F.lit(False)
        low, high = (_in_order(_ORDER[op], v, x, exact) for op, x in zip(_BOUNDS[kind], value))
        return low | high if kind == "OUTSIDE" else low & high
    if kind == "WITHIN":
        return _any_of(v, value or [], exact)
    if kind == "WITHOUT":
        return ~_any_of(v, value or [], True)
    if kind == "CONTAINS":
        if v.col is None:
            return F.lit(False)
        if v.variant:
            items = F.try_variant_get(v.col, "$", "array<variant>")
            return _sure(F.exists(items, lambda x: equals(Value(x, None), value)))
        if isinstance(v.kind, T.ArrayType):
            return _sure(F.exists(v.col, lambda x: equals(Value(x, v.kind.elementType), value)))
        return F.lit(False)
    raise PlanError(f"no condition is named {kind}")


def _any_of(v: Value, values: list, exact: bool) -> Column:
    """isin for one kind of literal that the column has, so that it reaches the scan."""
    sure = _sure if exact else _bare
    if v.col is not None and not v.variant and values:
        if isinstance(v.kind, T.StringType) and all(isinstance(x, str) for x in values):
            return sure(v.col.isin(values))
        if isinstance(v.kind, T.NumericType) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
            return sure(v.col.isin(values))
    out = F.lit(False)
    for x in values:
        out = out | equals(v, x, exact)
    return out


def build(expr: dict, lookup: Callable[[str], Value], exact: bool = False) -> Column:
    """The Column of a has expression, to filter by; where a not is above, it is never null."""
    if len(expr) != 1:
        raise PlanError(f"an expression has one key, not {sorted(expr)}")
    name, body = next(iter(expr.items()))
    if name == "condition":
        return compare(body["condition"], lookup(body["key"]), body.get("value"), exact)
    if name in ("and", "or"):
        out = F.lit(name == "and")
        for part in body["expressions"] if isinstance(body, dict) else body:
            out = out & build(part, lookup, exact) if name == "and" else out | build(part, lookup, exact)
        return out
    if name == "not":
        return ~build(body, lookup, True)
    raise PlanError(f"no expression is named {name}")


def keys_in(expr: dict | None) -> list[str]:
    """The field paths that an expression reads."""
    if not expr:
        return []
    name, body = next(iter(expr.items()))
    if name == "condition":
        return [body["key"]]
    if name == "not":
        return keys_in(body)
    return [k for part in (body["expressions"] if isinstance(body, dict) else body) for k in keys_in(part)]
