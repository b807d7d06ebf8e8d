"""Field paths: $mark.name, name.inner, name[1], name[:].inner and the reserved attributes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError

ATTRIBUTES = {"_gid": "gid", "_label": "label", "_from": "from", "_to": "to"}
_PART = re.compile(r"([^.\[\]]+)|\[(-?\d+|:)\]")


@dataclass
class Value:
    """A Column with its type; kind is None for variants, col is None for what no element can have."""

    col: Column | None
    kind: T.DataType | None

    @property
    def variant(self) -> bool:
        return self.col is not None and self.kind is None

    @property
    def exists(self) -> Column:
        """Whether the key is there; a null in a variant is, a null of a typed column is not."""
        return F.lit(False) if self.col is None else self.col.isNotNull()


@dataclass(frozen=True)
class Path:
    mark: str | None
    #: gid, label, from, to, data (the payload) or "" (the whole element)
    root: str
    parts: tuple[str | int, ...]

    @property
    def top(self) -> str | None:
        """The payload field that is read, None for all of it."""
        return str(self.parts[0]) if self.parts else None


def parse(text: str) -> Path:
    mark = None
    rest = text
    if text.startswith("$"):
        mark, _, rest = text[1:].partition(".")
        if mark == "":
            raise PlanError(f"no mark in {text!r}")
        if not rest:
            return Path(mark, "", ())
    parts: list[str | int] = []
    for name, index in _PART.findall(rest):
        parts.append(name if name else ":" if index == ":" else int(index))
    if not parts:
        raise PlanError(f"{text!r} is no field path")
    if parts[0] in ATTRIBUTES:
        return Path(mark, ATTRIBUTES[parts[0]], ())
    if parts[0] == "_data":
        parts = parts[1:]
    return Path(mark, "data", tuple(parts))


def _typed(col: Column, kind: T.DataType, parts: tuple[str | int, ...]) -> Value:
    if not parts:
        return Value(col, kind)
    head, rest = parts[0], parts[1:]
    if isinstance(kind, T.VariantType):
        return variant(col, parts)
    if head == ":":
        return _each(col, kind, rest) if isinstance(kind, T.ArrayType) else Value(None, None)
    if isinstance(head, int):
        return _typed(F.get(col, head), kind.elementType, rest) if isinstance(kind, T.ArrayType) else Value(None, None)
    if isinstance(kind, T.StructType):
        return _typed(col.getField(head), kind[head].dataType, rest) if head in kind.names else Value(None, None)
    if isinstance(kind, T.MapType):
        return _typed(F.try_element_at(col, F.lit(head)), kind.valueType, rest)
    if isinstance(kind, T.ArrayType):
        return _each(col, kind, parts)
    return Value(None, None)


def _each(col: Column, kind: T.ArrayType, parts: tuple[str | int, ...]) -> Value:
    inner = _typed(F.lit(None), kind.elementType, parts)
    if inner.col is None and parts:
        return Value(None, None)
    return Value(F.transform(col, lambda x: _typed(x, kind.elementType, parts).col), T.ArrayType(inner.kind or T.VariantType()))


def _json_path(parts: tuple[str | int, ...]) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parts)


def variant(col: Column, parts: tuple[str | int, ...]) -> Value:
    """The variant at the path; a name below an array collects it from all items."""
    if ":" in parts:
        at = parts.index(":")
        items = F.try_variant_get(col, _json_path(parts[:at]), "array<variant>")
        return Value(_collected(items, parts[at + 1 :]), None)
    direct = F.try_variant_get(col, _json_path(parts), "variant") if parts else col
    options = [direct]
    for i in range(1, len(parts)):
        if not isinstance(parts[i], int):
            options.append(_collected(F.try_variant_get(col, _json_path(parts[:i]), "array<variant>"), parts[i:]))
    return Value(F.coalesce(*options) if len(options) > 1 else direct, None)


def _collected(items: Column, parts: tuple[str | int, ...]) -> Column:
    return F.to_variant_object(F.transform(items, lambda x: variant(x, parts).col) if parts else items)


def resolve(path: Path, element: Column, kind: T.StructType, payload: Column | None = None) -> Value:
    """The value of a path in an element of the given struct type; payload has the step-assigned values already."""
    if path.root == "":
        return Value(element, kind)
    if path.root != "data":
        value = element.getField(path.root)
        # a null element answers with empty attributes
        return Value(F.coalesce(value, F.lit("")), T.StringType())
    extra = kind["x"].dataType
    key = _key(path.parts)
    if key in extra.names:
        own, base = element.getField("x").getField(key), _typed(element.getField("data"), kind["data"].dataType, path.parts)
        if base.col is None:
            return Value(own, extra[key].dataType)
        if base.variant:
            return Value(F.coalesce(own.cast("variant"), base.col), None)
        return Value(F.coalesce(own.cast(base.kind), base.col), base.kind)
    data = element.getField("data") if payload is None else payload
    return _typed(data, kind["data"].dataType, path.parts)


def _key(parts: tuple[str | int, ...]) -> str:
    return ".".join(map(str, parts))
