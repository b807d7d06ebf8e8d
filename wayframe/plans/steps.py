"""Traversal builder.  A step is one (name, value) pair of the JSON wire form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from ..errors import PlanError

Step = tuple[str, Any]

START = {"v", "e"}
HOPS = {"in", "out", "both", "inE", "outE", "bothE", "inNull", "outNull", "inENull", "outENull"}
OTHER = {"as", "select", "limit", "skip", "range", "has", "hasLabel", "hasKey", "hasId", "distinct", "fields", "unwind", "count", "aggregate", "render", "path", "mark", "jump", "set", "increment", "custom"}


def _flat(args: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    for a in args:
        if a is None:
            continue
        out.extend(a) if isinstance(a, (list, tuple, set)) else out.append(a)
    return out


class Traversal:
    """An immutable list of steps; bound to a graph if it has one."""

    def __init__(self, steps: Iterable[Step] = (), graph: Any = None):
        self.steps: tuple[Step, ...] = tuple(steps)
        self.graph = graph

    def _add(self, name: str, value: Any) -> "Traversal":
        return Traversal((*self.steps, (name, value)), self.graph)

    # where it starts
    def V(self, *ids):
        return self._add("v", _flat(ids))

    def E(self, *ids):
        return self._add("e", _flat(ids))

    # hops
    def out(self, *labels):
        return self._add("out", _flat(labels))

    def in_(self, *labels):
        return self._add("in", _flat(labels))

    def both(self, *labels):
        return self._add("both", _flat(labels))

    def outE(self, *labels):
        return self._add("outE", _flat(labels))

    def inE(self, *labels):
        return self._add("inE", _flat(labels))

    def bothE(self, *labels):
        return self._add("bothE", _flat(labels))

    def outNull(self, *labels):
        return self._add("outNull", _flat(labels))

    def inNull(self, *labels):
        return self._add("inNull", _flat(labels))

    def outENull(self, *labels):
        return self._add("outENull", _flat(labels))

    def inENull(self, *labels):
        return self._add("inENull", _flat(labels))

    outV, inV, bothV = out, in_, both

    # filters
    def has(self, expr: dict):
        return self._add("has", expr)

    def hasLabel(self, *labels):
        return self._add("hasLabel", _flat(labels))

    def hasId(self, *ids):
        return self._add("hasId", _flat(ids))

    def hasKey(self, *keys):
        return self._add("hasKey", _flat(keys))

    # shape
    def as_(self, name: str):
        return self._add("as", name)

    def select(self, *marks):
        return self._add("select", {"marks": _flat(marks)})

    def fields(self, *names):
        return self._add("fields", _flat(names))

    def render(self, template: Any):
        return self._add("render", template)

    def path(self):
        return self._add("path", [])

    def unwind(self, field: str):
        return self._add("unwind", field)

    def set(self, key: str, value: Any):
        return self._add("set", {"key": key, "value": value})

    def increment(self, key: str, value: int = 1):
        return self._add("increment", {"key": key, "value": value})

    # how many
    def distinct(self, *paths):
        return self._add("distinct", _flat(paths))

    def limit(self, n: int):
        return self._add("limit", n)

    def skip(self, n: int):
        return self._add("skip", n)

    def range(self, start: int, stop: int):
        return self._add("range", {"start": start, "stop": stop})

    def count(self):
        return self._add("count", "")

    def aggregate(self, *aggs):
        return self._add("aggregate", {"aggregations": _flat(aggs)})

    # loops
    def mark(self, name: str):
        return self._add("mark", name)

    def jump(self, mark: str, expr: dict | None = None, emit: bool = False):
        return self._add("jump", {"mark": mark, "expression": expr, "emit": emit})

    def custom(self, fn: Callable):
        """Apply fn to the DataFrame of travelers; it must keep their columns."""
        return self._add("custom", fn)

    # wire form
    def to_list(self) -> list[dict]:
        return [{k: v} for k, v in self.steps]

    def to_json(self) -> str:
        return json.dumps({"query": self.to_list()})

    @classmethod
    def from_json(cls, text: str | dict | list, graph: Any = None) -> "Traversal":
        body = json.loads(text) if isinstance(text, str) else text
        items = body.get("query", []) if isinstance(body, dict) else body
        steps: list[Step] = []
        for item in items:
            if len(item) != 1:
                raise PlanError(f"a statement has one key, not {sorted(item)}")
            name, value = next(iter(item.items()))
            first, *rest = name.split("_")
            name = first + "".join({"e": "E"}.get(x, x[:1].upper() + x[1:]) for x in rest)
            if name not in START | HOPS | OTHER:
                raise PlanError(f"no step is named {name}")
            steps.append((name, value))
        return cls(steps, graph)

    # results
    def _bound(self):
        if self.graph is None:
            raise PlanError("this traversal belongs to no graph")
        return self.graph

    def to_df(self, stable: bool = False):
        from .compiler import compile_steps, result

        return result(compile_steps(self._bound(), self.steps, stable=stable))

    def table(self, stable: bool = False, /, **columns: str):
        """The values at the given field paths as flat columns."""
        from .compiler import compile_steps, flat

        return flat(compile_steps(self._bound(), self.steps, stable=stable, uses=tuple(columns.values())), columns)

    def collect(self, stable: bool = False) -> list[Any]:
        from .compiler import compile_steps, values

        return values(compile_steps(self._bound(), self.steps, stable=stable))

    def __iter__(self):
        return iter(self.collect())


#: A traversal without a graph.
__ = Traversal()


# aggregations
def term(name: str, field: str, size: int | None = None) -> dict:
    return {"name": name, "term": {"field": field, "size": size}}


def histogram(name: str, field: str, interval: float) -> dict:
    return {"name": name, "histogram": {"field": field, "interval": interval}}


def percentile(name: str, field: str, percents: Iterable[float] = (1, 5, 25, 50, 75, 95, 99), approximate: bool = False) -> dict:
    return {"name": name, "percentile": {"field": field, "percents": list(percents), "approximate": approximate}}


def field(name: str, path: str) -> dict:
    return {"name": name, "field": {"field": path}}


def type_(name: str, path: str) -> dict:
    return {"name": name, "type": {"field": path}}


def count(name: str) -> dict:
    return {"name": name, "count": {}}
