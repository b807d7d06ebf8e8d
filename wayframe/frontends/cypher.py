"""A small part of Cypher: MATCH patterns with labels, properties, WHERE equality, RETURN."""

from __future__ import annotations

import re
from typing import Any

from ..errors import PlanError
from ..functions import conditions as C
from ..plans.steps import Traversal

_TOKEN = re.compile(r"\s*(<-|->|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|-?\d+\.\d+|-?\d+|\w+|<>|<=|>=|[-()\[\]{}:,.=<>*])")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"can't read {text[at:at + 20]!r}")
        out.append(m.group(1))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want and got.upper() != want:
            raise PlanError(f"{want or 'more'} expected, not {got or 'the end'}")
        self.i += 1
        return got

    def try_(self, want: str) -> bool:
        if self.peek().upper() == want:
            self.i += 1
            return True
        return False

    def literal(self) -> Any:
        x = self.take()
        if x[0] in "'\"":
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        if x.lower() in ("true", "false", "null"):
            return {"true": True, "false": False}.get(x.lower())
        return float(x) if "." in x else int(x)

    def inner(self, close: str) -> tuple[str, list[str], dict[str, Any]]:
        """name, labels and properties up to the closing bracket."""
        name = self.take() if re.match(r"\w", self.peek()) else ""
        labels, props = [], {}
        while self.try_(":"):
            labels.append(self.take())
        if self.try_("{"):
            while not self.try_("}"):
                key = self.take()
                self.take(":")
                props[key] = self.literal()
                self.try_(",")
        self.take(close)
        return name, labels, props


_OPS = {"=": C.eq, "<>": C.neq, "<": C.lt, "<=": C.lte, ">": C.gt, ">=": C.gte}


def parse_cypher(text: str, graph: Any = None) -> Traversal:
    """A linear pattern as a traversal; each named node is marked, and RETURN renders."""
    r = _Reader(text)
    r.take("MATCH")
    t = Traversal(graph=graph).V()
    names: set[str] = set()

    def node(t: Traversal) -> Traversal:
        r.take("(")
        name, labels, props = r.inner(")")
        if labels:
            t = t.hasLabel(labels)
        for k, v in props.items():
            t = t.has(C.eq(k, v))
        if name:
            names.add(name)
            t = t.as_(name)
        return t

    t = node(t)
    while r.peek() in ("-", "<-"):
        back = r.take() == "<-"
        labels: list[str] = []
        name = ""
        props: dict[str, Any] = {}
        if r.try_("["):
            name, labels, props = r.inner("]")
        end = r.take()
        if end not in ("-", "->") or back and end == "->":
            raise PlanError("this kind of relation isn't read")
        if name or props:
            t = t.inE(labels) if back else t.outE(labels) if end == "->" else t.bothE(labels)
            for k, v in props.items():
                t = t.has(C.eq(k, v))
            if name:
                names.add(name)
                t = t.as_(name)
            if not back and end == "-":
                raise PlanError("a named relation needs a direction")
            t = t.in_() if back else t.out()
        else:
            t = t.in_(labels) if back else t.out(labels) if end == "->" else t.both(labels)
        t = node(t)
    if r.try_("WHERE"):
        parts = []
        while True:
            name = r.take()
            r.take(".")
            key, op = r.take(), r.take()
            if op not in _OPS or name not in names:
                raise PlanError(f"can't read the condition on {name}.{key}")
            parts.append(_OPS[op](f"${name}.{key}", r.literal()))
            if not r.try_("AND"):
                break
        t = t.has(C.and_(*parts))
    r.take("RETURN")
    items: dict[str, str] = {}
    while True:
        name = r.take()
        if name not in names:
            raise PlanError(f"{name} isn't bound")
        path, alias = f"${name}._data", name
        if r.try_("."):
            key = r.take()
            path, alias = f"${name}.{key}", f"{name}.{key}"
        if r.try_("AS"):
            alias = r.take()
        items[alias] = path
        if not r.try_(","):
            break
    limit = int(r.take()) if r.try_("LIMIT") else None
    if r.peek():
        raise PlanError(f"{r.peek()} wasn't expected")
    t = t.limit(limit) if limit is not None else t
    return t.render(next(iter(items.values())) if len(items) == 1 else items)
