"""Traversals written as text: V().hasLabel("a").out().count()."""

from __future__ import annotations

import ast
from typing import Any

from ..errors import PlanError
from ..functions import conditions
from ..plans import steps
from ..plans.steps import Traversal

_CALLS = {n: getattr(conditions, n) for n in ("eq", "neq", "gt", "gte", "lt", "lte", "inside", "outside", "between", "within", "without", "contains", "and_", "or_", "not_")}
_CALLS |= {n: getattr(steps, n) for n in ("term", "histogram", "percentile", "field", "type_", "count")}
_STEPS = {n for n in vars(Traversal) if n[0] != "_" and callable(getattr(Traversal, n))} - {"custom", "to_list", "to_json", "from_json", "to_df", "table", "collect"}


def parse_chain(text: str, graph: Any = None) -> Traversal:
    """Reads the chain without evaluating anything: names of steps and conditions, and literals."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise PlanError(f"can't read the query: {e.msg}") from e
    if not isinstance(tree, ast.Call):
        raise PlanError("a query is a chain of calls")
    return _chain(tree, graph)


def _chain(node: ast.AST, graph: Any) -> Traversal:
    if isinstance(node, ast.Name):
        return Traversal(graph=graph)
    if not isinstance(node, ast.Call):
        raise PlanError("a query is a chain of calls")
    f = node.func
    if isinstance(f, ast.Name):
        base, name = Traversal(graph=graph), f.id
    elif isinstance(f, ast.Attribute):
        base, name = _chain(f.value, graph), f.attr
    else:
        raise PlanError("a query is a chain of calls")
    if name not in _STEPS:
        raise PlanError(f"no step is named {name}")
    return getattr(base, name)(*[_value(a) for a in node.args], **{k.arg: _value(k.value) for k in node.keywords})


def _value(node: ast.AST) -> Any:
    if isinstance(node, ast.Call):
        name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
        if name not in _CALLS:
            raise PlanError(f"no function is named {name}")
        return _CALLS[name](*[_value(a) for a in node.args], **{k.arg: _value(k.value) for k in node.keywords})
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_value(x) for x in node.elts]
    if isinstance(node, ast.Dict):
        return {_value(k): _value(v) for k, v in zip(node.keys, node.values)}
    if isinstance(node, ast.Name) and node.id in ("true", "false", "null", "undefined"):
        return {"true": True, "false": False}.get(node.id)
    try:
        return ast.literal_eval(node)
    except ValueError:
        raise PlanError("arguments are literals") from None
