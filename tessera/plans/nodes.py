"""Expressions as data: what a request's filters, keys and projections are made of, and sugar to write them.

A node is a dictionary with `$type`; `E` wraps one so that Python's operators build larger ones.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from typing import Any

Node = dict[str, Any]


def path(*names: str) -> str | list[str]:
    return names[0] if len(names) == 1 else list(names)


def segments(value: str | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def key_of(node: Any) -> str:
    """Equal for structurally equal nodes."""
    return json.dumps(node, sort_keys=True)


def const(value: Any) -> Node:
    if isinstance(value, E):
        return value.node
    tags: list[tuple[type, str]] = [(bool, "Boolean"), (int, "Int64"), (float, "Double"), (Decimal, "Decimal"), (str, "String"), (dt.datetime, "DateTime"), (dt.date, "DateOnly"), (bytes, "Bytes")]
    if value is None:
        return {"$type": "const", "tag": "Null"}
    tag = next((t for k, t in tags if isinstance(value, k)), None)
    if tag is None:
        raise TypeError(f"no constant can hold {value!r}")
    if tag == "Int64" and -(2**31) <= value < 2**31:
        tag = "Int32"
    text = {"Boolean": lambda: "true" if value else "false", "DateTime": lambda: value.isoformat(), "DateOnly": lambda: value.isoformat(), "Bytes": lambda: __import__("base64").b64encode(value).decode()}.get(tag, lambda: repr(value) if tag == "Double" else str(value))()
    return {"$type": "const", "value": text, "tag": tag}


def _binary(op: str, swapped: bool = False):
    def build(self: E, other: Any) -> E:
        a, b = (const(other), self.node) if swapped else (self.node, const(other))
        return E({"$type": "binary", "op": op, "left": a, "right": b})

    return build


class E:
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, node: Node) -> None:
        self.node = node

    __eq__ = _binary("Equal")  # type: ignore[assignment]
    __ne__ = _binary("NotEqual")  # type: ignore[assignment]
    __lt__ = _binary("LessThan")
    __le__ = _binary("LessThanOrEqual")
    __gt__ = _binary("GreaterThan")
    __ge__ = _binary("GreaterThanOrEqual")
    __and__ = _binary("AndAlso")
    __or__ = _binary("OrElse")
    __add__ = _binary("Add")
    __radd__ = _binary("Add", True)
    __sub__ = _binary("Subtract")
    __rsub__ = _binary("Subtract", True)
    __mul__ = _binary("Multiply")
    __rmul__ = _binary("Multiply", True)
    __truediv__ = _binary("Divide")
    __rtruediv__ = _binary("Divide", True)
    __mod__ = _binary("Modulo")
    coalesce = _binary("Coalesce")

    def __invert__(self) -> E:
        return E({"$type": "unary", "op": "Not", "operand": self.node})

    def __neg__(self) -> E:
        return E({"$type": "unary", "op": "Negate", "operand": self.node})

    def call(self, function: str, *args: Any) -> E:
        return E({"$type": "call", "function": function, "target": self.node, "arguments": [const(a) for a in args]})

    def is_in(self, *values: Any) -> E:
        return self.call("In", *values)

    def in_source(self, root: str, selector: E, predicate: E | None = None) -> E:
        return E({"$type": "inSource", "value": self.node, "root": root, "selector": selector.node} | ({"predicate": predicate.node} if predicate else {}))

    def collate(self, match: str) -> E:
        return E({"$type": "collate", "target": self.node, "match": match})


def m(*names: str) -> E:
    """A member, by its path; dots part the names."""
    return E({"$type": "member", "path": path(*[p for n in names for p in n.split(".")])})


def element() -> E:
    return E({"$type": "element"})


def case(test: E, yes: Any, no: Any) -> E:
    return E({"$type": "conditional", "test": test.node, "ifTrue": const(yes), "ifFalse": const(no)})


def agg(function: str, selector: E | None = None, where: E | None = None, distinct: bool = False, separator: str | None = None) -> E:
    node: Node = {"$type": "aggregate", "function": function}
    node |= {"selector": selector.node} if selector else {}
    node |= {"separator": separator} if separator is not None else {}
    node |= {"predicate": where.node} if where else {}
    return E(node | ({"distinct": True} if distinct else {}))


def key(index: int) -> E:
    return E({"$type": "groupKey", "index": index})


def ask(function: str, collection: str, selector: E | None = None, where: E | None = None) -> E:
    """A question about a collection: Any, All, Count, Sum, Average, Min or Max."""
    node: Node = {"$type": "subquery", "path": path(*collection.split(".")), "function": function}
    return E(node | ({"predicate": where.node} if where else {}) | ({"selector": selector.node} if selector else {}))


def keys(*parts: E) -> E:
    return parts[0] if len(parts) == 1 else E({"$type": "compositeKey", "parts": [p.node for p in parts]})
