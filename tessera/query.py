"""Writing requests: `source("orders").where(m("o_totalprice") > 1000).select(key=m("o_orderkey"))`.

A query is immutable; each method gives a longer one. `request()` is the data that an engine runs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from tessera.engine import Engine
from tessera.plans.nodes import E, Node, path
from tessera.plans.validate import required_version


def value(x: Any) -> Node:
    """A projection value: an expression, a nested object (dict with one path) or a collection."""
    if isinstance(x, E):
        return {"$type": "node", "node": x.node}
    return x


def projection(names: tuple[str, ...], named: dict[str, Any]) -> Node:
    plain: list[Any] = [n if "." not in n else {"name": n.rsplit(".", 1)[1], "value": {"$type": "node", "node": {"$type": "member", "path": n.split(".")}}} for n in names]
    return {"members": plain + [{"name": k, "value": value(v)} for k, v in named.items()]}


def nested(link: str, *names: str, **named: Any) -> Node:
    return {"$type": "nested", "path": path(*link.split(".")), "projection": projection(names, named)}


def collection(name: str, *names: str, where: E | None = None, each: E | None = None, **named: Any) -> Node:
    out: Node = {"$type": "collection", "path": path(*name.split("."))} | ({"predicate": where.node} if where else {})
    if each:
        return out | {"selector": each.node}
    return out | ({"projection": projection(names, named)} if names or named else {})


@dataclass(frozen=True)
class Query:
    root: str
    ops: tuple[Node, ...] = ()

    def _and(self, kind: str, /, **parts: Any) -> Query:
        return replace(self, ops=(*self.ops, {"$type": kind} | {k: (v.node if isinstance(v, E) else v) for k, v in parts.items() if v is not None}))

    def request(self) -> dict:
        return {"version": required_version(list(self.ops)), "root": self.root, "pipeline": list(self.ops)}

    def where(self, predicate: E) -> Query:
        return self._and("where", predicate=predicate)

    def order_by(self, by: E, descending: bool = False) -> Query:
        return self._and("orderBy", key=by, descending=descending)

    def then_by(self, by: E, descending: bool = False) -> Query:
        return self._and("thenBy", key=by, descending=descending)

    def reverse(self) -> Query:
        return self._and("reverse")

    def skip(self, n: int) -> Query:
        return self._and("skip", count=n)

    def take(self, n: int) -> Query:
        return self._and("take", count=n)

    def select(self, *names: str, **named: Any) -> Query:
        return self._and("select", projection=projection(names, named))

    def distinct(self) -> Query:
        return self._and("distinct")

    def of_type(self, name: str) -> Query:
        return self._and("ofType", type=name)

    def flatten(self, name: str) -> Query:
        return self._and("selectMany", path=path(*name.split(".")))

    def group_by(self, *by: E) -> Query:
        return self._and("groupBy", keys=[k.node for k in by])

    def _side(self) -> dict:
        if len(self.ops) == 1 and self.ops[0]["$type"] == "where":
            return {"predicate": self.ops[0]["predicate"]}
        return {"ops": list(self.ops)} if self.ops else {}

    def join(self, other: Query, outer: E, inner: E, kind: str = "Inner", **result: Any) -> Query:
        """result: name=("outer", path), ("inner", path) or an aggregate of the inner rows."""
        picks = []
        for name, what in result.items():
            if isinstance(what, E):
                picks.append({"name": name, "side": "Inner", "aggregate": what.node})
            else:
                picks.append({"name": name, "side": what[0].capitalize(), "path": path(*what[1].split("."))})
        side = {"inner" + k.capitalize(): v for k, v in other._side().items()}
        return self._and("join", root=other.root, kind=kind, outerKey=outer, innerKey=inner, result=picks, **side)

    def _set(self, kind: str, other: Query) -> Query:
        *before, chosen = other.ops
        side = {("predicate" if k == "predicate" else "operandOps"): v for k, v in Query(other.root, tuple(before))._side().items()}
        return self._and("set", kind=kind, root=other.root, projection=chosen["projection"], **side)

    def union(self, other: Query) -> Query:
        return self._set("Union", other)

    def concat(self, other: Query) -> Query:
        return self._set("Concat", other)

    def intersect(self, other: Query) -> Query:
        return self._set("Intersect", other)

    def except_(self, other: Query) -> Query:
        return self._set("Except", other)

    # Terminals

    def count(self, predicate: E | None = None, long: bool = False) -> Query:
        return self._and("longCount" if long else "count", predicate=predicate)

    def any(self, predicate: E | None = None) -> Query:
        return self._and("any", predicate=predicate)

    def all(self, predicate: E) -> Query:
        return self._and("all", predicate=predicate)

    def first(self, predicate: E | None = None, or_default: bool = False) -> Query:
        return self._and("first", orDefault=or_default, predicate=predicate)

    def single(self, predicate: E | None = None, or_default: bool = False) -> Query:
        return self._and("single", orDefault=or_default, predicate=predicate)

    def last(self, predicate: E | None = None, or_default: bool = False) -> Query:
        return self._and("last", orDefault=or_default, predicate=predicate)

    def aggregate(self, function: str, selector: E) -> Query:
        return self._and("aggregate", function=function, selector=selector)

    def page(self, size: int | None = None, cursor: str | None = None) -> Query:
        return self._and("page", size=size, cursor=cursor)

    # What unfolds to the above

    def element_at(self, n: int) -> Query:
        return self.skip(n).first()

    def max_by(self, by: E) -> Query:
        return self.order_by(by, True).first(or_default=True)

    def min_by(self, by: E) -> Query:
        return self.order_by(by).first(or_default=True)

    def to_dict(self, engine: Engine, by: str, ctx: dict | None = None) -> dict:
        rows = engine.execute(self.request(), ctx)["rows"]
        out = {r[by]: r for r in rows}
        if len(out) < len(rows):
            raise ValueError(f"{by} repeats")
        return out

    def to_lookup(self, engine: Engine, by: str, ctx: dict | None = None) -> dict[Any, list[dict]]:
        out: dict[Any, list[dict]] = {}
        for r in engine.execute(self.request(), ctx)["rows"]:
            out.setdefault(r[by], []).append(r)
        return out


def source(name: str) -> Query:
    return Query(name)
