"""What a request may be: strict shapes, the order of operators, and limits, all checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.errors import TooLarge, ValidationError, WireFormatError
from tessera.operators.pipeline import FOLDS, PICKS
from tessera.operators.scope import MAX_HOPS, members
from tessera.plans.nodes import Node, segments


@dataclass(frozen=True)
class Limits:
    page_size: int = 1000
    default_page: int = 100
    pipeline: int = 32
    depth: int = 32
    nodes: int = 4096
    questions: int = 64
    projected: int = 256
    in_values: int = 1000
    batch: int = 20
    parts: int = 8  # group keys, key parts, members of distinct and set rows
    stream_rows: int | None = None
    held_rows: int = 10_000  # of a list answer on the driver; a longer one is read as it is used
    response_bytes: int | None = None  # of a list answer or a stream


#: Fixed shapes: the properties that an element has, and which of them must be there.
OPS = {
    "where": ({"predicate"}, set()), "orderBy": ({"key"}, {"descending"}), "thenBy": ({"key"}, {"descending"}), "skip": ({"count"}, set()), "take": ({"count"}, set()),
    "select": ({"projection"}, set()), "selectMany": ({"path"}, set()), "ofType": ({"type"}, set()), "groupBy": ({"keys"}, set()), "distinct": (set(), set()), "reverse": (set(), set()),
    "join": ({"root", "kind", "outerKey", "innerKey", "result"}, {"innerPredicate", "innerOps"}), "set": ({"kind", "root", "projection"}, {"predicate", "operandOps"}),
    "count": (set(), {"predicate"}), "longCount": (set(), {"predicate"}), "any": (set(), {"predicate"}), "all": ({"predicate"}, set()), "first": (set(), {"orDefault", "predicate"}), "single": (set(), {"orDefault", "predicate"}), "last": (set(), {"orDefault", "predicate"}),
    "aggregate": ({"function", "selector"}, set()), "page": (set(), {"size", "cursor"}),
}
NODES = {
    "member": ({"path"}, set()), "element": (set(), set()), "const": ({"tag"}, {"value"}), "binary": ({"op", "left", "right"}, set()), "unary": ({"op", "operand"}, set()), "call": ({"function", "target"}, {"arguments"}),
    "conditional": ({"test", "ifTrue", "ifFalse"}, set()), "subquery": ({"path", "function"}, {"predicate", "selector"}), "collate": ({"target", "match"}, set()), "inSource": ({"value", "root", "selector"}, {"predicate"}),
    "aggregate": ({"function"}, {"selector", "separator", "predicate", "distinct"}), "groupKey": ({"index"}, set()), "compositeKey": ({"parts"}, set()),
}
VALUES = {"node": ({"node"}, set()), "nested": ({"path", "projection"}, set()), "collection": ({"path"}, {"predicate", "selector", "projection"})}
TERMINALS = (*FOLDS, *PICKS, "page")
ORDERING = ("orderBy", "thenBy")


def _shape(x: object, shapes: dict) -> None:
    if not isinstance(x, dict) or x.get("$type") not in shapes:
        raise WireFormatError(f"no element {x!r:.80}")
    need, may = shapes[x["$type"]]
    given = {k for k in x if k != "$type"}
    if given - need - may or need - given:
        raise WireFormatError(f"{x['$type']} has {sorted(given)}; it takes {sorted(need)} and may take {sorted(may)}")
    if any(v is None for v in x.values()):
        raise WireFormatError(f"{x['$type']}: null is written by leaving a property out")


class Checker:
    def __init__(self, limits: Limits) -> None:
        self.limits, self.count, self.questions = limits, 0, 0

    def node(self, x: Node, depth: int = 1, question: bool = False, grouped: bool = False) -> bool:
        """Checks an expression; true if it reads a member of the row."""
        _shape(x, NODES)
        self.count += 1
        if depth > self.limits.depth or self.count > self.limits.nodes:
            raise ValidationError("the expression is too large")
        kind = x["$type"]
        if kind == "member":
            names = segments(x["path"])
            if isinstance(x["path"], list) and len(names) == 1:
                raise WireFormatError("a path of one name is written as that name")
            if not names or len(names) > MAX_HOPS + 2:
                raise ValidationError("the path is too long")
            return True
        if kind in ("element", "groupKey"):
            return True
        if kind == "call" and x["function"] == "In" and len(x.get("arguments", [])) > self.limits.in_values:
            raise ValidationError(f"In takes {self.limits.in_values} values at most")
        if kind in ("subquery", "inSource"):
            self.questions += 1
            if question:
                raise ValidationError(f"a {kind} does not nest")
            if self.questions > self.limits.questions:
                raise ValidationError("too many questions")
        if kind == "aggregate" and not grouped:
            raise ValidationError("an aggregate needs a group")
        inside = question or kind in ("subquery", "inSource")
        own = [v for k, v in x.items() if k in ("left", "right", "operand", "target", "test", "ifTrue", "ifFalse", "value", "selector", "predicate") and isinstance(v, dict)]
        read = [self.node(c, depth + 1, inside, grouped and kind != "aggregate") for c in [*own, *x.get("arguments", []), *x.get("parts", [])]]
        return any(read) or kind in ("subquery", "aggregate")

    def projection(self, x: Node, level: int = 0, grouped: bool = False) -> int:
        if not isinstance(x, dict) or set(x) != {"members"} or not x["members"]:
            raise WireFormatError("a projection has members")
        names, total = set(), 0
        for name, v in members(x):
            if name.lower() in names:  # Spark's names differ by more than case
                raise ValidationError(f"{name} is projected twice")
            names.add(name.lower())
            _shape(v, VALUES)
            if v["$type"] == "node":
                total += 1
                if not self.node(v["node"], grouped=grouped):
                    raise ValidationError(f"{name} reads no member of the row")
            elif v["$type"] == "nested":
                if level >= MAX_HOPS:
                    raise ValidationError("the projection nests too deep")
                total += self.projection(v["projection"], level + 1)
            else:
                if level:
                    raise ValidationError("a collection is projected at the top only")
                if v.get("predicate"):
                    self.node(v["predicate"], question=True)
                if v.get("selector"):
                    self.node(v["selector"], question=True)
                total += self.projection(v["projection"], level + 1) if v.get("projection") else 1
        if total > self.limits.projected:
            raise ValidationError(f"a projection has {self.limits.projected} members at most")
        return total


def validate(request: dict, limits: Limits = Limits()) -> None:  # noqa: B008, C901, PLR0912
    if not isinstance(request, dict) or not {"version", "root", "pipeline"} <= set(request) <= {"version", "root", "pipeline", "stamp"}:
        raise WireFormatError("a request has version, root and pipeline")
    if request["version"] not in (1, 2):
        raise WireFormatError(f"no version {request['version']}")
    ops = request["pipeline"]
    if len(ops) > limits.pipeline:
        raise TooLarge(f"a pipeline has {limits.pipeline} operators at most")
    check = Checker(limits)
    done: set[str] = set()
    ordered = False
    width = 0

    def refuse(why: bool, text: str) -> None:
        if why:
            raise ValidationError(text)

    for op in ops:
        _shape(op, OPS)
        kind = op["$type"]
        refuse(bool(done & set(TERMINALS)), "nothing comes after a terminal")
        if "join" in done:
            refuse(kind not in ("count", "longCount", "any", "first", "single") or "predicate" in op, f"{kind} does not follow a join")
        if "set" in done:
            refuse(kind not in ("count", "longCount", "any") or "predicate" in op, f"{kind} does not follow a set operation")
        if "groupBy" in done:
            refuse(kind in (*ORDERING, "skip", "take", "reverse", "last", "page", "ofType", "selectMany", "join", "set", "groupBy", "aggregate", "distinct"), f"{kind} does not follow groupBy")
            refuse("select" not in done and kind not in ("where", "select"), "groupBy is followed by select")
        if "select" in done:
            refuse(kind in ("where", "ofType", "selectMany", "groupBy", "join", "select", "aggregate"), f"{kind} does not follow select")
            refuse(kind in ORDERING and "distinct" not in done, f"{kind} follows select only after distinct")
            refuse(kind in TERMINALS and "predicate" in op, f"{kind} takes no predicate after select")
        if "distinct" in done:
            refuse(kind in ("distinct", "all", "page", "set", "aggregate"), f"{kind} does not follow distinct")
            refuse(kind == "thenBy" and not ordered, "thenBy follows orderBy")
            refuse(kind in ORDERING and width > limits.parts, f"rows of {limits.parts} members at most are ordered after distinct")
        if kind == "thenBy":
            refuse(not ordered, "thenBy follows orderBy")
        if kind in ("skip", "take", "reverse", "last", "page"):
            refuse(not ordered, f"{kind} needs an order")
        if kind in ("skip", "take"):
            n = op["count"]
            refuse(not isinstance(n, int) or n < 0, f"{kind} takes a count")
            refuse(kind == "take" and n > limits.page_size, f"take gives {limits.page_size} rows at most")
        if kind == "page":
            refuse(op.get("size") is not None and op["size"] < 1, "a page has rows")
        if kind == "where":
            check.node(op["predicate"], grouped="groupBy" in done)
        elif kind in ORDERING:
            check.node(op["key"])
            ordered = True
        elif kind == "select":
            width = check.projection(op["projection"], grouped="groupBy" in done)
        elif kind == "groupBy":
            refuse(not 1 <= len(op["keys"]) <= limits.parts, f"a group has 1 to {limits.parts} keys")
            for k in op["keys"]:
                refuse(not check.node(k), "a group key reads a member")
        elif kind == "join":
            for k in ("outerKey", "innerKey"):
                parts = op[k].get("parts", [op[k]])
                refuse(op[k]["$type"] == "compositeKey" and not 2 <= len(parts) <= limits.parts, f"a key has 2 to {limits.parts} parts")
                for p in parts:
                    check.node(p)
            narrowed = done & {"where", "ofType", "skip", "take"}
            refuse(op["kind"] == "Right" and bool(narrowed), "the outer side of a right join is not narrowed")
            refuse(bool({"innerPredicate", "innerOps"} <= set(op)), "a side has a predicate or operators")
            _side(op.get("innerOps", []), check, refuse)
        elif kind == "set":
            refuse("select" not in done, "a set operation needs a projection")
            refuse(max(width, check.projection(op["projection"])) > limits.parts, f"set rows have {limits.parts} members at most")
            _side(op.get("operandOps", []), check, refuse)
        elif kind in ("distinct", "selectMany"):
            ordered = False
        elif kind == "aggregate":
            check.node(op["selector"])
        if op.get("predicate") and kind != "where":
            check.node(op["predicate"])
        if kind == "selectMany":
            refuse("selectMany" in done, "a query flattens once")
        done.add(kind)
    refuse("groupBy" in done and "select" not in done, "groupBy is followed by select")


def _side(ops: list[Node], check: Checker, refuse) -> None:
    ordered = bounded = False
    for x in ops:
        _shape(x, OPS)
        kind = x["$type"]
        refuse(kind not in ("where", "ofType", *ORDERING, "skip", "take"), f"a side takes no {kind}")
        refuse(kind in ("skip", "take") and not ordered, f"{kind} needs an order")
        ordered |= kind in ORDERING
        bounded |= kind in ("skip", "take")
        if kind == "where":
            check.node(x["predicate"])
        if kind in ORDERING:
            check.node(x["key"])
    refuse(ordered and not bounded, "an order on a side is bounded by skip or take")


def required_version(ops: list[Node]) -> int:
    """2 where a side has operators, or an aggregate is filtered or distinct; else 1."""

    def newer(x: object) -> bool:
        if isinstance(x, list):
            return any(map(newer, x))
        if not isinstance(x, dict):
            return False
        if x.get("innerOps") or x.get("operandOps") or x.get("$type") == "aggregate" and ("distinct" in x or "predicate" in x):
            return True
        return any(map(newer, x.values()))

    return 2 if newer(ops) else 1
