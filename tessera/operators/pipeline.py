"""The pipeline operators: each turns the rows so far into the next DataFrame.

Sorting is held back until something needs it (a limit, or the answer), so that Spark plans one top-k instead of a
sort below it; a projection is held back until the rows are final or deduplicated, so that ordering may use
what it drops. A skip is held as well: one that a limit follows is part of its top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import NotFound, ValidationError
from tessera.functions.typing import is_number
from tessera.operators.scope import Group, Scope, aggregate, exact, members
from tessera.plans.nodes import Node, segments
from tessera.sources.catalog import Children, Source

#: Rows that a top-k may pass over; what skips more is sorted, which spills.
SHALLOW = 100_000
JOINS = {"Inner": "inner", "Left": "left", "Right": "right"}


@dataclass
class Skip:
    base: DataFrame  # the rows before it
    count: int
    order: list[tuple[Column, bool]]
    rest: DataFrame  # the rows after it


@dataclass
class Rows:
    scope: Scope
    order: list[tuple[Column, bool]] = field(default_factory=list)  # column, descending
    order_nodes: list[tuple[Node, bool]] = field(default_factory=list)
    projection: Node | None = None
    group: Group | None = None
    final: DataFrame | None = None  # after distinct, grouping, joins or sets: names are the answer's
    narrowed: bool = False  # by skip or take
    taken: bool = False  # by take: few rows, and where the order leaves ties open not always the same
    skipped: Skip | None = None
    steps: list[Node] = field(default_factory=list)  # for cursors

    @property
    def df(self) -> DataFrame:
        return self.final if self.final is not None else self.scope.df

    @df.setter
    def df(self, value: DataFrame) -> None:
        if self.final is not None:
            self.final = value
        else:
            self.scope.df = value

    def keys(self) -> list[Column]:
        """Ascending has nulls first, descending has them last."""
        return [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in self.order]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.keys()) if self.order else self.df

    def last_skip(self) -> Skip | None:
        """The skip that nothing has come after: neither rows nor their order have changed."""
        last = self.skipped
        same = last and self.df is last.rest and len(self.order) == len(last.order) and all(a is b for a, b in zip(self.order, last.order, strict=True))
        return last if same else None

    def first(self, count: int) -> DataFrame:
        """The first rows in order, in one top-k with a skip just before."""
        last = self.last_skip()
        return (last.base.orderBy(*self.keys()).offset(last.count) if last else self.sorted()).limit(count)

    def answer(self, most: int | None = None) -> DataFrame:
        if self.final is None and self.group is None:
            projected(self)
        df = self.sorted() if most is None else self.first(most)
        return df if self.final is not None else df.select(*self._columns)

    _columns: list[Column] = field(default_factory=list)


def value_column(scope: Scope, value: Node) -> Column:
    kind = value["$type"]
    if kind == "node":
        return scope.value(value["node"])
    if kind == "nested":
        prefix = segments(value["path"])

        def inner(v: Node) -> Node:
            return {"$type": "node", "node": _under(prefix, v["node"])}

        return F.struct(*[value_column(scope, inner(v)).alias(n) for n, v in members(value["projection"])])
    if kind == "collection":
        return scope.project_collection(value)
    raise ValidationError(f"no projection value {kind}")


def _under(prefix: list[str], node: Node) -> Node:
    """The node with its member paths read below a prefix."""
    if isinstance(node, list):
        return [_under(prefix, x) for x in node]
    if not isinstance(node, dict):
        return node
    if node.get("$type") == "member":
        return node | {"path": [*prefix, *segments(node["path"])]}
    return {k: _under(prefix, v) for k, v in node.items()}


def projected(rows: Rows) -> None:
    """Works out the answer's columns; joins that they need are added to the scope."""
    scope = rows.scope
    if rows.projection is None:
        names = [*scope.source.scalars, *scope.source.capabilities]
        rows._columns = [scope.member(n).alias(n) for n in names]
    else:
        scope.prepare(rows.projection)
        rows._columns = [value_column(scope, v).alias(n) for n, v in members(rows.projection)]


def close(rows: Rows) -> None:
    """From here on the rows are the answer's."""
    if rows.final is None:
        projected(rows)
        rows.final = rows.scope.df.select(*rows._columns)


# Operators


def conjuncts(node: Node) -> list[Node]:
    if node["$type"] == "binary" and node["op"] == "AndAlso":
        return [*conjuncts(node["left"]), *conjuncts(node["right"])]
    return [node]


def where(rows: Rows, op: Node) -> None:
    predicate = op["predicate"]
    if rows.group:
        rows.group.having.append(predicate)
        return
    scope = rows.scope
    scope.prepare(predicate)
    for part in conjuncts(predicate):
        negated = part["$type"] == "unary" and part["op"] == "Not" and part["operand"]["$type"] == "inSource"
        if part["$type"] == "inSource" or negated:  # a semi or anti join, with no flag column
            value, found = scope.candidates(part["operand"] if negated else part)
            scope.df = scope.df.join(found, value == F.col("__in"), "left_anti" if negated else "left_semi")
        else:
            condition = scope.condition(part)
            scope.df = scope.df.where(condition)


def order_by(rows: Rows, op: Node) -> None:
    rows.order, rows.order_nodes = [], []
    then_by(rows, op)


def then_by(rows: Rows, op: Node) -> None:
    descending = op.get("descending", False)
    if rows.final is not None:
        names = segments(op["key"].get("path", []))
        if op["key"]["$type"] != "member" or len(names) != 1 or names[0] not in rows.final.columns:
            raise ValidationError("after distinct, an order names a projected member")
        column: Column = exact(rows.final, names[0])
    else:
        column = rows.scope.value(op["key"])
        numbers = rows.scope.source.enums.get(segments(op["key"]["path"])[-1]) if op["key"]["$type"] == "member" else None
        if numbers:  # by number, not by name
            column = F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), column)
    rows.order.append((column, descending))
    rows.order_nodes.append((op["key"], descending))


def reverse(rows: Rows, op: Node) -> None:
    rows.order = [(c, not d) for c, d in rows.order]
    rows.order_nodes = []


def comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(comparable(f.dataType) for f in kind)
    return comparable(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def skip(rows: Rows, op: Node) -> None:
    """The rows but the first. An offset alone brings all rows to one task, so the first ones, a top-k, are subtracted instead.

    Ties go by the other columns, so that the same rows are left out whenever this is worked out.
    """
    last = rows.last_skip()
    base, n = (last.base, last.count + op["count"]) if last else (rows.df, op["count"])
    if n > SHALLOW or rows.taken or not comparable(base.schema):
        rows.df = rows.sorted().offset(op["count"])
    elif op["count"]:
        rows.df = base.exceptAll(base.orderBy(*rows.keys(), *[exact(base, c).asc_nulls_first() for c in base.columns]).limit(n))
    if n <= SHALLOW:
        rows.skipped = Skip(base, n, list(rows.order), rows.df)
    rows.narrowed = True


def take(rows: Rows, op: Node) -> None:
    rows.df = rows.first(op["count"])
    rows.narrowed = rows.taken = True


def select(rows: Rows, op: Node) -> None:
    rows.projection = op["projection"]
    if rows.group:
        grouped(rows)


def distinct(rows: Rows, op: Node) -> None:
    close(rows)
    rows.final = rows.final.distinct()
    rows.order, rows.order_nodes = [], []


def of_type(rows: Rows, op: Node) -> None:
    scope, target = rows.scope, rows.scope.catalog[op["type"]]
    if scope.source.name not in [s.name for s in scope.catalog.chain(target)[:-1]]:
        raise ValidationError(f"{op['type']} is no kind of {scope.source.name}")
    scope.df = scope.catalog.narrow(scope.df, target, scope.ctx, after=scope.source)
    scope.source = target
    scope._note(target)


def select_many(rows: Rows, op: Node) -> None:
    """The elements of a collection, one row each: child rows by an inner join, value objects by exploding."""
    scope = rows.scope
    found = scope.collection(op["path"])
    if isinstance(found, Children):
        child = scope.open(found.target, children=True)
        parents = scope.df.select(*[exact(scope.df, k).alias(f"__p{i}") for i, k in enumerate(scope.source.key)])
        on = [F.col(f"__p{i}") == exact(child.df, c) for i, c in enumerate(found.columns)]
        child.df = child.df.join(parents, on, "left_semi") if scope.source.key else child.df.join(parents, on).drop(*parents.columns)
        rows.scope = child
    else:
        kind = scope.type_of(found).elementType
        if not isinstance(kind, T.StructType):
            raise ValidationError("only rows and value objects flatten")
        df = scope.df.select(F.explode(found).alias("e")).select("e.*")
        # A source of this request alone: the catalog names no elements, so nobody can ask for them past their owner's policies.
        name = f"{scope.source.name}.{'.'.join(segments(op['path']))}"
        rows.scope = Scope(scope.catalog, Source(name, scope.source.read, kind, kind="elements"), df, scope.ctx, scope.reads, note=False)
    rows.order, rows.order_nodes = [], []


def group_by(rows: Rows, op: Node) -> None:
    rows.group = Group(rows.scope, op["keys"])
    rows.order, rows.order_nodes = [], []


def grouped(rows: Rows) -> None:
    """Keys and the aggregates that filters and projection ask for, in one aggregation; then the filters, then the projection."""
    group, scope = rows.group, rows.scope
    scope.group = group
    conditions = [scope.expr(p) for p in group.having]
    columns = []
    for name, v in members(rows.projection):
        if v["$type"] != "node":
            raise ValidationError("a group gives values")
        columns.append(scope.expr(v["node"]).alias(name))
    scope.group = None
    df = group.frame()
    for c in conditions:
        df = df.where(c)
    rows.final = df.select(*columns)


def _side(scope: Scope, op: Node) -> None:
    """Filters of a join's or set's other side, and an order that skip and take bound."""
    inner = Rows(scope)
    ops = op.get("innerOps") or op.get("operandOps") or []
    predicate = op.get("innerPredicate") or op.get("predicate")
    for x in [*([{"$type": "where", "predicate": predicate}] if predicate else []), *ops]:
        if x["$type"] not in ("where", "orderBy", "thenBy", "skip", "take", "ofType"):
            raise ValidationError(f"a side takes no {x['$type']}")
        OPERATORS[x["$type"]](inner, x)


def _key_parts(node: Node) -> list[Node]:
    return node["parts"] if node["$type"] == "compositeKey" else [node]


def join(rows: Rows, op: Node) -> None:
    outer = rows.scope
    if rows.order and rows.narrowed:
        outer.df = rows.sorted()
    inner = outer.open(op["root"])
    _side(inner, op)
    outs, ins = _key_parts(op["outerKey"]), _key_parts(op["innerKey"])
    if len(outs) != len(ins) or len(outs) > 8:
        raise ValidationError("both sides of a join have as many key parts, eight at most")
    left_keys = [outer.value(n) for n in outs]
    right_keys = [inner.value(n) for n in ins]
    for a, b in zip(left_keys, right_keys, strict=True):
        ka, kb = outer.type_of(a), inner.type_of(b)
        if ka != kb and not (is_number(ka) and is_number(kb)):
            raise ValidationError(f"keys of {ka.simpleString()} and {kb.simpleString()} do not join")
    kind = op["kind"]
    picks = op["result"]
    outer_picks = {p["name"]: outer.value({"$type": "member", "path": p["path"]}).alias(p["name"]) for p in picks if p["side"] == "Outer" and not p.get("aggregate")}
    left = outer.df.select(*[k.alias(f"__l{i}") for i, k in enumerate(left_keys)], *outer_picks.values())
    on = [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(outs))]
    if kind == "Group":
        folded = {p["name"]: aggregate(inner, p["aggregate"]) for p in picks if p.get("aggregate")}
        if not folded or any(p["side"] == "Inner" and not p.get("aggregate") for p in picks):
            raise ValidationError("a group join gives aggregates of its inner rows")
        right = inner.df.groupBy(*[k.alias(f"__r{i}") for i, k in enumerate(right_keys)]).agg(*[c.alias(n) for n, c in folded.items()])
        joined = left.join(right, on, "left")
        zero = {p["name"] for p in picks if p.get("aggregate") and p["aggregate"]["function"] in ("Count", "Sum")}
        types = dict((f.name, f.dataType) for f in joined.schema)
        columns = [F.coalesce(F.col(n), F.lit(0).cast(types[n])).alias(n) if n in zero else F.col(n) for n in (p["name"] for p in picks)]
        rows.final = joined.select(*columns)
    else:
        if kind not in JOINS:
            raise ValidationError(f"no join {kind}")
        right_picks = [inner.value({"$type": "member", "path": p["path"]}).alias(p["name"]) for p in picks if p["side"] == "Inner"]
        right = inner.df.select(*[k.alias(f"__r{i}") for i, k in enumerate(right_keys)], *right_picks)
        rows.final = left.join(right, on, JOINS[kind]).select(*[p["name"] for p in picks])
    rows.order, rows.order_nodes = [], []


def set_operation(rows: Rows, op: Node) -> None:
    close(rows)
    other = rows.scope.open(op["root"])
    _side(other, op)
    columns = [value_column(other, v).alias(n) for n, v in members(op["projection"])]
    right = other.df.select(*columns)
    left = rows.final
    if [(f.name, f.dataType) for f in left.schema] != [(f.name, f.dataType) for f in right.schema]:
        raise ValidationError("both sides of a set operation have the same names and types, in the same order")
    made = {"Union": lambda: left.union(right).distinct(), "Concat": lambda: left.union(right), "Intersect": lambda: left.intersect(right), "Except": lambda: left.subtract(right)}.get(op["kind"])
    if made is None:
        raise ValidationError(f"no set operation {op['kind']}")
    rows.final = made()
    rows.order, rows.order_nodes = [], []


OPERATORS = {"where": where, "orderBy": order_by, "thenBy": then_by, "reverse": reverse, "skip": skip, "take": take, "select": select, "distinct": distinct, "ofType": of_type, "selectMany": select_many, "groupBy": group_by, "join": join, "set": set_operation}


# Terminals: frames of one row with a column `value`, or of the rows that the answer has.




def fold(rows: Rows, op: Node) -> DataFrame:
    kind = op["$type"]
    if op.get("predicate") and kind != "all":
        where(rows, op)
    if kind in ("count", "longCount"):
        if rows.projection is not None and rows.final is None and not rows.narrowed:
            rows.projection = None
        return rows.df.agg(F.count("*").cast("int" if kind == "count" else "long").alias("value"))
    if kind == "any":
        return rows.df.limit(1).agg((F.count("*") > 0).alias("value"))
    if kind == "all":
        kept = F.coalesce(rows.scope.condition(op["predicate"]), F.lit(False))
        return rows.df.agg(F.coalesce(F.bool_and(kept), F.lit(True)).alias("value"))
    if kind == "aggregate":
        if op["function"] in ("Count", "Join"):
            raise ValidationError(f"{op['function']} is no whole-sequence aggregate")
        column = aggregate(rows.scope, {"function": op["function"], "selector": op["selector"]})
        return rows.df.agg(column.alias("value"))
    raise ValidationError(f"no terminal {kind}")


def pick(rows: Rows, op: Node) -> DataFrame:
    """The row of first, single or last: at most two rows, of which `one` makes the answer."""
    if op.get("predicate"):
        where(rows, op)
    if op["$type"] == "last":
        rows.order = [(c, not d) for c, d in rows.order]
    return rows.answer(2 if op["$type"] == "single" else 1)


def one(found: list, op: Node) -> dict | None:
    if not found:
        if op.get("orDefault"):
            return None
        raise NotFound("the sequence has no row")
    if len(found) > 1:
        raise ValidationError("the sequence has more than one row")
    return found[0].asDict(recursive=True)


FOLDS = ("count", "longCount", "any", "all", "aggregate")
PICKS = ("first", "single", "last")
