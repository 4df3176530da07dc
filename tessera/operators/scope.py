"""Expressions over the rows of a source: nodes become Columns, and what they reach for becomes joins.

A scope holds a frame whose columns are the source's members. A path through a link left-joins the target's visible
rows once per distinct prefix, as columns `prefix__member`; a question about child rows is aggregated by the
parent's key and left-joined once; membership in another source is a join to its distinct values. None of
these can multiply rows. Catalyst prunes what no expression reads.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.functions.scalar import call
from tessera.functions.typing import INTEGERS, constant, constant_type, is_number, promoted
from tessera.plans.nodes import Node, key_of, segments
from tessera.sources.catalog import Catalog, Children, Context, Link, Source

COMPARE = {"LessThan": "__lt__", "LessThanOrEqual": "__le__", "GreaterThan": "__gt__", "GreaterThanOrEqual": "__ge__"}
ARITHMETIC = {"Add": "__add__", "Subtract": "__sub__", "Multiply": "__mul__", "Modulo": "__mod__"}
COLLATIONS = {"CaseSensitive": "UTF8_BINARY", "CaseInsensitive": "UTF8_LCASE"}
#: Links that one path may follow.
MAX_HOPS = 4


def exact(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`")


class Reads(set[str]):
    """The sources that a request reads, and which of them as child rows."""

    def __init__(self) -> None:
        super().__init__()
        self.collections: set[str] = set()


class Scope:
    def __init__(self, catalog: Catalog, source: Source, df: DataFrame, ctx: Context, reads: Reads | None = None, note: bool = True) -> None:
        self.catalog, self.source, self.df, self.ctx = catalog, source, df, ctx
        self.reads = reads if reads is not None else Reads()
        if note:
            self._note(source)
        self.joined: dict[tuple[str, ...], Source] = {}
        self.answers: dict[str, str] = {}
        self.element: tuple[Column, T.DataType] | None = None
        self.group: Group | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _note(self, source: Source) -> None:
        for s in self.catalog.chain(source):
            self.reads.add(s.name)
            self.reads.update(r for p in s.policies for r in p.reads)

    def open(self, name: str, children: bool = False) -> Scope:
        """A scope over another source's visible rows."""
        source = self.catalog[name]
        if children:
            self.reads.collections.update(s.name for s in self.catalog.chain(source))
        self._note(source)
        return Scope(self.catalog, source, self.catalog.rows(source, self.spark, self.ctx), self.ctx, self.reads)

    def type_of(self, column: Column) -> T.DataType:
        return (self.group.frame() if self.group else self.df).select(column).schema[0].dataType

    # Paths

    def member(self, path: str | list[str]) -> Column:
        names = segments(path)
        if self.element:
            return self._inside(*self.element, names)
        source, prefix = self.source, ()
        while names[0] in source.links:
            prefix = (*prefix, names[0])
            if len(prefix) > MAX_HOPS:
                raise ValidationError(f"a path follows at most {MAX_HOPS} links")
            source = self._link(source, prefix)
            names = names[1:]
            if not names:
                raise ValidationError(f"{'.'.join(prefix)} is no value")
        if len(names) == 1 and names[0] in source.capabilities and not prefix:
            return F.coalesce(source.capabilities[names[0]](self.ctx), F.lit(False))
        field = source.member(names[0])
        return self._inside(source.shown(field.name, exact(self.df, "__".join((*prefix, field.name)))), field.dataType, names[1:])

    def _inside(self, column: Column, kind: T.DataType, names: list[str]) -> Column:
        for name in names:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                raise ValidationError(f"no member {name}")
            column, kind = column[name], kind[name].dataType
        return column

    def _link(self, source: Source, prefix: tuple[str, ...]) -> Source:
        """Joins the link's target, once; a target that the caller may not see reads as null."""
        link: Link = source.links[prefix[-1]]
        if prefix not in self.joined:
            target = self.catalog[link.target]
            self._note(target)
            rows = self.catalog.rows(target, self.spark, self.ctx)
            name = "__".join(prefix)
            rows = rows.select(*[exact(rows, c).alias(f"{name}__{c}") for c in target.fields])
            own = "__".join(prefix[:-1])
            on = [exact(self.df, f"{own}__{a}" if own else a) == exact(rows, f"{name}__{b}") for a, b in zip(link.columns, target.key, strict=True)]
            self.df = self.df.join(rows, on, "left")
            self.joined[prefix] = target
        return self.joined[prefix]

    def collection(self, path: str | list[str]) -> Children | Column:
        """Child rows, or the array column that a path names."""
        names = segments(path)
        if len(names) == 1 and names[0] in self.source.children:
            return self.source.children[names[0]]
        column = self.member(path)
        if not isinstance(self.type_of(column), T.ArrayType):
            raise ValidationError(f"{path} is no collection")
        return column

    # Expressions

    def condition(self, node: Node) -> Column:
        """For filters: null does not match."""
        column = self.expr(node)
        if not self.element and not isinstance(self.type_of(column), T.BooleanType):
            raise ValidationError("a filter is a condition")
        return column

    def value(self, node: Node) -> Column:
        """For keys and projections: a comparison with nothing is false, not null."""
        column = self.expr(node)
        return F.coalesce(column, F.lit(False)) if node["$type"] == "binary" and node["op"] in (*COMPARE, "AndAlso", "OrElse") else column

    def kind(self, node: Node, column: Column) -> T.DataType:
        if self.element and node["$type"] == "element":
            return self.element[1]
        if self.element:  # a lambda's variable has no type outside its lambda: read it from an element of that type
            probe = Scope(self.catalog, self.source, self.spark.createDataFrame([], T.StructType([T.StructField("e", self.element[1])])), self.ctx)
            probe.element = (F.col("e"), self.element[1])
            return probe.type_of(probe.expr(node))
        if node["$type"] == "member" and not self.group and not self.element and (known := self.source.fields.get(node["path"] if isinstance(node["path"], str) else "")) is not None:
            return known.dataType  # as the catalog has it; Spark is asked about expressions only
        return self.type_of(column)

    def expr(self, node: Node) -> Column:
        handler = getattr(self, f"_{node.get('$type')}", None) if isinstance(node, dict) else None
        if handler is None:
            raise ValidationError(f"no expression {node!r}")
        return handler(node)

    def _member(self, node: Node) -> Column:
        if self.group:
            return self.group.key(node)
        return self.member(node["path"])

    def _element(self, node: Node) -> Column:
        if not self.element:
            raise ValidationError("an element is read within a collection only")
        return self.element[0]

    def _const(self, node: Node) -> Column:
        return constant(node)

    def _operands(self, left: Node, right: Node, own: bool = False) -> tuple[Column, Column, T.DataType, T.DataType]:
        """Both sides; a constant is read at the other side's type, so that no cast lands on a member.

        own: in arithmetic a number keeps its own type, which decides what both are promoted to.
        """
        if right["$type"] == "const" and left["$type"] != "const":
            a = self.expr(left)
            kind = self.kind(left, a)
            wanted = None if own and is_number(kind) and right["tag"] != "Null" else kind
            return a, constant(right, wanted), kind, self._const_type(right, wanted)
        if left["$type"] == "const" and right["$type"] != "const":
            b, a, kb, ka = self._operands(right, left, own)
            return a, b, ka, kb
        a, b = self.expr(left), self.expr(right)
        return a, b, self.kind(left, a), self.kind(right, b)

    def _const_type(self, node: Node, kind: T.DataType | None) -> T.DataType:
        return constant_type(node, kind)

    def _check_enum(self, left: Node, right: Node) -> None:
        """A constant that is compared with an enum member names one of its values."""
        for a, b in ((left, right), (right, left)):
            if a["$type"] == "member" and b["$type"] == "const" and not self.element:
                names = self.source.enums.get(segments(a["path"])[-1])
                if names is not None and b.get("value") is not None and b["value"] not in names:
                    raise ValidationError(f"{b['value']} is no value of {a['path']}")

    def _binary(self, node: Node) -> Column:
        op, left, right = node["op"], node["left"], node["right"]
        if op in ("AndAlso", "OrElse"):
            a, b = self.condition(left), self.condition(right)
            return a & b if op == "AndAlso" else a | b
        if op in ("Equal", "NotEqual"):
            self._check_enum(left, right)
            nulls = [n for n in (left, right) if n["$type"] == "const" and n.get("value") is None]
            if nulls:
                other = self.expr(right if nulls[0] is left else left)
                return other.isNull() if op == "Equal" else other.isNotNull()
            a, b, _, _ = self._operands(left, right)
            same = a.eqNullSafe(b)
            return same if op == "Equal" else ~same
        a, b, ka, kb = self._operands(left, right, op in ARITHMETIC or op == "Divide")
        if op in COMPARE:
            return getattr(a, COMPARE[op])(b)
        if op == "Coalesce":
            return F.coalesce(a, b)
        if op == "Add" and (isinstance(ka, T.StringType) or isinstance(kb, T.StringType)):
            return F.concat(F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit("")))
        if op == "Subtract" and not is_number(ka) and not is_number(kb):
            return a - b
        wide = promoted(ka, kb)
        a, b = a.cast(wide), b.cast(wide)
        if op == "Divide":
            return F.call_function("div", a, b).cast(wide) if isinstance(wide, INTEGERS) else (a / b).cast(wide)
        if op not in ARITHMETIC:
            raise ValidationError(f"no operator {op}")
        return getattr(a, ARITHMETIC[op])(b).cast(wide)

    def _unary(self, node: Node) -> Column:
        operand = self.expr(node["operand"])
        if node["op"] == "Not":
            return ~F.coalesce(operand, F.lit(False))
        if node["op"] == "Negate":
            return -operand
        raise ValidationError(f"no operator {node['op']}")

    def _call(self, node: Node) -> Column:
        target, name = self.expr(node["target"]), node["function"]
        kind = self.kind(node["target"], target)
        columns, kinds = [target], [kind]
        for arg in node.get("arguments", []):
            if arg["$type"] == "const":
                if arg.get("value") is not None and arg["value"].startswith("-") and name in ("StringSubstring", "BytesElementAt"):
                    raise ValidationError(f"{name} takes no negative place")
                c = constant(arg, kind if name in ("In", "CompareTo", "MathMax", "MathMin") or arg.get("value") is None else None)
                columns.append(c)
                kinds.append(T.NullType() if arg.get("value") is None else self._const_type(arg, kind) if name in ("MathMax", "MathMin") else kind)
            else:
                c = self.expr(arg)
                columns.append(c)
                kinds.append(self.kind(arg, c))
        return call(name, columns, kinds)

    def _conditional(self, node: Node) -> Column:
        test = F.coalesce(self.condition(node["test"]), F.lit(False))
        yes, no, _, _ = self._operands(node["ifTrue"], node["ifFalse"])
        return F.when(test, yes).otherwise(no)

    def _collate(self, node: Node) -> Column:
        if node["match"] not in COLLATIONS:
            raise ValidationError(f"no collation {node['match']}")
        return F.collate(self.expr(node["target"]), COLLATIONS[node["match"]])

    def _aggregate(self, node: Node) -> Column:
        if not self.group:
            raise ValidationError("an aggregate needs a group")
        return self.group.aggregate(node)

    def _groupKey(self, node: Node) -> Column:  # noqa: N802
        if not self.group or not 0 <= node["index"] < len(self.group.keys):
            raise ValidationError("no such group key")
        return F.col(f"__k{node['index']}")

    # Membership in another source

    def candidates(self, node: Node) -> tuple[Column, DataFrame]:
        """The tested value, and the distinct values of the other source."""
        other = self.open(node["root"])
        if node.get("predicate"):
            keep = other.condition(node["predicate"])
            other.df = other.df.where(keep)
        selected = other.value(node["selector"])
        return self.value(node["value"]), other.df.select(selected.alias("__in")).where("__in IS NOT NULL").distinct()

    def _inSource(self, node: Node) -> Column:  # noqa: N802
        name = self.answers.get(key_of(node))
        if name is None:
            value, found = self.candidates(node)
            name = self.answers[key_of(node)] = f"__q{len(self.answers)}"
            found = found.select(F.col("__in").alias(f"{name}_v"), F.lit(True).alias(name))
            self.df = self.df.join(found, value == F.col(f"{name}_v"), "left").drop(f"{name}_v")
        return F.coalesce(F.col(name), F.lit(False))

    # Questions about collections

    @contextlib.contextmanager
    def within(self, element: Column, kind: T.DataType):
        before, self.element = self.element, (element, kind)
        try:
            yield self
        finally:
            self.element = before

    def _subquery(self, node: Node) -> Column:
        if self.element or self.group:
            raise ValidationError("questions are asked of rows, one level deep")
        found = self.collection(node["path"])
        return self._ask_rows(node, found) if isinstance(found, Children) else self._ask_array(node, found)

    def _ask_array(self, node: Node, array: Column) -> Column:
        kind = self.type_of(array).elementType
        array = F.coalesce(array, F.array().cast(T.ArrayType(kind)))

        def on(x: Column, part: str) -> Column:
            with self.within(x, kind):
                return self.condition(node[part]) if part == "predicate" else self.value(node[part])

        keep = (lambda x: F.coalesce(on(x, "predicate"), F.lit(False))) if node.get("predicate") else None
        fn = node["function"]
        if fn == "Any":
            return F.exists(array, keep) if keep else F.size(array) > 0
        if fn == "All":
            return F.forall(array, keep)
        kept = F.filter(array, keep) if keep else array
        if fn == "Count":
            return F.size(kept)
        values = F.transform(kept, lambda x: on(x, "selector")) if node.get("selector") else kept
        item = self.type_of(values).elementType
        values = F.filter(values, lambda x: x.isNotNull())
        if fn in ("Min", "Max"):
            return (F.array_min if fn == "Min" else F.array_max)(values)
        if not is_number(item):
            raise ValidationError(f"{fn} needs numbers")
        wide = T.LongType() if isinstance(item, INTEGERS) else T.DecimalType(38, item.scale) if isinstance(item, T.DecimalType) else T.DoubleType()
        total = F.aggregate(values, F.lit(0).cast(wide), lambda s, x: (s + x.cast(wide)).cast(wide))
        if fn == "Sum":
            return total
        if fn == "Average":
            return F.when(F.size(values) > 0, total.cast("double") / F.size(values))
        raise ValidationError(f"no question {fn}")

    def prepare(self, part: object) -> None:
        """Answers all questions of an operator about the same child rows by one aggregation and one join."""
        by_path: dict[str, list[Node]] = {}
        for node in questions(part):
            names = segments(node["path"])
            if not self.element and not self.group and len(names) == 1 and names[0] in self.source.children and key_of(node) not in self.answers:
                by_path.setdefault(names[0], []).append(node)
        for name, nodes in by_path.items():
            self._answer(list({key_of(n): n for n in nodes}.values()), self.source.children[name])

    def _answer(self, nodes: list[Node], children: Children) -> None:
        child, made, first = self.open(children.target, children=True), [], f"__q{len(self.answers)}"
        for node in nodes:
            fn = node["function"]
            keep = F.coalesce(child.condition(node["predicate"]), F.lit(False)) if node.get("predicate") else None
            if keep is not None and fn != "All" and len(nodes) == 1:  # alone, its filter reaches the scan
                child.df = child.df.where(keep)
                keep = None
            picked = child.value(node["selector"]) if node.get("selector") else None
            if fn in ("Sum", "Average") and (picked is None or not is_number(child.type_of(picked))):
                raise ValidationError(f"{fn} needs numbers")
            if fn in ("Min", "Max") and picked is None:
                raise ValidationError(f"{fn} needs a selector")
            kept = lambda c, k=keep: c if k is None else F.when(k, c)
            column = {"Any": lambda: F.count(kept(F.lit(1))) > 0, "All": lambda: F.bool_and(keep), "Count": lambda: F.count(kept(F.lit(1))), "Sum": lambda: F.sum(kept(picked)), "Average": lambda: F.avg(kept(picked)), "Min": lambda: F.min(kept(picked)), "Max": lambda: F.max(kept(picked))}.get(fn)
            if column is None:
                raise ValidationError(f"no question {fn}")
            name = self.answers[key_of(node)] = f"__q{len(self.answers)}"
            made.append(column().alias(name))
        grouped = child.df.groupBy(*[exact(child.df, c).alias(f"{first}_{i}") for i, c in enumerate(children.columns)]).agg(*made)
        self._attach(grouped, first, children)

    def _ask_rows(self, node: Node, children: Children) -> Column:
        if key_of(node) not in self.answers:
            self._answer([node], children)
        column = F.col(self.answers[key_of(node)])
        empty = {"Any": False, "All": True, "Count": 0, "Sum": 0}.get(node["function"])
        return column if empty is None else F.coalesce(column, F.lit(empty).cast(self.type_of(column)))

    def _attach(self, grouped: DataFrame, name: str, children: Children) -> None:
        """Left-joins one row a parent, by the parent's key."""
        on = [exact(self.df, k) == F.col(f"{name}_{i}") for i, k in enumerate(self.source.key)]
        self.df = self.df.join(grouped, on, "left").drop(*[f"{name}_{i}" for i in range(len(children.columns))])

    def project_collection(self, value: Node) -> Column:
        """An array of a collection's elements, or of what is projected from each. Child rows come in key order."""
        found = self.collection(value["path"])
        if not isinstance(found, Children):
            kind = self.type_of(found).elementType

            def on(x: Column, node: Node) -> Column:
                with self.within(x, kind):
                    return self.value(node)

            kept = F.filter(found, lambda x: F.coalesce(on(x, value["predicate"]), F.lit(False))) if value.get("predicate") else found
            if value.get("selector"):
                kept = F.transform(kept, lambda x: on(x, value["selector"]))
            elif value.get("projection"):
                parts = members(value["projection"])
                kept = F.transform(kept, lambda x: F.struct(*[on(x, v["node"]).alias(n) for n, v in parts]))
            return F.coalesce(kept, F.array())
        name = f"__q{len(self.answers)}"
        self.answers[key_of(value) + "#rows"] = name
        child = self.open(found.target, children=True)
        if value.get("predicate"):
            keep = child.condition(value["predicate"])
            child.df = child.df.where(keep)
        if value.get("selector"):
            item = child.value(value["selector"]).alias("v")
        else:
            parts = members(value["projection"]) if value.get("projection") else [(n, {"$type": "node", "node": {"$type": "member", "path": n}}) for n in child.source.scalars]
            item = F.struct(*[child.value(v["node"]).alias(n) for n, v in parts]).alias("v")
        order = [exact(child.df, k) for k in child.source.key]
        rows = child.df.groupBy(*[exact(child.df, c).alias(f"{name}_{i}") for i, c in enumerate(found.columns)])
        grouped = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item))), lambda x: x["v"]).alias(name))
        self._attach(grouped, name, found)
        return F.coalesce(F.col(name), F.array())


def questions(part: object) -> list[Node]:
    """The questions in a part of a request that are about its own rows."""
    if isinstance(part, list):
        return [q for x in part for q in questions(x)]
    if not isinstance(part, dict) or part.get("$type") in ("inSource", "collection", "aggregate"):
        return []
    return [part] if part.get("$type") == "subquery" else [q for x in part.values() for q in questions(x)]


def members(projection: Node) -> list[tuple[str, Node]]:
    """(name, value) of a projection; a bare name stands for the member of that name."""
    return [(x, {"$type": "node", "node": {"$type": "member", "path": x}}) if isinstance(x, str) else (x["name"], x["value"]) for x in projection["members"]]


class Group:
    """What an expression may read after grouping: the keys, and aggregates that are gathered on the way."""

    def __init__(self, scope: Scope, nodes: list[Node]) -> None:
        self.scope, self.nodes = scope, nodes
        self.keys = [scope.value(n) for n in nodes]
        self.wanted: dict[str, tuple[str, Column]] = {}
        self.having: list[Node] = []

    def key(self, node: Node) -> Column:
        for i, own in enumerate(self.nodes):
            if own["$type"] == "member" and segments(own["path"]) == segments(node["path"]):
                return F.col(f"__k{i}")
        raise ValidationError(f"{node['path']} is no key of the group")

    def frame(self) -> DataFrame:
        """Keys and the aggregates so far."""
        df = self.scope.df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(self.keys)])
        aggregates = [c.alias(n) for n, c in self.wanted.values()]
        return df.agg(*aggregates) if aggregates else df.agg(F.count("*").alias("__rows"))

    def aggregate(self, node: Node) -> Column:
        at = key_of(node)
        if at not in self.wanted:
            self.scope.group = None
            try:
                self.wanted[at] = (f"__a{len(self.wanted)}", aggregate(self.scope, node))
            finally:
                self.scope.group = self
        return F.col(self.wanted[at][0])


def aggregate(scope: Scope, node: Node) -> Column:
    """Sum, Average, Min, Max, Count or Join over the rows of a group, which may be filtered or distinct."""
    fn, distinct = node["function"], node.get("distinct", False)
    picked = scope.value(node["selector"]) if node.get("selector") else None
    if distinct and picked is None:
        raise ValidationError("a distinct aggregate needs a selector")
    kind = scope.type_of(picked) if picked is not None else None
    if fn in ("Sum", "Average") and (kind is None or not is_number(kind)):
        raise ValidationError(f"{fn} needs numbers")
    if fn == "Count":
        if picked is not None and not distinct:
            raise ValidationError("Count takes a selector only if it is distinct")
        picked = picked if distinct else F.lit(1)
    if picked is None:
        raise ValidationError(f"{fn} needs a selector")
    if node.get("predicate"):
        picked = F.when(F.coalesce(scope.condition(node["predicate"]), F.lit(False)), picked)
    if fn == "Count":
        return (F.count_distinct if distinct else F.count)(picked)
    if fn == "Sum":
        return F.coalesce((F.sum_distinct if distinct else F.sum)(picked), F.lit(0).cast("long" if isinstance(kind, INTEGERS) else kind))
    if fn == "Average":
        column = F.call_function("avg", picked) if not distinct else F.try_divide(F.sum_distinct(picked), F.count_distinct(picked))
        return column.cast(kind) if isinstance(kind, (T.DecimalType, T.FloatType)) else column.cast("double")
    if fn in ("Min", "Max"):
        return (F.min if fn == "Min" else F.max)(picked)
    if fn == "Join":
        if node.get("separator") is None:
            raise ValidationError("Join needs a separator")
        texts = picked.cast("string")
        joined = F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(texts)), node["separator"])
        return F.coalesce(joined, F.lit(""))
    raise ValidationError(f"no aggregate {fn}")
