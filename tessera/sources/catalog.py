"""The allow-list: which sources, members, links and collections a request may name, and how rows are read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError

#: caller, claims and whatever policies look at.
Context = dict[str, Any]


@dataclass(frozen=True)
class Policy:
    """Narrows a source's rows for a caller: a condition on its columns, or a function of the frame.

    reads: other sources the policy looks at, for live queries.
    """

    name: str
    condition: Callable[[Context], Column] | None = None
    narrow: Callable[[DataFrame, Context], DataFrame] | None = None
    reads: tuple[str, ...] = ()

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df.where(self.condition(ctx)) if self.condition else self.narrow(df, ctx)


@dataclass(frozen=True)
class Link:
    """A reference to one row of another source: local columns that equal the target's key."""

    target: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Children:
    """The rows of another source whose columns equal this source's key."""

    target: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Source:
    name: str
    read: Callable[[SparkSession], DataFrame]
    schema: T.StructType
    kind: str = "table"  # table, view or rows
    key: tuple[str, ...] = ()
    links: dict[str, Link] = field(default_factory=dict)
    children: dict[str, Children] = field(default_factory=dict)
    policies: tuple[Policy, ...] = ()
    hidden: frozenset[str] = frozenset()
    sensitive: frozenset[str] = frozenset()
    attachments: frozenset[str] = frozenset()
    attachment_policy: Callable[[Context, dict], bool] | None = None
    aliases: dict[str, str] = field(default_factory=dict)  # retired member name -> member
    enums: dict[str, dict[str, int]] = field(default_factory=dict)  # member -> name -> number
    base: str | None = None  # of a subtype
    discriminator: tuple[str, tuple[str, ...]] | None = None
    denied: frozenset[str] = frozenset()  # positions at which hidden rows are refused
    capabilities: dict[str, Callable[[Context], Column]] = field(default_factory=dict)
    version: str | None = None  # column by which cached decisions are kept fresh

    @property
    def fields(self) -> dict[str, T.StructField]:
        return {f.name: _without(f, self._within(f.name)) for f in self.schema if f.name not in self.hidden}

    def _within(self, name: str) -> list[str]:
        """Paths below a member that are hidden, as `address.zip` in `hidden`."""
        return [h[len(name) + 1 :] for h in self.hidden if h.startswith(f"{name}.")]

    def shown(self, name: str, column: Column) -> Column:
        """A member's column, without what is hidden inside."""
        return _dropped(column, self.schema[name].dataType, self._within(name))

    def member(self, name: str) -> T.StructField:
        found = self.fields.get(self.aliases.get(name, name))
        if found is None or found.name in self.attachments:
            raise ValidationError(f"{self.name} has no member {name}")
        return found

    @property
    def scalars(self) -> list[str]:
        """What a query without a projection returns."""
        return [n for n, f in self.fields.items() if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and n not in self.attachments]


def _without(f: T.StructField, paths: list[str]) -> T.StructField:
    """A field without the hidden paths below it; those of an array are of its elements."""
    if not paths:
        return f
    kind = f.dataType
    if isinstance(kind, T.ArrayType):
        return T.StructField(f.name, T.ArrayType(_without(T.StructField("e", kind.elementType), paths).dataType, kind.containsNull), f.nullable)
    kept = [_without(x, [p[len(x.name) + 1 :] for p in paths if p.startswith(f"{x.name}.")]) for x in kind if x.name not in paths]
    return T.StructField(f.name, T.StructType(kept), f.nullable)


def _dropped(column: Column, kind: T.DataType, paths: list[str]) -> Column:
    if not paths:
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _dropped(x, kind.elementType, paths))
    return column.dropFields(*paths)


class Catalog:
    def __init__(self, *sources: Source, retired: dict[str, str] | None = None) -> None:
        self.sources = {s.name: s for s in sources}
        self.retired = retired or {}
        for s in sources:
            for link in s.links.values():
                target = self.sources[link.target]
                if len(target.key) != len(link.columns):
                    raise ValueError(f"{s.name}: a link to {link.target} needs its whole key")

    def __getitem__(self, name: str) -> Source:
        found = self.sources.get(self.retired.get(name, name))
        if found is None:
            raise ValidationError(f"no source {name}")
        return found

    def with_(self, name: str, **changes: Any) -> Catalog:
        """A catalog in which one source is changed."""
        return Catalog(*[replace(s, **changes) if s.name == name else s for s in self.sources.values()], retired=self.retired)

    def chain(self, source: Source) -> list[Source]:
        """A subtype's sources, base-most first."""
        return [*(self.chain(self[source.base]) if source.base else []), source]

    def rows(self, source: Source, spark: SparkSession, ctx: Context, after: Source | None = None) -> DataFrame:
        """The source's rows as the caller may see them; after: only the policies beyond those of that base."""
        chain = self.chain(source)
        df = chain[0].read(spark)
        return self.narrow(df, source, ctx, after)

    def narrow(self, df: DataFrame, source: Source, ctx: Context, after: Source | None = None) -> DataFrame:
        done = {s.name for s in self.chain(after)} if after else set()
        for s in self.chain(source):
            if s.name in done:
                continue
            if s.discriminator:
                df = df.where(F.col(s.discriminator[0]).isin(*s.discriminator[1]))
            for policy in s.policies:
                df = policy.apply(df, ctx)
        return df

    def stamp(self) -> str:
        """A digest of the surface: a client made for another one is told so."""
        return hashlib.sha256(json.dumps(self.describe(), sort_keys=True).encode()).hexdigest()[:16]

    def describe(self) -> list[dict]:
        """Sources, members, links and collections, as data."""
        return [
            {
                "name": s.name, "kind": s.kind, "key": list(s.key), "base": s.base,
                "members": [{"name": n, "type": f.dataType.simpleString(), "nullable": f.nullable, "attachment": n in s.attachments, "sensitive": n in s.sensitive, "enum": s.enums.get(n)} for n, f in s.fields.items()],
                "links": {k: v.target for k, v in s.links.items()}, "collections": {k: v.target for k, v in s.children.items()}, "capabilities": sorted(s.capabilities),
            }
            for s in self.sources.values()
        ]
