"""A small model that has what the star schema lacks: nulls, arrays, structs, flags, a hierarchy, times and bytes."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from tessera.sources.catalog import Catalog, Children, Link, Source

SHOP = "id int, region string, amount decimal(10,2), discount decimal(10,2), qty int, tags array<string>, scores array<int>, lines array<struct<sku:string,n:int>>, address struct<city:string,zip:string>, flags int, code string, token string, owner int, placed timestamp_ntz, day date, pic binary, kind string, score double, secret string, version int, tiny smallint"
ROWS = [
    (1, "North", Decimal("100.00"), Decimal("5.50"), 3, ["urgent", "export"], [3, 5], [("a", 1), ("b", 2)], ("Oslo", "1"), 3, "42", "x", 10, dt.datetime(2024, 1, 31, 10, 20, 30, 123456), dt.date(2024, 1, 31), b"\x00\xff\x10", "car", 2.5, "s1", 1, 7),
    (2, "North", Decimal("250.00"), None, None, [], None, [("c", 5)], None, 1, "7", None, 99, None, None, None, "van", -2.5, "s2", 1, None),
    (3, "South", Decimal("75.00"), Decimal("1.00"), -7, None, [], None, ("Rome", None), 0, "-3", "  ", None, dt.datetime(2023, 12, 31), dt.date(2023, 12, 31), b"", "boat", 0.0, "s3", 1, 2),
]
PEOPLE = "pid int, name string, boss int, salary double, photo binary"
PERSONS = [(10, "Ann", None, 1.0, b"P"), (11, "Bob", 10, 2.0, None)]
LINES = "lid int, oid int, price double, units smallint"
LINE_ROWS = [(1, 1, 2.5, 1), (2, 1, 4.0, 2), (3, 2, None, 3)]


def catalog(**changes) -> Catalog:
    def of(name, schema, rows, key, **more):
        s = T.StructType.fromDDL(schema)
        for f in s:
            f.nullable = f.name not in key
        return Source(name, lambda spark: spark.createDataFrame(rows, schema), s, kind="rows", key=key, **more)

    shop = of("shop", SHOP, ROWS, ("id",), links={"owner_": Link("person", ("owner",))}, children={"rows": Children("line", ("oid",))}, hidden=frozenset({"secret"}), attachments=frozenset({"pic"}), aliases={"sum": "amount"}, enums={"kind": {"van": 1, "car": 2, "boat": 3}}, sensitive=frozenset({"token"}), version="version")
    person = of("person", PEOPLE, PERSONS, ("pid",), links={"boss_": Link("person", ("boss",))}, attachments=frozenset({"photo"}))
    car = Source("car", shop.read, shop.schema, key=("id",), base="shop", discriminator=("kind", ("car", "van")), links=shop.links, children=shop.children)
    out = Catalog(shop, person, of("line", LINES, LINE_ROWS, ("lid",), links={"order": Link("shop", ("oid",))}), car)
    for name, change in changes.items():
        out = out.with_(name, **change)
    return out
