"""One rejection for each rule on shapes, positions and limits; round trips of requests."""

from __future__ import annotations

import json

import pytest

from tessera.errors import RequestError, TooLarge, ValidationError, WireFormatError
from tessera.plans.nodes import agg, ask, element, keys, m
from tessera.plans.validate import Limits, validate
from tessera.query import Query, collection, nested, source

shop, person = source("shop"), source("person")
by_id = shop.order_by(m("id"))
grouped = shop.group_by(m("region"))
one = {"id": ("outer", "id")}


def deep(n):
    e = m("id") == 1
    for _ in range(n):
        e = ~e
    return e


@pytest.mark.parametrize(
    "query",
    [
        shop.count().where(m("id") == 1), shop.take(1), shop.skip(1), shop.order_by(m("id")).skip(-1), by_id.take(1001), shop.reverse(), shop.last(), shop.page(), shop.then_by(m("id")), by_id.page(0),
        shop.select("id").where(m("id") == 1), shop.select("id").select("id"), shop.select("id").order_by(m("id")), shop.select("id").group_by(m("id")), shop.select("id").of_type("car"), shop.select("id").flatten("rows"), shop.select("id").aggregate("Sum", m("id")),
        grouped, grouped.order_by(m("region")).select("region"), grouped.count(), grouped.select("region").take(1), grouped.select("region").last(), grouped.of_type("car").select("region"), shop.group_by(), shop.group_by(*[m("id")] * 9).select("id"),
        shop.join(person, m("owner"), m("pid"), **one).where(m("id") == 1), shop.join(person, m("owner"), m("pid"), **one).count(m("id") == 1), shop.where(m("id") == 1).join(person, m("owner"), m("pid"), "Right", **one),
        shop.join(person, keys(*[m("id")] * 9), m("pid"), **one), shop.join(person.order_by(m("pid")), m("owner"), m("pid"), **one), shop.union(person.select("pid")), shop.select("id").union(person.select("pid")).select("id"),
        shop.select("id").distinct().distinct(), shop.select("id").distinct().all(m("id") == 1), by_id.select("id").distinct().take(1), by_id.flatten("rows").take(1), shop.flatten("rows").flatten("rows"),
        shop.where(agg("Count") > 1), shop.select(n=agg("Count")), shop.select("id", ID=m("id")), shop.select("id", iD=m("id")).select("id"), shop.select(x=m("id").coalesce(1) if False else m("a.b.c.d.e.f.g")),
        shop.where(ask("Any", "rows", where=ask("Any", "rows"))), shop.where(m("id").in_source("person", m("pid"), m("pid").in_source("shop", m("id")))), shop.where(deep(40)), shop.where(m("id").is_in(*range(1001))),
        shop.select("id").count(m("id") == 1), shop.select("id").any(m("id") == 1), shop.select("id").all(m("id") == 1), shop.select("id").first(m("id") == 1), shop.select("id").single(m("id") == 1), by_id.select("id").last(m("id") == 1), shop.select("id").distinct().count(m("id") == 1), shop.select("id").distinct().first(m("id") == 1), grouped.select("region").count(m("id") == 1),
        shop.select("id", n=nested("owner_", x=collection("rows"))), shop.select(n=nested("a", y=nested("b", z=nested("c", q=nested("d", r=nested("e", "f")))))),
    ],
)
def test_refused(query):
    with pytest.raises(RequestError):
        validate(query.request())


@pytest.mark.parametrize(
    "request_",
    [
        {}, {"version": 3, "root": "shop", "pipeline": []}, {"version": 1, "root": "shop", "pipeline": [], "more": 1}, {"version": 1, "root": "shop", "pipeline": [{"$type": "window"}]}, {"version": 1, "root": "shop", "pipeline": [{"$type": "where"}]},
        {"version": 1, "root": "shop", "pipeline": [{"$type": "take", "count": 1, "of": 2}]}, {"version": 1, "root": "shop", "pipeline": [{"$type": "where", "predicate": None}]}, {"version": 1, "root": "shop", "pipeline": [{"$type": "where", "predicate": {"$type": "member", "path": ["id"]}}]},
        {"version": 1, "root": "shop", "pipeline": [{"$type": "select", "projection": {"members": []}}]}, {"version": 1, "root": "shop", "pipeline": [{"$type": "where", "predicate": {"$type": "sql", "text": "1=1"}}]},
    ],
)
def test_malformed(request_):
    with pytest.raises(WireFormatError):
        validate(request_)


def test_limits():
    with pytest.raises(TooLarge):
        validate(Query("shop", tuple({"$type": "where", "predicate": (m("id") == 1).node} for _ in range(33))).request())
    with pytest.raises(ValidationError):
        validate(shop.select(*[f"a{i}" for i in range(257)]).request())
    with pytest.raises(ValidationError):
        validate(by_id.take(6).request(), Limits(page_size=5))
    many = m("id") == 1
    for _ in range(70):
        many = ask("Any", "rows") if many is None else many
    both = ask("Any", "rows")
    for _ in range(6):
        both = both & both
    validate(shop.where(both).request())
    with pytest.raises(ValidationError):
        validate(shop.where(both & ask("Any", "rows")).request())


@pytest.mark.parametrize(
    "query",
    [
        by_id.skip(1).take(2).select("id"), grouped.where(agg("Count") > 1).select("region", n=agg("Count", where=m("id") > 1)), shop.select("id").distinct().order_by(m("id")).take(2), shop.join(person.where(m("pid") > 1), m("owner"), m("pid"), **one).count(),
        shop.select("id").union(shop.where(m("id") > 1).select("id")).count(), shop.where(ask("Any", "tags", where=element() == "x")), by_id.reverse().last(), by_id.page(10),
    ],
)
def test_accepted_and_round_trips(query):
    request = query.request()
    validate(request)
    assert json.loads(json.dumps(request)) == request


def test_version():
    assert shop.request()["version"] == 1
    assert grouped.select(n=agg("Count", m("id"), distinct=True)).request()["version"] == 2
    assert shop.join(person.order_by(m("pid")).take(1), m("owner"), m("pid"), **one).request()["version"] == 2
