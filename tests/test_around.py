"""Pages, policies, batches, streams, live queries, commands, attachments and the audit."""

from __future__ import annotations

import shutil
import threading
import time

import pandas as pd
import pytest
from model import catalog
from pyspark.sql import functions as F

from tessera.audit import Audit
from tessera.commands import Command, Commands
from tessera.engine import Engine
from tessera.errors import Forbidden, NotFound, StaleClient, SubscriptionLimit, TooLarge, ValidationError
from tessera.plans.nodes import ask, m
from tessera.plans.validate import Limits
from tessera.query import collection, source
from tessera.sources.cached import CachedPolicy
from tessera.sources.catalog import Policy
from tessera.streaming.live import Changes, Hub, LiveOptions, watch_files

shop, person = source("shop"), source("person")
NORTH = Policy("north", lambda ctx: F.col("region") == ctx["region"])


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, catalog(), secret=b"k")


def test_pages_visit_every_row_once(engine):
    query, seen, cursor = shop.order_by(m("id"), True).select("region"), [], None
    while True:
        page = engine.execute(query.page(2, cursor).request())
        seen += page["items"]
        cursor = page["cursor"]
        if not page["hasMore"]:
            break
    assert [r["region"] for r in seen] == ["South", "North", "North"] and cursor is None


def test_cursors_are_bound(engine):
    cursor = engine.execute(shop.order_by(m("id")).page(1).request())["cursor"]
    for query in (shop.order_by(m("id"), True), shop.where(m("id") > 0).order_by(m("id"))):
        with pytest.raises(ValidationError):
            engine.execute(query.page(1, cursor).request())
    with pytest.raises(ValidationError):
        engine.execute(shop.order_by(m("id")).page(1, cursor[:-4] + "AAAA").request())
    nullable = engine.execute(shop.order_by(m("discount")).page(1).request())
    assert nullable["hasMore"] and nullable["cursor"] is None
    with pytest.raises(ValidationError):
        engine.execute(shop.order_by(m("discount")).page(1, cursor).request())


def test_policies(spark):
    narrowed = Engine(spark, catalog(shop={"policies": (NORTH,)}, person={"policies": (Policy("none", lambda ctx: F.lit(False)),)}))
    ctx = {"region": "North"}
    assert narrowed.execute(shop.count().request(), ctx)["value"] == 2
    assert narrowed.execute(shop.where(m("id") == 1).select("id", n=m("owner_.name")).request(), ctx)["rows"] == [{"id": 1, "n": None}]
    line = source("line")
    assert narrowed.execute(line.where(m("order.region") == "South").count().request(), ctx)["value"] == 0
    assert narrowed.execute(line.where(m("oid").in_source("shop", m("id"))).count().request(), {"region": "South"})["value"] == 0
    inherited = Engine(spark, catalog(shop={"policies": (NORTH,)}, car={"policies": (Policy("small", lambda ctx: F.col("amount") < 200),)}))
    assert [r["id"] for r in inherited.execute(shop.of_type("car").select("id").request(), ctx)["rows"]] == [1]
    hidden_children = Engine(spark, catalog(line={"policies": (Policy("cheap", lambda ctx: F.col("price") < 3),)}))
    assert hidden_children.execute(shop.where(m("id") == 1).select("id", n=ask("Count", "rows"), p=collection("rows", each=m("lid"))).request())["rows"] == [{"id": 1, "n": 1, "p": [1]}]


def test_denied_rows_refuse(spark):
    strict = Engine(spark, catalog(shop={"policies": (NORTH,), "denied": frozenset({"RootSingle"})}))
    assert strict.execute(shop.count().request(), {"region": "North"})["value"] == 2
    with pytest.raises(Forbidden):
        strict.execute(shop.first(m("id") == 3).request(), {"region": "North"})
    assert strict.execute(shop.first(m("id") == 1).request(), {"region": "North"})["row"]["id"] == 1


def test_cached_policy(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def decide(rows: pd.DataFrame, ctx: dict) -> pd.Series:
        calls.add(len(rows))
        return rows["amount"].astype(float) > ctx["least"]

    cached = CachedPolicy("amount", "id", "version", str(tmp_path), decide, lambda ctx: ctx["least"])
    narrowed = Engine(spark, catalog(shop={"policies": (cached.policy(),)}))
    for _ in range(2):
        assert narrowed.execute(shop.count().request(), {"least": 90})["value"] == 2
    assert calls.value == 3
    assert narrowed.execute(shop.count().request(), {"least": 200})["value"] == 1 and calls.value == 6
    cached.invalidate()
    assert narrowed.execute(shop.count().request(), {"least": 90})["value"] == 2 and calls.value == 9


def test_batch_stream_explain_etag(engine):
    out = engine.batch([shop.count().request(), shop.take(1).request()])
    assert out[0]["ok"]["value"] == 3 and out[1]["error"] == "Validation"
    parts = list(engine.stream(shop.order_by(m("id")).select("id").request()))
    assert parts[0] == {"begin": ["id"]} and parts[-1] == {"end": 3} and [p["row"]["id"] for p in parts[1:-1]] == [1, 2, 3]
    assert "Project" in engine.explain(shop.select("id").request())
    tag, answer = engine.execute_if_changed(shop.count().request(), None, "v1", None)
    assert answer["value"] == 3 and engine.execute_if_changed(shop.count().request(), None, "v1", tag) == (tag, None)
    assert engine.etag(shop.count().request(), {"caller": "b"}, "v1") != tag
    with pytest.raises(StaleClient):
        engine.execute(shop.request() | {"stamp": "old"})
    assert engine.execute(shop.request() | {"stamp": engine.describe()["stamp"]})["rows"]
    assert engine.metrics[-1]["outcome"] == "ok" and engine.sensitive(shop.where(m("token") == "x").request())


def test_attachments(spark):
    own = Engine(spark, catalog(person={"attachment_policy": lambda ctx, key: ctx.get("ok", False)}))
    assert own.attachment("person", "photo", {"pid": 10}, {"ok": True}) == b"P" and own.attachment("person", "photo", {"pid": 11}, {"ok": True}) is None
    with pytest.raises(Forbidden):
        own.attachment("person", "photo", {"pid": 10})
    with pytest.raises(NotFound):
        own.attachment("person", "photo", {"pid": 99}, {"ok": True})
    with pytest.raises(ValidationError):
        own.execute(person.select("photo").request())


def _file_engine(spark, folder):
    base = catalog()
    base.sources["person"] = __import__("dataclasses").replace(base["person"], read=lambda s: s.read.schema("pid int, name string, boss int, salary double, photo binary").parquet(folder))
    return Engine(spark, base)


def test_live_query_emits_only_new_answers(spark, tmp_path):
    folder = str(tmp_path / "people")
    frame = lambda rows: spark.createDataFrame(rows, "pid int, name string, boss int, salary double, photo binary")
    frame([(1, "a", None, 1.0, None)]).write.parquet(folder)
    hub = Hub(_file_engine(spark, folder), options=LiveOptions(throttle=0.0, poll=20.0, per_caller=1))
    stop, got = threading.Event(), []

    def follow():
        for x in hub.subscribe(person.count().request(), {"caller": "c"}, stop=stop):
            got.append(x)

    t = threading.Thread(target=follow)
    t.start()

    def until(n):
        end = time.time() + 30
        while len(got) < n and time.time() < end:
            time.sleep(0.05)

    until(1)
    with pytest.raises(SubscriptionLimit):
        next(hub.subscribe(person.count().request(), {"caller": "c"}))
    hub.changes.notify("shop")  # not read by the query
    hub.changes.notify("person")  # read, but the answer is the same
    time.sleep(1.0)
    assert [x["result"]["value"] for x in got] == [1]
    frame([(2, "b", None, 1.0, None)]).write.mode("append").parquet(folder)
    hub.changes.notify("person")
    until(2)
    stop.set()
    t.join(30)
    assert [x["result"]["value"] for x in got[:2]] == [1, 2] and got[-1] == {"end": got[1]["id"]}
    again = hub.subscribe(person.count().request(), {"caller": "c"}, resume_from=got[1]["id"])
    assert next(again) == {"unchanged": got[1]["id"]}
    again.close()


def test_files_report_changes(spark, tmp_path):
    folder, changes = str(tmp_path / "in"), Changes()
    spark.range(3).write.parquet(folder)
    query = watch_files(spark.readStream.schema("id long").parquet(folder), changes, "numbers", str(tmp_path / "cp"), 0.1)
    try:
        query.processAllAvailable()
        assert changes.at.get("numbers", 0) >= 1
    finally:
        query.stop()


def test_commands(spark):
    done, changes = [], Changes()
    own = Engine(spark, catalog())
    commands = Commands(own, changes, wait=0.3)
    slow = threading.Event()
    commands.register(Command("Rename", {"pid": int, "name": str}, lambda p, ctx: done.append(p) or "ok", "person", allow=lambda ctx: ctx.get("caller") == "a", rows=lambda ctx: F.col("salary") < 2, writes=("person",), check=lambda p: None if p["name"] else "a name is needed"))
    commands.register(Command("Slow", {}, lambda p, ctx: slow.wait(20)))
    assert commands.send("Rename", {"pid": 10, "name": "x"}, {"caller": "a"}).status == "Completed" and done and changes.at["person"] == 1
    for payload, ctx, error in (({"pid": 10}, {"caller": "a"}, ValidationError), ({"pid": "10", "name": "x"}, {"caller": "a"}, ValidationError), ({"pid": 10, "name": ""}, {"caller": "a"}, ValidationError), ({"pid": 10, "name": "x"}, {}, Forbidden), ({"pid": 11, "name": "x"}, {"caller": "a"}, Forbidden), ({"pid": 99, "name": "x"}, {"caller": "a"}, NotFound)):
        with pytest.raises(error):
            commands.send("Rename", payload, ctx)
    pending = commands.send("Slow", {})
    assert pending.status == "Pending"
    slow.set()
    assert commands.receipt(pending.id, 5).status == "Completed"
    shown = Engine(spark, catalog(person={"capabilities": commands.capabilities("person")}))
    assert [(r["pid"], r["CanRename"]) for r in shown.execute(person.order_by(m("pid")).request())["rows"]] == [(10, True), (11, False)]


def test_audit(spark, tmp_path):
    surface = catalog()
    audit = Audit(spark, str(tmp_path / "audit"), surface, chunk=2)
    own = Engine(spark, surface, audit=audit)
    own.execute(shop.where(m("id") < 3).select("id", "region").request(), {"caller": "a"})
    own.execute(shop.where(m("id") == 1).select("id", "region").request(), {"caller": "b"})
    assert {(r.caller, r.times) for r in audit.receivers_of("shop", {"id": 1}).collect()} == {("a", 1), ("b", 1)}
    assert audit.received_by("a").count() == 2 and audit.content.count() == 2
    assert audit.member_received_by("b", "shop", "region") and not audit.member_received_by("b", "shop", "amount")
    answer = audit.answers.where("caller = 'a'").first()
    assert sorted(r["id"] for r in audit.reconstruct(answer.answer)) == [1, 2] and audit.verify()
    shape = audit.units.first().shape
    assert {r.member for r in audit.shape(shape).collect()} == {"id", "region"} == {r.member for r in audit.catalogue().collect()}
    audit.erase(audit.received_by("b"), "officer")
    assert sorted("erased" in r for r in audit.reconstruct(answer.answer)) == [False, True] and audit.verify()
    # Streams by chunk, attachments by digest, scalars; a new writer goes on from what is stored.
    assert len(list(own.stream(shop.order_by(m("id")).select("id").request(), {"caller": "s"}))) == 5
    again = Audit(spark, str(tmp_path / "audit"), surface, chunk=2)
    Engine(spark, surface, audit=again).attachment("person", "photo", {"pid": 10}, {"caller": "s"})
    Engine(spark, surface, audit=again).execute(shop.count().request(), {"caller": "s"})
    again.reviewed("officer", "Row", source="shop", key=1)
    kinds = sorted((r.kind, r.chunk, r.rows) for r in again.answers.where("caller = 's'").collect())
    assert kinds == [("Attachment", 0, 1), ("Scalar", 0, 1), ("Stream", 0, 2), ("Stream", 1, 1)] and again.verify() and again.reviews.count() == 1
    assert again.status() | {"head": None} == {"chunks": 6, "answers": 5, "rows": 8, "erased": 1, "head": None}
    assert own.metrics[-1]["rows"] == 3 and own.metrics[-1]["outcome"] == "ok"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    audit = Audit(spark, str(tmp_path_factory.mktemp("written")), catalog())
    for caller in "abc":
        audit.record({"root": "shop"}, {"caller": caller}, "Single", [{"id": 1, "region": "North"}])
    assert audit.verify()
    return audit


@pytest.mark.parametrize("table, change", [("answers", "drop first"), ("answers", "drop last"), ("answers", "caller"), ("answers", "at"), ("units", "drop"), ("units", "address"), ("units", "stray"), ("answers", "twice")])
def test_a_forged_audit_is_told(spark, tmp_path, written, table, change):
    folder = str(tmp_path / "audit")
    shutil.copytree(written.folder, folder)
    audit = Audit(spark, folder, written.catalog)
    audit._head = written.head()
    rows = spark.createDataFrame(getattr(audit, table).collect(), getattr(audit, table).schema)
    forged = {
        "drop first": lambda: rows.where("seq > 0"), "drop last": lambda: rows.where("seq < 2"), "caller": lambda: rows.withColumn("caller", F.lit("z")), "at": lambda: rows.withColumn("at", F.expr("at + INTERVAL 1 DAY")),
        "drop": lambda: rows.limit(2), "address": lambda: rows.withColumn("address", F.lit("0")), "stray": lambda: rows.union(rows.limit(1).withColumn("answer", F.lit("x"))), "twice": lambda: rows.union(rows.limit(1)),
    }[change]()
    forged.write.mode("overwrite").parquet(f"{folder}/{table}")
    assert not audit.verify()


def test_long_answers_are_read_as_they_are_used(spark):
    own = Engine(spark, catalog(), Limits(held_rows=2))
    rows = own.execute(shop.order_by(m("id")).select("id").request())["rows"]
    assert not isinstance(rows, list) and [r["id"] for r in rows] == [1, 2, 3] == [r["id"] for r in rows]
    assert isinstance(own.execute(shop.where(m("id") < 3).select("id").request())["rows"], list)
    for small in (Limits(response_bytes=15), Limits(response_bytes=15, held_rows=1)):
        with pytest.raises(TooLarge):
            list(Engine(spark, catalog(), small).execute(shop.select("id").request())["rows"])


def test_flattened_arrays_stay_behind_their_owner(spark):
    """Nobody can name what another request flattened, hidden members of elements stay hidden, and the surface stays as it is."""
    narrow = Policy("third", lambda ctx: F.col("id") == 3)
    own = Engine(spark, catalog(shop={"policies": (narrow,), "hidden": frozenset({"secret", "lines.n", "address.zip"})}))
    stamp = own.describe()["stamp"]
    for path in ("lines",):
        assert own.execute(shop.flatten(path).request())["rows"] == []
        for name in (f"shop.{path}", path):
            with pytest.raises(ValidationError):
                own.execute(source(name).select("id", "secret").request())
    assert own.describe()["stamp"] == stamp
    seen = Engine(spark, catalog(shop={"hidden": frozenset({"secret", "lines.n", "address.zip"})}))
    assert seen.execute(shop.flatten("lines").where(m("sku") == "c").request())["rows"] == [{"sku": "c"}]
    assert seen.execute(shop.where(m("id") == 1).select("address", "lines", c=m("address.city")).request())["rows"] == [{"address": {"city": "Oslo"}, "lines": [{"sku": "a"}, {"sku": "b"}], "c": "Oslo"}]
    for query in (shop.select(z=m("address.zip")), shop.flatten("lines").select("n"), shop.where(ask("Any", "lines", where=m("n") == 1))):
        with pytest.raises(ValidationError):
            seen.execute(query.request())


def test_a_policy_that_does_not_apply_is_told_at_the_start(spark):
    Engine(spark, catalog(shop={"policies": (NORTH,)})).ready({"region": "North"})
    for bad in (Policy("none", lambda ctx: F.col("no_such_column") == 1), Policy("drops", narrow=lambda df, ctx: df.select("id"))):
        with pytest.raises(ValidationError):
            Engine(spark, catalog(shop={"policies": (bad,)})).ready({})


def test_hidden_children_refuse_where_asked(spark):
    cheap = Policy("cheap", lambda ctx: F.col("price") < 3)
    strict = Engine(spark, catalog(line={"policies": (cheap,), "denied": frozenset({"CollectionNavigation"})}))
    with pytest.raises(Forbidden):
        strict.execute(shop.select("id", n=ask("Count", "rows")).request())
    assert strict.execute(source("line").count().request())["value"] == 1


def test_receipts_are_kept_until_they_are_read(spark):
    commands = Commands(Engine(spark, catalog()), wait=0.0, at_once=2, kept=1)
    commands.register(Command("Say", {"x": int}, lambda p, ctx: p["x"]))
    ids = []
    for i in range(6):
        ids.append(commands.send("Say", {"x": i}).id)
        commands.open[ids[-1]][1].result()
    assert [commands.receipt(i, 5).result for i in ids] == list(range(6))
