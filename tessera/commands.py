"""Commands: named writes. A payload is bound, its policy and its rows are checked, then a handler runs.

A command that takes longer than `wait` answers Pending; its receipt tells the outcome later.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as NotYet
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.errors import CommandLimit, Forbidden, NotFound, RequestError, ValidationError
from tessera.sources.catalog import Context
from tessera.streaming.live import Changes


@dataclass(frozen=True)
class Command:
    """fields: name -> Python type. target: the source whose row the payload's key fields name.

    rows: the rows that the caller may send the command to, a condition; it is also the row's capability member.
    """

    name: str
    fields: dict[str, type]
    handler: Callable[[dict, Context], Any]
    target: str | None = None
    allow: Callable[[Context], bool] | None = None
    rows: Callable[[Context], Column] | None = None
    writes: tuple[str, ...] = ()
    check: Callable[[dict], str | None] | None = None


@dataclass
class Receipt:
    id: str
    status: str  # Completed, Failed or Pending
    result: Any = None
    error: str | None = None


class Commands:
    def __init__(self, engine: Engine, changes: Changes | None = None, wait: float = 1.0, at_once: int = 64, kept: int = 1024) -> None:
        self.engine, self.changes, self.wait, self.at_once, self.kept = engine, changes or Changes(), wait, at_once, kept
        self.known: dict[str, Command] = {}
        self.pool = ThreadPoolExecutor(8)
        self.open: dict[str, tuple[str, Future]] = {}
        self.read: dict[str, None] = {}

    def register(self, command: Command) -> None:
        self.known[command.name] = command

    def capabilities(self, source: str) -> dict[str, Callable[[Context], Column]]:
        """`Can...` members of a source, for the catalog."""
        return {f"Can{c.name}": (c.rows or (lambda ctx: F.lit(True))) for c in self.known.values() if c.target == source}

    def _bind(self, command: Command, payload: dict) -> dict:
        if set(payload) != set(command.fields):
            raise ValidationError(f"{command.name} has the fields {sorted(command.fields)}")
        for name, kind in command.fields.items():
            if not isinstance(payload[name], kind) or isinstance(payload[name], bool) and kind is not bool:
                raise ValidationError(f"{name} is a {kind.__name__}")
        problem = command.check(payload) if command.check else None
        if problem:
            raise ValidationError(problem)
        return dict(payload)

    def _target(self, command: Command, payload: dict, ctx: Context) -> None:
        source = self.engine.catalog[command.target]
        rows: DataFrame = self.engine.catalog.rows(source, self.engine.spark, ctx)
        for k in source.key:
            rows = rows.where(F.col(k) == F.lit(payload[k]))
        allowed = F.coalesce(command.rows(ctx), F.lit(False)) if command.rows else F.lit(True)
        found = rows.select(allowed.alias("allowed")).limit(1).collect()
        if not found:
            raise NotFound(f"{command.target} has no such row")
        if not found[0]["allowed"]:
            raise Forbidden(command.name)

    def send(self, name: str, payload: dict, ctx: Context | None = None) -> Receipt:
        ctx, command = ctx or {}, self.known.get(name)
        if command is None:
            raise ValidationError(f"no command {name}")
        bound = self._bind(command, payload)
        if command.allow and not command.allow(ctx):
            raise Forbidden(name)
        if command.target:
            self._target(command, bound, ctx)
        if sum(not f.done() for _, f in self.open.values()) >= self.at_once:
            raise CommandLimit(name)
        receipt = uuid.uuid4().hex

        def run() -> Any:
            out = command.handler(bound, ctx)
            if command.writes:
                self.changes.notify(*command.writes)
            return out

        self.open[receipt] = (name, self.pool.submit(run))
        return self.receipt(receipt, self.wait)

    def receipt(self, receipt: str, wait: float = 0.0) -> Receipt:
        if receipt not in self.open:
            raise NotFound(receipt)
        if self.open[receipt][1].done():  # read, so no longer held once there are many
            self.read[receipt] = None
            while len(self.read) > self.kept:
                self.open.pop(next(iter(self.read)), None) if next(iter(self.read)) != receipt else None
                self.read.pop(next(iter(self.read)))
        try:
            return Receipt(receipt, "Completed", self.open[receipt][1].result(timeout=wait))
        except NotYet:
            return Receipt(receipt, "Pending")
        except RequestError as e:
            return Receipt(receipt, "Failed", error=f"{e.code}: {e}")
        except Exception as e:  # noqa: BLE001  the handler's own
            return Receipt(receipt, "Failed", error=str(e))
