"""Live queries: an answer, and a new one whenever it differs.

A subscription runs its request, remembers which sources were read, and waits until one of them changes (a write
reports it, a probe sees a marker move, or the poll is due). Changes within `throttle` are one run. An answer is
emitted only if its fingerprint is not the last one's. Answers are whole, never differences.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.engine import Engine
from tessera.errors import SubscriptionLimit, TooLarge, ValidationError

LIVE = ("count", "longCount", "any", "first", "single")


@dataclass(frozen=True)
class LiveOptions:
    total: int = 1000
    per_caller: int = 20
    slots: int = 8
    throttle: float = 1.0
    poll: float = 30.0
    lifetime: float = 1800.0
    answer_bytes: int = 1 << 20


class Changes:
    """Who waits for which source. `publish` is where a backplane would carry names to other nodes."""

    def __init__(self) -> None:
        self.lock = threading.Condition()
        self.at: dict[str, int] = {}
        self.every = 0
        self.listeners: list[Callable[[str | None], None]] = []

    def notify(self, *sources: str) -> None:
        with self.lock:
            for s in sources:
                self.at[s] = self.at.get(s, 0) + 1
            self.lock.notify_all()
        for publish in self.listeners:
            for s in sources:
                publish(s)

    def notify_all(self) -> None:
        with self.lock:
            self.every += 1
            self.lock.notify_all()
        for publish in self.listeners:
            publish(None)

    def marks(self, sources: set[str]) -> tuple:
        return (self.every, *sorted((s, self.at.get(s, 0)) for s in sources))


def fingerprint(answer: dict, ordered: bool) -> str:
    """Of the rows in order, or of the set of rows where the query has no order."""
    rows = answer.get("rows")
    if rows is None or ordered:
        text = json.dumps(answer, sort_keys=True, default=str)
    else:
        text = json.dumps(sorted(json.dumps(r, sort_keys=True, default=str) for r in rows))
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Hub:
    engine: Engine
    changes: Changes = field(default_factory=Changes)
    options: LiveOptions = field(default_factory=LiveOptions)
    probe: Callable[[], object] | None = None

    def __post_init__(self) -> None:
        self.running = threading.Semaphore(self.options.slots)
        self.held: dict[str, int] = {}
        self.lock = threading.Lock()

    def _enter(self, caller: str) -> None:
        with self.lock:
            if sum(self.held.values()) >= self.options.total or self.held.get(caller, 0) >= self.options.per_caller:
                raise SubscriptionLimit(caller)
            self.held[caller] = self.held.get(caller, 0) + 1

    def _leave(self, caller: str) -> None:
        with self.lock:
            self.held[caller] -= 1

    def subscribe(self, request: dict, ctx: dict | None = None, resume_from: str | None = None, stop: threading.Event | None = None) -> Iterator[dict]:
        """{"result", "id"} of each new answer, {"unchanged"} if the first is the one resumed from, {"end"} at last."""
        ctx, stop, opts = ctx or {}, stop or threading.Event(), self.options
        kinds = [x["$type"] for x in request["pipeline"]]
        last_kind = kinds[-1] if kinds else ""
        if last_kind in ("page", "last", "all", "aggregate"):
            raise ValidationError(f"{last_kind} is not live")
        caller = str(ctx.get("caller", ""))
        self._enter(caller)
        try:
            known, first, until = resume_from, True, time.monotonic() + opts.lifetime
            while not stop.is_set() and time.monotonic() < until:
                with self.changes.lock:  # before the run, so that no change falls between
                    every, at = self.changes.every, dict(self.changes.at)
                marker = self.probe() if self.probe else None
                began = time.monotonic()
                with self.running:
                    answer, reads = self.engine.answer(request, ctx)
                mark = fingerprint(answer, "orderBy" in kinds)
                if len(json.dumps(answer, default=str)) > opts.answer_bytes:
                    raise TooLarge("a live answer is too large")
                if mark != known:
                    yield {"result": answer, "id": mark}
                elif first:
                    yield {"unchanged": mark}
                known, first = mark, False
                before = (every, *sorted((s, at.get(s, 0)) for s in reads))
                self._wait(reads, before, marker, began, stop, until)
            yield {"end": known}
        finally:
            self._leave(caller)

    def _wait(self, reads: set[str], before: tuple, marker: object, began: float, stop: threading.Event, until: float) -> None:
        due = min(began + self.options.poll, until)
        while not stop.is_set() and time.monotonic() < due:
            with self.changes.lock:
                if self.changes.marks(reads) != before:
                    break
                self.changes.lock.wait(min(0.2, max(0.0, due - time.monotonic())))
            if self.probe and self.probe() != marker:
                break
        pause = began + self.options.throttle - time.monotonic()
        if pause > 0:
            stop.wait(pause)


def reported(changes: Changes, source: str, write: Callable[[], object]) -> object:
    """Runs a write and reports the source after it has succeeded."""
    out = write()
    changes.notify(source)
    return out


def watch_files(stream: DataFrame, changes: Changes, source: str, checkpoint: str, seconds: float = 1.0):
    """A Structured Streaming query over a source's files that reports the source for each batch with rows."""

    def seen(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            changes.notify(source)

    return stream.writeStream.foreachBatch(seen).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
