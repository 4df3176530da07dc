"""Runs requests: checks them, narrows sources for the caller, lowers them to DataFrames, and shapes the answer."""

from __future__ import annotations

import contextlib
import hashlib
import hmac
import json
import logging
import secrets
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Forbidden, NotFound, RequestError, StaleClient, TooLarge, ValidationError
from tessera.operators.paging import page_frame, page_of
from tessera.operators.pipeline import FOLDS, OPERATORS, PICKS, Rows, fold, one, pick
from tessera.operators.scope import Reads, Scope
from tessera.plans.validate import Limits, validate
from tessera.sources.catalog import Catalog, Context, Source

log = logging.getLogger("tessera")


class Spilled:
    """Rows of a long list answer: each iteration runs the query and holds one partition."""

    def __init__(self, rows: Callable[[], Iterator[dict]]) -> None:
        self._rows = rows

    def __iter__(self) -> Iterator[dict]:
        return self._rows()


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, limits: Limits | None = None, secret: bytes | None = None, audit: Any = None) -> None:
        self.spark, self.catalog, self.limits = spark, catalog, limits or Limits()
        self.secret, self.audit = secret or secrets.token_bytes(32), audit
        self.metrics: list[dict] = []

    # Lowering

    def _lower(self, request: dict, ctx: Context) -> tuple[Rows, dict | None]:
        """Rows after all operators but the terminal, and the terminal."""
        validate(request, self.limits)
        if request.get("stamp") and request["stamp"] != self.catalog.stamp():
            raise StaleClient("the client was made for another surface")
        source = self.catalog[request["root"]]
        rows = Rows(Scope(self.catalog, source, self.catalog.rows(source, self.spark, ctx), ctx))
        for op in request["pipeline"]:
            if op["$type"] not in OPERATORS:
                return rows, op
            OPERATORS[op["$type"]](rows, op)
        return rows, None

    def frame(self, request: dict, ctx: Context | None = None) -> DataFrame:
        """The answer as a frame: rows, one row with `value`, or the rows of a page. Nothing runs yet."""
        return self._frame(request, ctx or {})[0]

    def _frame(self, request: dict, ctx: Context) -> tuple[DataFrame, dict | None, Any, Reads]:
        rows, op = self._lower(request, ctx)
        kind = op["$type"] if op else None
        shape = None
        if kind in FOLDS:
            df = fold(rows, op)
        elif kind in PICKS:
            df = pick(rows, op)
        elif kind == "page":
            df, size, keys = page_frame(rows, request, op, self.limits, self.secret)
            shape = (size, keys)
        else:
            df = rows.answer()
        return df, op, shape, rows.scope.reads

    # Answers

    def execute(self, request: dict, ctx: Context | None = None) -> dict:
        """{kind, value|rows|row|items...}; kinds are List, Scalar, Single and Page."""
        return self.answer(request, ctx or {})[0]

    def answer(self, request: dict, ctx: Context) -> tuple[dict, Reads]:
        """An answer and the sources it was read from."""
        with self._recorded(request, ctx) as span:
            df, op, shape, reads = self._frame(request, ctx)
            self._refuse_hidden(request, reads, ctx)
            kind = op["$type"] if op else None
            if kind is None:
                out = self._list(df, request, ctx, span)
                return out, reads
            found = df.collect()
            span["rows"] = len(found)
            if kind in FOLDS:
                out = {"kind": "Scalar", "value": found[0]["value"]}
                sent = [{"value": out["value"]}]
            elif kind in PICKS:
                out = {"kind": "Single", "row": one(found, op)}
                sent = [out["row"]] if out["row"] else []
            else:
                out = {"kind": "Page"} | page_of(found, *shape, request, self.secret)
                sent = out["items"]
            if self.audit:
                self.audit.record(request, ctx, out["kind"], sent)
        return out, reads

    def _list(self, df: DataFrame, request: dict, ctx: Context, span: dict) -> dict:
        """A list's rows: a Python list up to `held_rows`, beyond it an iterable that holds one partition at a time."""
        most = self.limits.held_rows
        found = df.limit(most + 1).collect()
        if len(found) <= most:
            rows = list(self._sent((r.asDict(recursive=True) for r in found), request, ctx, "List", None))
            span["rows"] = len(rows)
            return {"kind": "List", "rows": rows}
        return {"kind": "List", "rows": Spilled(lambda: self._sent(self._each(df), request, ctx, "List", None))}

    @staticmethod
    def _each(df: DataFrame) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))

    def _sent(self, rows: Iterator[dict], request: dict, ctx: Context, kind: str, most: int | None) -> Iterator[dict]:
        """Rows as they leave: within the limits on their number and bytes, and audited before they do."""
        yield from self.audit.recorded(request, ctx, kind, self._bounded(rows, most)) if self.audit else self._bounded(rows, most)

    def _bounded(self, rows: Iterator[dict], most: int | None) -> Iterator[dict]:
        size = 0
        for count, row in enumerate(rows, 1):
            if most and count > most:
                raise TooLarge(f"a stream has {most} rows at most")
            if self.limits.response_bytes:
                size += len(json.dumps(row, default=str))
                if size > self.limits.response_bytes:
                    raise TooLarge(f"an answer has {self.limits.response_bytes} bytes at most")
            yield row

    def stream(self, request: dict, ctx: Context | None = None) -> Iterator[dict]:
        """Rows as they come, between a begin and an end marker; without the end the answer is not whole."""
        ctx = ctx or {}
        with self._recorded(request, ctx) as span:
            df, op, _, reads = self._frame(request, ctx)
            if op:
                raise ValidationError("only rows are streamed")
            self._refuse_hidden(request, reads, ctx)
            yield {"begin": df.columns}
            for row in self._sent(self._each(df), request, ctx, "Stream", self.limits.stream_rows):
                span["rows"] += 1
                yield {"row": row}
            yield {"end": span["rows"]}

    def batch(self, requests: list[dict], ctx: Context | None = None) -> list[dict]:
        """Independent answers, one after the other; one that fails leaves the others alone."""
        if len(requests) > self.limits.batch:
            raise TooLarge(f"a batch has {self.limits.batch} entries at most")
        out = []
        for r in requests:
            try:
                out.append({"ok": self.execute(r, ctx)})
            except RequestError as e:
                out.append({"error": e.code, "message": str(e)})
        return out

    def explain(self, request: dict, ctx: Context | None = None) -> str:
        """Spark's plan of a request that answers rows."""
        df, op, _, _ = self._frame(request, ctx or {})
        if op:
            raise ValidationError("only rows are explained")
        return df._jdf.queryExecution().toString()

    def describe(self) -> dict:
        return {"stamp": self.catalog.stamp(), "sources": self.catalog.describe()}

    def etag(self, request: dict, ctx: Context | None, freshness: str) -> str:
        """Changes with the surface, the data's freshness, the request and the caller."""
        text = json.dumps([self.catalog.stamp(), freshness, request, ctx or {}], sort_keys=True, default=str)
        return '"' + hmac.new(self.secret, text.encode(), hashlib.sha256).hexdigest()[:32] + '"'

    def execute_if_changed(self, request: dict, ctx: Context | None, freshness: str, known: str | None) -> tuple[str, dict | None]:
        """(etag, answer), the answer None if the caller's etag still holds."""
        tag = self.etag(request, ctx, freshness)
        return (tag, None) if tag == known else (tag, self.execute(request, ctx))

    def attachment(self, source: str, member: str, key: dict[str, Any], ctx: Context | None = None) -> bytes | None:
        """A member that no query reads, of one row that the caller may see."""
        own, ctx = self.catalog[source], ctx or {}
        if member not in own.attachments or set(key) != set(own.key):
            raise ValidationError(f"{source} has no attachment {member} under that key")
        if own.attachment_policy and not own.attachment_policy(ctx, key):
            raise Forbidden(f"{source}.{member}")
        rows = self.catalog.rows(own, self.spark, ctx)
        for k, v in key.items():
            rows = rows.where(F.col(k) == F.lit(v))
        found = rows.select(member).limit(1).collect()
        if not found:
            raise NotFound(f"{source} has no such row")
        content = None if found[0][0] is None else bytes(found[0][0])
        if self.audit:  # by digest: the bytes are where they were
            sent = key | {member: None if content is None else hashlib.sha256(content).hexdigest()}
            self.audit.record({"root": own.name, "attachment": member, "key": key}, ctx, "Attachment", [sent])
        return content

    def ready(self, ctx: Context) -> None:
        """Fails before any caller does if a policy does not apply: its frame must keep the source's columns.

        A policy is also applied in the place of each link and collection that reaches its source. Nothing is read.
        """
        for source in self.catalog.sources.values():
            try:
                made = self.catalog.rows(source, self.spark, ctx).columns
                if not set(source.fields) <= set(made):
                    raise ValidationError(f"its policies leave {made}")
                for name in source.links:
                    Scope(self.catalog, source, self.catalog.rows(source, self.spark, ctx), ctx)._link(source, (name,))
                for children in source.children.values():
                    Scope(self.catalog, source, self.catalog.rows(source, self.spark, ctx), ctx).open(children.target, children=True)
            except Exception as e:
                raise ValidationError(f"{source.name} is not ready: {e}") from e

    def sensitive(self, request: dict) -> bool:
        """Whether a request names a member that may be in no URL and no cache."""
        text = json.dumps(request)
        return any(f'"{m}"' in text for s in self.catalog.sources.values() for m in s.sensitive)

    # Around an answer

    def _refuse_hidden(self, request: dict, reads: Reads, ctx: Context) -> None:
        """Where a source asks for it, rows that a policy hides refuse the request rather than go missing."""
        pick_one = request["pipeline"][-1]["$type"] in PICKS if request["pipeline"] else False
        root = self.catalog[request["root"]]
        for name in sorted(reads):
            source = self.catalog[name]
            position = ("RootSingle" if pick_one else "RootList") if source.name == root.name else "CollectionNavigation" if name in reads.collections else "Navigation"
            if position in source.denied:
                self._probe(source, request if source.name == root.name else None, ctx)

    def _probe(self, source: Source, request: dict | None, ctx: Context) -> None:
        open_catalog = self.catalog.with_(source.name, policies=(), denied=frozenset())
        if request is None:
            whole, seen = open_catalog.rows(open_catalog[source.name], self.spark, ctx), self.catalog.rows(source, self.spark, ctx)
        else:
            filters = [x for x in request["pipeline"] if x["$type"] == "where"] + [{"$type": "where", "predicate": x["predicate"]} for x in request["pipeline"][-1:] if x["$type"] in PICKS and "predicate" in x]
            asked = {"version": 1, "root": source.name, "pipeline": filters}
            whole, seen = (Engine(self.spark, c, self.limits).frame(asked, ctx) for c in (open_catalog, self.catalog))
        key = [k for k in source.key if k in whole.columns]
        if key and len(key) == len(source.key):  # a key says which rows are missing, and the first one is enough
            missing = whole.select(*key).join(seen.select(*key), key, "left_anti")
            hidden = not missing.isEmpty()
        else:
            hidden = whole.count() > seen.count()
        if hidden:
            raise Forbidden(f"{source.name} has rows that this caller may not see")

    @contextlib.contextmanager
    def _recorded(self, request: dict, ctx: Context):
        """Duration, rows and outcome of each request, logged and kept."""
        span, began = {"root": request.get("root") if isinstance(request, dict) else None, "outcome": "ok", "rows": 0}, time.perf_counter()
        try:
            yield span
        except RequestError as e:
            span["outcome"] = e.code
            raise
        except Exception:
            span["outcome"] = "ExecutionFailed"
            raise
        finally:
            span["seconds"] = time.perf_counter() - began
            self.metrics.append(span)
            log.info("query %s", span)
