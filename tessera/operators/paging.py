"""Keyset pages: the rows after a cursor, in an order that ends in the key, one row more than asked for."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.operators.pipeline import Rows
from tessera.plans.nodes import segments
from tessera.plans.validate import Limits


def seal(payload: dict, secret: bytes) -> str:
    """Signed, not encrypted: whoever holds a cursor can read the key of the row it stands at."""
    body = json.dumps(payload, sort_keys=True, default=str).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode().rstrip("=")


def unseal(cursor: str, secret: bytes) -> dict:
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    except ValueError as e:
        raise ValidationError("no cursor") from e
    if not hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()):
        raise ValidationError("the cursor is not ours")
    return json.loads(raw[32:])


def seekable(rows: Rows) -> list[tuple[str, bool]] | None:
    """The order as member names and directions, ending in the key; null where a cursor cannot resume it."""
    source = rows.scope.source
    if not source.key or rows.narrowed or rows.final is not None or not rows.order_nodes or len(rows.order_nodes) != len(rows.order):
        return None
    out = []
    for node, descending in rows.order_nodes:
        if node["$type"] != "member" or len(segments(node["path"])) != 1:
            return None
        field = source.fields.get(segments(node["path"])[0])
        if field is None or field.nullable or field.name in source.enums or isinstance(field.dataType, (T.BinaryType, T.BooleanType, T.ArrayType, T.StructType)):
            return None
        out.append((field.name, descending))
    return [*out, *((k, False) for k in source.key if k not in [n for n, _ in out])]


def after(keys: list[tuple[str, bool]], values: list[Column]) -> Column:
    """OR over i of: the first i keys are equal and the next is beyond."""
    out = F.lit(False)
    for i, (name, descending) in enumerate(keys):
        step = F.col(name) < values[i] if descending else F.col(name) > values[i]
        for (n, _), v in list(zip(keys, values, strict=True))[:i]:
            step = (F.col(n) == v) & step
        out = out | step
    return out


def binding(request: dict, keys: list[tuple[str, bool]]) -> str:
    """A cursor belongs to a source, the steps before the page, and an order."""
    steps = [x for x in request["pipeline"] if x["$type"] != "page"]
    return hashlib.sha256(json.dumps([request["root"], steps, keys], sort_keys=True).encode()).hexdigest()[:24]


def page_frame(rows: Rows, request: dict, op: dict, limits: Limits, secret: bytes) -> tuple[DataFrame, int, list[tuple[str, bool]] | None]:
    """The rows of a page and one more, with the cursor's keys as `__c0`..; the page size; the keys."""
    size = min(op.get("size") or limits.default_page, limits.page_size)
    keys = seekable(rows)
    if op.get("cursor"):
        if keys is None:
            raise ValidationError("this order cannot be resumed")
        held = unseal(op["cursor"], secret)
        if held["b"] != binding(request, keys):
            raise ValidationError("the cursor belongs to another query")
        fields = rows.scope.source.fields
        rows.scope.df = rows.scope.df.where(after(keys, [F.lit(v).cast(fields[n].dataType) for (n, _), v in zip(keys, held["v"], strict=True)]))
    if keys:
        rows.order = [(F.col(n), d) for n, d in keys]
    from tessera.operators.pipeline import projected

    if rows.final is None:
        projected(rows)
        extra = [F.col(n).alias(f"__c{i}") for i, (n, _) in enumerate(keys or [])]
        return rows.sorted().select(*rows._columns, *extra).limit(size + 1), size, keys
    return rows.answer(size + 1), size, keys


def page_of(found: list, size: int, keys: list[tuple[str, bool]] | None, request: dict, secret: bytes) -> dict[str, Any]:
    more = len(found) > size
    cursor = None
    if more and keys:
        last = found[size - 1]
        values = [last[f"__c{i}"] for i in range(len(keys))]
        cursor = seal({"b": binding(request, keys), "v": [v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat() if isinstance(v, dt.date) else v for v in values]}, secret)
    items = [{k: v for k, v in r.asDict(recursive=True).items() if not k.startswith("__c")} for r in found[:size]]
    return {"items": items, "hasMore": more, "cursor": cursor}
