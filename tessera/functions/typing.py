"""Numeric promotion and how constants are read."""

from __future__ import annotations

import base64
import datetime as dt
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError

RANK: list[type] = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType]
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_number(t: T.DataType) -> bool:
    return type(t) in RANK


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The wider operand's type; small integers work as int, and decimals meet in a decimal that holds both."""
    if not (is_number(a) and is_number(b)):
        raise ValidationError(f"no arithmetic on {a.simpleString()} and {b.simpleString()}")
    wide, other = sorted((a, b), key=lambda t: RANK.index(type(t)), reverse=True)
    if isinstance(wide, (T.ByteType, T.ShortType)):
        return T.IntegerType()
    if isinstance(wide, T.DecimalType):
        scale = max(wide.scale, other.scale if isinstance(other, T.DecimalType) else 0)
        return T.DecimalType(38 if scale > 18 else 28, scale)
    return wide


_OWN = {"String": T.StringType(), "Boolean": T.BooleanType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "Decimal": T.DecimalType(28, 6), "Double": T.DoubleType(), "DateTime": T.TimestampNTZType(), "DateOnly": T.DateType(), "Guid": T.StringType(), "Bytes": T.BinaryType(), "Enum": T.StringType()}


def constant(node: dict, wanted: T.DataType | None = None) -> Column:
    """A constant read at the type of what it is compared with; a number that does not fit keeps its own type."""
    tag, text = node["tag"], node.get("value")
    if tag == "Null" or text is None:
        return F.lit(None).cast(wanted) if wanted else F.lit(None)
    own = _OWN[tag]
    target = wanted if wanted is not None else own
    if is_number(target) and is_number(own) and not _fits(text, target):
        target = own
    try:
        return _read(text, target)
    except (ValueError, InvalidOperation) as e:
        raise ValidationError(f"{text!r} is no {target.simpleString()}") from e


def constant_type(node: dict, wanted: T.DataType | None = None) -> T.DataType:
    """The type of the column that `constant` makes, without asking Spark."""
    if node["tag"] == "Null" or node.get("value") is None:
        return wanted or T.NullType()
    own = _OWN[node["tag"]]
    target = wanted if wanted is not None else own
    if is_number(target) and is_number(own) and not _fits(node["value"], target):
        target = own
    known = isinstance(target, (T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))
    return target if known else T.StringType()


def _fits(text: str, t: T.DataType) -> bool:
    if isinstance(t, INTEGERS):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(t)]
        n = Decimal(text)
        return n == n.to_integral_value() and -(2**bits) <= n < 2**bits
    return not isinstance(t, T.DecimalType) or -Decimal(text).as_tuple().exponent <= t.scale


def _read(text: str, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        if text.lower() not in ("true", "false"):
            raise ValueError(text)
        return F.lit(text.lower() == "true")
    if isinstance(t, INTEGERS):
        return F.lit(int(Decimal(text))).cast(t)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.lit(float(text)).cast(t)
    if isinstance(t, T.DecimalType):
        return F.lit(Decimal(text)).cast(t)
    if isinstance(t, T.DateType):
        return F.lit(dt.date.fromisoformat(text[:10]))
    if isinstance(t, T.TimestampNTZType):
        return F.lit(dt.datetime.fromisoformat(text).replace(tzinfo=None).isoformat(sep=" ")).cast(t)
    if isinstance(t, T.TimestampType):
        return F.lit(text).cast(t)
    if isinstance(t, T.BinaryType):
        return F.lit(base64.b64decode(text))
    return F.lit(text)
