"""The scalar functions: what each accepts and the Column it stands for.

A builder takes the target and argument Columns and their types. Everything is built-in functions, so that a
query stays in generated code. Where Spark's function of that name means something else, the builder says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.functions.typing import INTEGERS, is_number, promoted

Types = list[T.DataType]
Builder = Callable[[list[Column], Types], Column]


@dataclass(frozen=True)
class Function:
    least: int  # arguments beside the target
    most: int
    accepts: Callable[[T.DataType], bool]
    build: Builder


FUNCTIONS: dict[str, Function] = {}
_STRING = (T.StringType, T.CharType, T.VarcharType)
_text = lambda t: isinstance(t, _STRING)
_dated = lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
_timed = lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType))
_span = lambda t: isinstance(t, T.DayTimeIntervalType)
_bytes = lambda t: isinstance(t, T.BinaryType)
_any = lambda t: True


def _add(name: str, accepts, build: Builder, least: int = 0, most: int | None = None) -> None:
    FUNCTIONS[name] = Function(least, least if most is None else most, accepts, build)


def _int(c: Column) -> Column:
    return c.cast("int")


# Text. Patterns are literal, never wildcards.
_add("StringContains", _text, lambda c, t: c[0].contains(c[1]), 1)
_add("StringStartsWith", _text, lambda c, t: c[0].startswith(c[1]), 1)
_add("StringEndsWith", _text, lambda c, t: c[0].endswith(c[1]), 1)
_add("StringToLower", _text, lambda c, t: F.lower(c[0]))
_add("StringToUpper", _text, lambda c, t: F.upper(c[0]))
_add("StringIsNullOrEmpty", _text, lambda c, t: F.coalesce(c[0] == "", F.lit(True)))
_add("StringIsNullOrWhiteSpace", _text, lambda c, t: F.coalesce(F.regexp_replace(c[0], r"\s", "") == "", F.lit(True)))
_add("StringLength", _text, lambda c, t: F.length(c[0]))
_add("StringTrim", _text, lambda c, t: F.trim(c[0]))  # spaces, as the database does
_add("StringTrimStart", _text, lambda c, t: F.ltrim(c[0]))
_add("StringTrimEnd", _text, lambda c, t: F.rtrim(c[0]))
_add("StringSubstring", _text, lambda c, t: F.substr(c[0], c[1] + 1, *c[2:3]), 1, 2)
_add("StringIndexOf", _text, lambda c, t: F.call_function("locate", c[1], c[0]) - 1, 1)
_add("StringReplace", _text, lambda c, t: F.replace(c[0], c[1], c[2]), 2)
_add("StringFirst", _text, lambda c, t: F.left(c[0], F.lit(1)))
_add("StringLast", _text, lambda c, t: F.right(c[0], F.lit(1)))
_add("StringConcat", _text, lambda c, t: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in c]), 1, 8)


def _written(c: list[Column], t: Types) -> Column:
    if isinstance(t[0], T.BooleanType):
        return F.when(c[0], "True").when(~c[0], "False")
    if isinstance(t[0], (T.DoubleType, T.FloatType)):  # no `.0` behind whole numbers
        return F.regexp_replace(c[0].cast("string"), r"\.0$", "")
    return c[0].cast("string")


_add("StringFrom", _any, _written)

# Dates and times.
for _n, _f in {"Year": F.year, "Month": F.month, "Day": F.dayofmonth, "DayOfYear": F.dayofyear}.items():
    _add(f"Date{_n}", _dated, lambda c, t, f=_f: f(c[0]))
for _n, _f in {"Hour": F.hour, "Minute": F.minute, "Second": F.second}.items():
    _add(f"Date{_n}", _timed, lambda c, t, f=_f: f(c[0]))


def _micros(c: Column) -> Column:
    """Microseconds within the second."""
    return _int((F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long") % 1_000_000)


_add("DateMillisecond", _timed, lambda c, t: _int(F.call_function("div", _micros(c[0]), F.lit(1000))))
_add("DateMicrosecond", _timed, lambda c, t: _micros(c[0]) % 1000)
_add("DateNanosecond", _timed, lambda c, t: F.when(c[0].isNotNull(), 0))  # Spark's clock stops at microseconds
_add("DateDayNumber", _dated, lambda c, t: F.unix_date(F.to_date(c[0])) + 719162)
_add("DateDayOfWeek", _dated, lambda c, t: F.dayofweek(c[0]) - 1)
_add("DateDate", _timed, lambda c, t: F.date_trunc("DAY", c[0]).cast(t[0]))
_add("DateTimeOfDay", _timed, lambda c, t: c[0] - F.date_trunc("DAY", c[0]).cast(t[0]))
for _n, _f in {"Hours": "HOUR", "Minutes": "MINUTE"}.items():
    _add(f"TimeSpan{_n}", _span, lambda c, t, f=_f: _int(F.date_part(F.lit(f), c[0])))
_span_micros = lambda c: (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
_add("TimeSpanSeconds", _span, lambda c, t: _int(F.call_function("div", _span_micros(c[0]), F.lit(1_000_000))))
_add("TimeSpanMilliseconds", _span, lambda c, t: _int(F.call_function("div", _span_micros(c[0]) % 1_000_000, F.lit(1000))))
_add("TimeSpanMicroseconds", _span, lambda c, t: _int(_span_micros(c[0]) % 1000))
_add("TimeSpanNanoseconds", _span, lambda c, t: F.when(c[0].isNotNull(), 0))
_add("DateOnlyFromDateTime", _timed, lambda c, t: F.to_date(c[0]))
_add("TimeOnlyFromDateTime", _timed, lambda c, t: F.call_function("to_time", F.date_format(c[0], "HH:mm:ss.SSSSSS")))
_add("TimeOnlyFromTimeSpan", _span, lambda c, t: F.call_function("make_time", F.date_part(F.lit("HOUR"), c[0]), F.date_part(F.lit("MINUTE"), c[0]), F.date_part(F.lit("SECOND"), c[0])))
_add("DateTimeFromDateAndTime", lambda t: isinstance(t, T.DateType), lambda c, t: F.call_function("make_timestamp_ntz", c[0], c[1]), 1)
_add("UnixSecondsFromOffset", _timed, lambda c, t: F.unix_seconds(c[0].cast("timestamp")))
_add("UnixMillisecondsFromOffset", _timed, lambda c, t: F.unix_millis(c[0].cast("timestamp")))


def _months(factor: int) -> Builder:
    def build(c: list[Column], t: Types) -> Column:
        if isinstance(t[0], T.DateType):
            return F.add_months(c[0], _int(c[1]) * factor)
        return (c[0] + F.make_ym_interval(F.lit(0), _int(c[1]) * factor)).cast(t[0])

    return build


def _later(micros: int) -> Builder:
    """Adds a possibly fractional number of units, to the microsecond."""

    def build(c: list[Column], t: Types) -> Column:
        whole = F.round(c[1].cast("double") * micros).cast("long")
        if isinstance(t[0], T.DateType):
            return F.date_add(c[0], _int(F.call_function("div", whole, F.lit(86_400_000_000))))
        seconds = (whole.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        return c[0] + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)

    return build


_add("DateAddYears", _dated, _months(12), 1)
_add("DateAddMonths", _dated, _months(1), 1)
_add("DateAddDays", _dated, _later(86_400_000_000), 1)
for _n, _f in {"Hours": 3_600_000_000, "Minutes": 60_000_000, "Seconds": 1_000_000, "Milliseconds": 1000}.items():
    _add(f"DateAdd{_n}", _timed, _later(_f), 1)

# Numbers. Results keep the operand's type, which Spark's ceil and floor do not.
_add("MathAbs", is_number, lambda c, t: F.abs(c[0]))
_add("MathCeiling", is_number, lambda c, t: F.ceil(c[0]).cast(t[0]))
_add("MathFloor", is_number, lambda c, t: F.floor(c[0]).cast(t[0]))
_add("MathRound", is_number, lambda c, t: F.call_function("round", *c).cast(t[0]), 0, 1)  # halves go away from zero
_add("MathTruncate", is_number, lambda c, t: F.when(c[0] < 0, F.ceil(c[0])).otherwise(F.floor(c[0])).cast(t[0]))
_add("MathSign", is_number, lambda c, t: _int(F.sign(c[0])))
for _n, _f in {"Sqrt": F.sqrt, "Exp": F.exp, "Log10": F.log10, "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Asin": F.asin, "Acos": F.acos, "Atan": F.atan}.items():
    _add(f"Math{_n}", is_number, lambda c, t, f=_f: f(c[0].cast("double")))
_add("MathPow", is_number, lambda c, t: F.pow(c[0].cast("double"), c[1].cast("double")), 1)
_add("MathLog", is_number, lambda c, t: F.call_function("log", c[1].cast("double"), c[0].cast("double")) if len(c) > 1 else F.ln(c[0].cast("double")), 0, 1)
_add("MathAtan2", is_number, lambda c, t: F.atan2(c[0].cast("double"), c[1].cast("double")), 1)
_add("MathDegreesToRadians", is_number, lambda c, t: F.radians(c[0].cast("double")))
_add("MathRadiansToDegrees", is_number, lambda c, t: F.degrees(c[0].cast("double")))


def _extreme(pick: Callable[..., Column]) -> Builder:
    """Null if either is, unlike Spark's greatest and least."""

    def build(c: list[Column], t: Types) -> Column:
        wide = promoted(t[0], t[1])
        return F.when(c[0].isNotNull() & c[1].isNotNull(), pick(c[0].cast(wide), c[1].cast(wide)))

    return build


_add("MathMax", is_number, _extreme(F.greatest), 1)
_add("MathMin", is_number, _extreme(F.least), 1)

# Membership, flags, comparison.


def _in(c: list[Column], t: Types) -> Column:
    if len(c) == 1:
        return F.lit(False)
    nulls = [x for x, k in zip(c[1:], t[1:], strict=True) if isinstance(k, T.NullType)]
    values = [x for x, k in zip(c[1:], t[1:], strict=True) if not isinstance(k, T.NullType)]
    found = F.coalesce(c[0].isin(*values), F.lit(False)) if values else F.lit(False)
    return found | c[0].isNull() if nulls else found


_add("In", _any, _in, 0, 1000)
_add("EnumHasFlag", lambda t: isinstance(t, INTEGERS), lambda c, t: c[0].bitwiseAND(c[1]) == c[1], 1)
_add("CompareTo", _any, lambda c, t: F.when(c[0].isNull() | c[1].isNull(), None).when(c[0] < c[1], -1).when(c[0] > c[1], 1).otherwise(0).cast("int"), 1)

# Conversions: from text, or to a wider number. Text that does not parse fails.


def _convert(name: str, target: T.DataType) -> None:
    def build(c: list[Column], t: Types) -> Column:
        if not isinstance(t[0], _STRING) and (not is_number(t[0]) or not is_number(target) or promoted(t[0], target) != promoted(target, target)):
            raise ValidationError(f"{name} reads text or a narrower number, no {t[0].simpleString()}")
        return c[0].cast(target)

    _add(name, lambda t: _text(t) or is_number(t), build)


for _n, _f in {"Int32": T.IntegerType(), "Int64": T.LongType(), "Decimal": T.DecimalType(38, 18), "Double": T.DoubleType(), "Boolean": T.BooleanType(), "Byte": T.ShortType(), "Int16": T.ShortType(), "Single": T.FloatType()}.items():
    _convert(f"{_n}From", _f)

# Bytes.
_add("BytesLength", _bytes, lambda c, t: F.octet_length(c[0]))
_byte = lambda c, i: F.conv(F.hex(F.substring(c, i, 1)), 16, 10).cast("smallint")
_add("BytesContains", _bytes, lambda c, t: F.when(c[0].isNotNull(), F.coalesce(F.exists(F.sequence(F.lit(1), F.greatest(F.octet_length(c[0]), F.lit(1))), lambda i: _byte(c[0], i) == c[1]), F.lit(False))), 1)
_add("BytesElementAt", _bytes, lambda c, t: _byte(c[0], c[1] + 1), 1)


def call(name: str, columns: list[Column], types: Types) -> Column:
    function = FUNCTIONS.get(name)
    if function is None:
        raise ValidationError(f"no function {name}")
    if not function.least <= len(columns) - 1 <= function.most:
        raise ValidationError(f"{name} takes {function.least} to {function.most} arguments")
    if not function.accepts(types[0]):
        raise ValidationError(f"{name} does not read {types[0].simpleString()}")
    return function.build(columns, types)
