"""Strict, lossless conversion of values to column types.

``coerce`` gives two expressions, the value and the error, of which one is
null. Nothing is rounded, cut or guessed, and nothing aborts the job: what does
not fit exactly is an error that names the column, the value and the type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.values import NUMBERS, Value
from tabulon.plans.spec import ColumnDef

#: Decimal literals, with optional exponent.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: ISO forms: date and time with offset, without (UTC), and a date alone.
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
_RANGE = {"INT": (-(2**31), 2**31 - 1), "LONG": (-(2**63), 2**63 - 1)}


def _is(kind, *names: str) -> Column:
    if kind is None or isinstance(kind, str):
        return F.lit(kind in names)
    return F.coalesce(kind.isin(*names), F.lit(False))


def _pick(kind, cases: list[tuple[tuple[str, ...], Column]], dtype: str) -> Column:
    """The first case that has the kind; with a known kind only that case is planned."""
    if kind is None or isinstance(kind, str):
        return next((c for names, c in cases if kind in names), F.lit(None)).cast(dtype)
    out = F.lit(None).cast(dtype)
    for names, c in reversed(cases):
        out = F.when(_is(kind, *names), c.cast(dtype)).otherwise(out)
    return out


def decimal_digits(text: Column) -> Column:
    """Fraction digits without closing zeros, of a literal without exponent."""
    return F.char_length(F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), "0+$", ""))


def whole(text: Column, kind: str) -> Column:
    """An INT or LONG of a numeric literal that is integral and in range, else null."""
    exponent = text.rlike("[eE]")
    wide = text.try_cast("decimal(38,18)")
    integral = F.when(exponent, wide == F.floor(wide)).otherwise(decimal_digits(text) == 0)
    digits = F.when(exponent, wide.try_cast("decimal(38,0)")).otherwise(F.regexp_replace(text, r"\.[0-9]*$", "").try_cast("decimal(38,0)"))
    lo, hi = _RANGE[kind]
    ok = text.rlike(NUMBER) & integral & digits.between(F.lit(lo).cast("decimal(38,0)"), F.lit(hi).cast("decimal(38,0)"))
    return F.when(ok, digits.cast("bigint"))


def exact_decimal(text: Column) -> Column:
    """``decimal(38,10)`` of a numeric literal that it holds exactly, else null."""
    out, wide = text.try_cast("decimal(38,10)"), text.try_cast("decimal(38,18)")
    ok = F.when(text.rlike("[eE]"), wide.isNull() & out.isNotNull() | (wide == out)).otherwise(decimal_digits(text) <= 10)
    return F.when(text.rlike(NUMBER) & ok, out)


def timestamp_of(text: Column) -> Column:
    """A timestamp of one of the three ISO forms, in UTC unless it says otherwise, else null."""
    text = F.regexp_replace(text, r"^([0-9-]{10}T[0-9:]{5})(?=Z|[+-]|$)", "$1:00")
    has_zone = text.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2}(:[0-9]{2})?)$")
    return F.when(text.rlike(DATETIME), F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")).when(text.rlike(DATE), F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))


def coerce(v: Value, column: ColumnDef) -> tuple[Column, Column]:
    """(value, error) of ``v`` for ``column``; null and undefined give null and no error."""
    kind, to, dtype = v.kind, column.type, column.spark_type
    text = v.text
    trimmed = F.trim(text)
    numeric = [(("str",), trimmed), (NUMBERS, text)]
    if to in ("STRING", "TEXT"):
        if to == "TEXT":
            return text, F.lit(None).cast("string")
        n = F.char_length(text)
        error = F.when(n > column.limit, F.concat(F.lit(f"column '{column.name}': value has "), n.cast("string"), F.lit(f" characters, the column allows {column.limit}")))
        return F.when(n <= column.limit, text), error
    if to == "JSON":
        # A text with NUL cannot be stored as JSON by relational targets.
        nul = v.json.contains("\\u0000")
        return F.when(~nul, v.json), F.when(nul, F.lit(f"column '{column.name}': JSON text cannot hold \\u0000"))
    if to in _RANGE:
        value = _pick(kind, [(names, whole(c, to)) for names, c in numeric], dtype)
    elif to == "DECIMAL":
        value = _pick(kind, [(names, exact_decimal(c)) for names, c in numeric], dtype)
    elif to == "DOUBLE":
        guarded = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
        own = v.col.cast("double") if not v.dynamic and isinstance(v.type, T.NumericType) else v.raw.try_cast("double")
        value = _pick(kind, [(("double",), own), (("str",), guarded(trimmed)), (("int", "long", "decimal"), guarded(text))], dtype)
    elif to == "BOOLEAN":
        low, amount = F.lower(trimmed), text.try_cast("double")
        value = _pick(kind, [(("bool",), text.try_cast("boolean")), (("str",), F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)), (NUMBERS, F.when(amount == 1, True).when(amount == 0, False))], dtype)
    elif to == "TIMESTAMP":
        own = v.col.cast("timestamp") if not v.dynamic and kind == "date" else timestamp_of(text)
        value = _pick(kind, [(("date", "timestamp"), own), (("int", "long"), F.timestamp_millis(text.try_cast("bigint"))), (("str",), timestamp_of(trimmed))], dtype)
    else:
        own = v.col if not v.dynamic and kind == "binary" else F.try_to_binary(text, F.lit("base64"))
        value = _pick(kind, [(("binary",), own), (("uuid",), F.try_to_binary(F.regexp_replace(text, "-", ""), F.lit("hex")))], dtype)
    name = F.lit(kind) if kind is None or isinstance(kind, str) else kind
    error = F.when(~v.is_null & value.isNull(), F.concat(F.lit(f"column '{column.name}': cannot convert "), name, F.lit(" '"), F.substring(text, 1, 60), F.lit(f"' to {to}")))
    return value, error
