"""Kinds of values and their canonical text: what digests, comparisons and byte costs are taken of.

NULL stays NULL. What has no canonical form (NaN, infinity, years outside 1 to 9999, fractions of a second below the
microsecond, nested values) is refused by category when it is read; nothing is rounded or cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .digest import KINDS, MaskError


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.DecimalType):
        return "uint" if (t.precision, t.scale) == (20, 0) else "decimal"
    for kind, types in (("text", (T.StringType, T.VarcharType, T.CharType)), ("bytes", T.BinaryType), ("bool", T.BooleanType), ("date", T.DateType), ("datetime", T.TimestampNTZType), ("instant", T.TimestampType), ("float", (T.DoubleType, T.FloatType)), ("int", T.IntegralType), ("null", T.NullType)):
        if isinstance(t, types):
            return kind
    raise MaskError("unsupported: kind")


def _refuse(what: str) -> Column:
    return F.raise_error(F.lit(f"invalid: {what}"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _float(c: Column) -> Column:
    """Shortest digits; an exponent, of two digits at least, below 1e-4 and from 1e6 (as %g with these digits).

    The JVM gives the digits, two at least (so the least number of all has 4.9), and before Java 19 now and then one
    more than needed; they are only placed anew."""

    def placed(x: Column) -> Column:
        digits, e = x["digits"], x["e"]
        n, up = F.length(digits), F.abs(e).cast("string")
        point = lambda at: F.concat(digits.substr(F.lit(1), at), F.when(n > at, F.concat(F.lit("."), digits.substr(at + 1, n))).otherwise(""))
        power = F.concat(point(F.lit(1)), F.when(e < 0, "e-").otherwise("e+"), F.lpad(up, F.greatest(F.length(up), F.lit(2)), F.lit("0")))
        plain = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).when(n <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(point(e + 1))
        return F.when(digits == "", "0").when(~e.between(-4, 5), power).otherwise(plain)

    def parts(x: Column) -> Column:
        every = F.concat(x["whole"], x["part"])
        after = F.ltrim(every, F.lit("0"))
        e = x["power"] + F.length(x["whole"]) - 1 - (F.length(every) - F.length(after))
        return F.struct(F.rtrim(after, F.lit("0")).alias("digits"), e.alias("e"))

    found = lambda t, pattern: F.regexp_extract(t, r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", pattern)
    text = c.cast("string")
    read = F.struct(found(text, 1).alias("whole"), found(text, 2).alias("part"), F.coalesce(found(text, 3).try_cast("int"), F.lit(0)).alias("power"))
    number = F.concat(F.when(text.startswith("-"), "-").otherwise(""), _let(_let(read, parts), placed))
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), _refuse("not finite")).otherwise(number)


def _date(c: Column) -> Column:
    return F.when(~F.year(c).between(1, 9999), _refuse("date")).otherwise(F.replace(c.cast("string"), F.lit(" "), F.lit("T")))


def canonical(c: Column, t: T.DataType) -> Column:
    """A value's canonical text (its bytes, for bytes)."""
    kind = kind_of(t)
    if kind == "float":
        return F.when(c.isNotNull(), _float(c.cast("double")))
    if kind in ("date", "datetime"):
        return F.when(c.isNotNull(), _date(c))
    if kind == "instant":
        seconds = (F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)  # whatever the session's zone
        return F.when(c.isNotNull(), F.concat(_date(utc), F.lit("Z")))
    return c if kind == "bytes" else c.cast("string")


# The text of each kind, without a sign or zeros that say nothing.
_FORMS = {
    "int": r"^(0|-?[1-9][0-9]{0,18})$", "uint": r"^(0|[1-9][0-9]{0,19})$", "float": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "decimal": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$",
    "bool": "^(0|1|true|false)$", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6}0*)?$",
}
_TYPES = {"int": "bigint", "uint": "decimal(20,0)", "float": "double", "decimal": "decimal(38,18)", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}


def parsed(c: Column, kind: str) -> Column:
    """Text as a value of a kind; text of another form, or that says more than the type holds, is refused."""
    if kind not in KINDS:
        raise MaskError("invalid: unknown kind")
    if kind == "text":
        return c
    if kind not in _FORMS:
        raise MaskError("unsupported: kind")
    text = F.regexp_replace(F.replace(c, F.lit(" "), F.lit("T")), r"(\.[0-9]*?)0+$", "$1") if kind == "datetime" else c
    value = (F.when(c == "1", True).when(c == "0", False).otherwise(c.try_cast("boolean")) if kind == "bool" else F.rtrim(text, F.lit(".")).try_cast(_TYPES[kind]) if kind == "datetime" else text.try_cast(_TYPES[kind]))
    bad = ~c.rlike(_FORMS[kind]) | value.isNull()
    if kind == "float":
        bad = bad | (F.abs(value) == float("inf"))
    if kind == "decimal":
        bad = bad | (F.length(F.regexp_extract(c, r"\.([0-9]+)$", 1)) > 18)
    return F.when(c.isNull(), None).when(bad, _refuse(kind)).otherwise(value)
