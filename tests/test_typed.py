import math
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import typed
from veilframe.functions.digest import MaskError
from veilframe.operators import validation


def texts(spark, values, t):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", t)]))
    return [r[0] for r in d.orderBy("i").select(typed.canonical(F.col("v"), t)).collect()]


def shortest(x):
    sign, digits, exp = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits))
    exp += len(digits) - 1
    digits = digits.lstrip("0").rstrip("0")
    if not digits:
        return "-0" if math.copysign(1, x) < 0 else "0"
    s = "-" * sign
    if exp < -4 or exp >= 6:
        return f"{s}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'-' if exp < 0 else '+'}{abs(exp):02}"
    if exp < 0:
        return f"{s}0.{'0' * (-exp - 1)}{digits}"
    return s + (digits.ljust(exp + 1, "0") if len(digits) <= exp + 1 else digits[: exp + 1] + "." + digits[exp + 1 :])


def test_floats(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 100000.0, 999999.0, 1e6, 1234567.0, 1e-4, 1.25e-5, 1e21, 1e100, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 1 / 3, None] + [r.uniform(-1, 1) * 10 ** r.randint(-12, 12) for _ in range(300)]
    assert texts(spark, values, T.DoubleType()) == [None if v is None else shortest(v) for v in values]
    for bad in (math.nan, math.inf, -math.inf):
        with pytest.raises(Exception, match="not finite"):
            texts(spark, [bad], T.DoubleType())


def test_other_kinds(spark):
    assert texts(spark, [True, False, None], T.BooleanType()) == ["true", "false", None]
    assert texts(spark, [-5, 0, None], T.LongType()) == ["-5", "0", None]
    assert texts(spark, [Decimal("1.00"), Decimal("-0.0000001"), None], T.DecimalType(20, 10)) == ["1.0000000000", "-0.0000001000", None]
    assert texts(spark, [date(2024, 2, 29), date(1, 1, 1), None], T.DateType()) == ["2024-02-29", "0001-01-01", None]
    moments = [datetime(2024, 2, 29, 23, 59, 59), datetime(1969, 12, 31, 1, 2, 3, 400000), datetime(1500, 1, 1, 0, 0, 0, 1), None]
    want = ["2024-02-29T23:59:59", "1969-12-31T01:02:03.4", "1500-01-01T00:00:00.000001", None]
    assert texts(spark, moments, T.TimestampNTZType()) == want
    d = spark.sql("SELECT timestamp '2024-07-01 12:00:00.25+02:00' AS v")
    assert d.select(typed.canonical(F.col("v"), T.TimestampType())).first()[0] == "2024-07-01T10:00:00.25Z"
    for t in (T.ArrayType(T.LongType()), T.StructType([])):
        with pytest.raises(MaskError):
            typed.kind_of(t)
    assert [typed.kind_of(t) for t in (T.DecimalType(20, 0), T.DecimalType(10, 2), T.ShortType(), T.BinaryType(), T.FloatType())] == ["uint", "decimal", "int", "bytes", "float"]


PARSED = {
    "int": (["0", "-12", "9223372036854775807", None], ["+1", "01", "-0", "9223372036854775808", "1.0", "", "x", " 1"]), "uint": (["0", "18446744073709551615"], ["-1", "00"]),
    "float": (["1.5", "-2e-3", "0"], ["nan", "inf", "1e999", ".5", "1."]), "decimal": (["1.00", "-0.5", "12"], ["01", "1.", "1e3", "0.1234567890123456789"]),
    "bool": (["0", "1", "true", "false", None], ["t", "TRUE", "2", "yes"]), "date": (["2024-02-29", "0001-01-01"], ["2023-02-29", "2024-2-9", "2024-02-29x"]),
    "datetime": (["2024-02-29 01:02:03", "2024-02-29T01:02:03.500000000"], ["2024-02-29", "2024-02-29 24:00:00", "2024-02-29T01:02:03.1234567", "2024-02-29T01:02:03Z"]),
}


@pytest.mark.parametrize("kind", PARSED)
def test_parsed(spark, kind):
    good, bad = PARSED[kind]
    one = lambda v: spark.createDataFrame([(v,)], "v string").select(typed.parsed(F.col("v"), kind)).first()[0]
    values = [r[0] for r in spark.createDataFrame([(v,) for v in good], "v string").coalesce(1).select(typed.parsed(F.col("v"), kind)).collect()]
    assert [v is None for v in values] == [v is None for v in good]
    if kind == "bool":
        assert values == [False, True, True, False, None]
    if kind == "datetime":
        assert values == [datetime(2024, 2, 29, 1, 2, 3), datetime(2024, 2, 29, 1, 2, 3, 500000)]
    for b in bad:
        with pytest.raises(Exception, match=f"invalid: {kind}"):
            one(b)


def test_digests_tell_kinds_and_refuse(spark):
    d = spark.sql("SELECT 1 AS k, 1000000.0D AS f, X'00ff' AS b, true AS t")
    a = d.select(validation.row_digest(d, "t", ["k", "f", "b", "t"], {})).first()[0]
    import hashlib

    field = lambda x: len(x).to_bytes(4, "big") + x
    raw = field(b"t")
    for name, value in (("k", b"1"), ("f", b"1e+06"), ("b", b"\x00\xff"), ("t", b"true")):
        raw += field(name.encode()) + field(b"text") + b"\x01" + field(value)
    assert a == hashlib.sha256(raw).hexdigest()
    n = spark.sql("SELECT 1 AS k, double('NaN') AS f")
    with pytest.raises(Exception, match="not finite"):
        validation.content_digest(n, "t", ["k"], ["k", "f"]).collect()
