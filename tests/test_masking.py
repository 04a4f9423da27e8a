import hashlib
import hmac
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import formats as f
from veilframe.functions.dialect import SPARK
from veilframe.functions.digest import MaskError, MaskPlan
from veilframe.functions.run import INPUT, over
from veilframe.operators import masking

KEY = bytes(range(32))


def plan(strategy, kind="text", scope="parquet/t/c", key=KEY, **more):
    return MaskPlan(strategy, scope, "k1", key, kind, **more)


def mask(spark, values, p):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    return [(r["c_masked"], r["c_error"]) for r in masking.mask_column(d, "c", p).orderBy("id").collect()]


def test_fake_email_is_the_documented_hmac(spark):
    p = plan("fake_email")
    value = "ann@example.com"
    b = value.encode()
    message = bytes([1]) + len(b).to_bytes(4, "big") + b + len(p.extra).to_bytes(4, "big") + p.extra + b"typed-lexical-v1"
    want = hmac.new(KEY, message, hashlib.sha256).hexdigest()[:32] + "@masked.invalid"
    assert mask(spark, [value, None, "not an address", "a_b@example.com"], p) == [(want, None), (None, None), (None, "invalid"), (None, "invalid")]


def test_long_keys_are_hashed_first(spark):
    long = bytes(100)
    p = plan("fake_email", key=long)
    b = b"ann@example.com"
    message = bytes([1]) + len(b).to_bytes(4, "big") + b + len(p.extra).to_bytes(4, "big") + p.extra + b"typed-lexical-v1"
    assert mask(spark, ["ann@example.com"], p)[0][0].split("@")[0] == hmac.new(long, message, hashlib.sha256).hexdigest()[:32]


GOOD = {
    "cn_id_card": (["110101200002290018"], f.cn_id_card), "cn_mobile": (["+8613912345678", "8613912345678", "13912345678"], f.cn_mobile), "cn_bank_card": (["6222021234567894", "4111111111111111"], f.cn_bank_card),
    "cn_uscc": (["91110000123456789Q"], f.cn_uscc), "cn_postal_code": (["100000"], f.cn_postal_code), "cn_city": (["北京", "上海市", "Hangzhou", "chengdu City"], f.cn_city),
    "cn_person_name": (["王明", "欧阳星河"], f.cn_person_name), "cn_address": (["北京市东城区和平路12号"], f.cn_address), "cn_date": (["2024-02-29", "2024/02/29", "2024年2月9日"], f.cn_date),
}


@pytest.mark.parametrize("strategy", GOOD)
def test_chinese_formats_stay_valid_and_change(spark, strategy):
    values, rule = GOOD[strategy]
    first = mask(spark, values, plan(strategy))
    assert all(e is None and m != v for (m, e), v in zip(first, values, strict=True))
    assert first == mask(spark, values, plan(strategy))
    if strategy != "cn_postal_code":
        assert mask(spark, values, plan(strategy, key=bytes(32))) != first or strategy == "cn_city"
    d = spark.createDataFrame([(m,) for m, _ in first], "c string")
    assert all(r[0] for r in over(d, f"SELECT {rule(SPARK, 'c')} FROM {INPUT}").collect())
    assert all(e is None for _, e in mask(spark, [m for m, _ in first], plan(strategy)))  # can be masked again


def test_shapes_are_kept(spark):
    out = [m for m, _ in mask(spark, ["+8613912345678", "8613912345678"], plan("cn_mobile"))]
    assert out[0].startswith("+86") and len(out[0]) == 14 and len(out[1]) == 13
    assert [len(m) for m, _ in mask(spark, ["6222021234567894"], plan("cn_bank_card"))] == [16]
    d = [m for m, _ in mask(spark, ["2024/02/29", "2024年2月9日"], plan("cn_date"))]
    assert re.fullmatch(r"\d{4}/\d\d/\d\d", d[0]) and re.fullmatch(r"\d{4}年[1-9]\d?月[1-9]\d?日", d[1])


@pytest.mark.parametrize("strategy,bad,code", [
    ("cn_id_card", ["110101200002300018", "999999200002290018", "110101200002290019"], "invalid"), ("cn_mobile", ["12012345678", "+13912345678"], "invalid"), ("cn_bank_card", ["6222021234567895", "0222021234567894"], "invalid"),
    ("cn_uscc", ["91110000123456789A"], "invalid"), ("cn_postal_code", ["1000", "10000a"], "invalid"), ("cn_city", ["苏州", "Paris", "北京 city"], "unsupported"),
    ("cn_person_name", ["普明", "王", "John"], "unsupported"), ("cn_address", ["北京市", "abc路1号"], "unsupported"), ("cn_date", ["2023-02-29", "1899-01-01", "29/02/2024"], "unsupported"), ("format_random", ["né", "Ж"], "unsupported"),
])
def test_refusals(spark, strategy, bad, code):
    assert mask(spark, bad, plan(strategy)) == [(None, code)] * len(bad)


def test_format_random_classes(spark):
    (m, e), (blank, e2), (same, e3), (empty, e4) = mask(spark, ["Ab 9-天文!", None, "--- !", ""], plan("format_random"))
    assert e is None and re.fullmatch(r"[A-Z][a-z] \d-[天地玄黄宇宙洪荒日月盈昃辰宿列张山川草木风云光明华夏星海新梦]{2}!", m)
    assert all(a != b for a, b in zip(m, "Ab 9-天文!", strict=True) if b not in " -!")
    assert (blank, e2) == (None, None) and (same, e3) == (None, "unsafe") and (empty, e4) == ("", None)


def test_simple_strategies(spark):
    assert mask(spark, ["x", None, "***REDACTED***"], plan("redact")) == [("***REDACTED***", None), (None, None), (None, "unsafe")]
    assert mask(spark, ["x", None], plan("blank")) == [("", None), (None, None)]
    assert mask(spark, ["x", None], plan("null", nullable=False)) == [(None, "unsafe"), (None, None)]
    with pytest.raises(MaskError):
        masking.masked_select(SPARK, "t", ["id"], "c", plan("blank", "int"))
    with pytest.raises(MaskError):
        MaskPlan("redact", "s", "k", b"short")


def test_narrow_columns_and_scopes(spark):
    assert mask(spark, ["ann@example.com"], plan("fake_email", length=20)) == [(None, "unsafe")]
    a, b = (mask(spark, ["ann@example.com"], plan("fake_email", scope=s)) for s in ("parquet/t/a", "parquet/t/b"))
    assert a != b


def test_fail_closed(spark):
    d = spark.createDataFrame([(1, "ann@example.com"), (2, "secret value")], "id int, c string")
    m = masking.mask_column(d, "c", plan("fake_email"))
    with pytest.raises(MaskError) as e:
        masking.require_masked(m, ["c"])
    assert "invalid: c x 1" in str(e.value) and "secret" not in str(e.value)


def test_first_writer_wins(spark):
    t = "fingerprint string, masked string, turn int"
    a, b = spark.createDataFrame([("f", "one", 1)], t), spark.createDataFrame([("f", "two", 2), ("g", "three", 2)], t)
    assert {tuple(r) for r in masking.mapping_table(a, b).collect()} == {("f", "one"), ("g", "three")}


def test_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "ann@example.com")], "id int, c string")
    text = masking.mask_column(d, "c", plan("fake_email"))._jdf.queryExecution().toString()
    assert "Python" not in text
    assert masking.mask_column(d, "c", plan("fake_email")).where(F.col("c_error").isNull()).count() == 1


def test_any_column_name(spark):
    for name in ("my col", "a.b", "seed", "x`y", "c; DROP TABLE t --", "fits", "列"):
        d = spark.createDataFrame([(1, "ann@example.com"), (2, None), (3, "nothing")], ["m_", name])
        m = masking.mask_column(d, name, plan("fake_email"))
        assert m.columns == ["m_", name, f"{name}_masked", f"{name}_error"]
        plain = masking.mask_column(d.toDF("m_", "c"), "c", plan("fake_email"))
        assert [tuple(r) for r in m.collect()] == [tuple(r) for r in plain.collect()]
        assert [(r["column"], r["n"]) for r in masking.violations(m, [name]).collect()] == [(name, 1)]
