import pytest

from veilframe.functions.digest import MaskError, MaskPlan
from veilframe.functions.extension import register_mask, register_rules
from veilframe.operators import masking

KEY = bytes(range(40))


def test_rules_as_functions(spark):
    names = register_rules(spark, "veil_")
    assert len(names) == 13 and "veil_email" in names
    spark.createDataFrame([("a@b.co",), ("x",), (None,)], "t string").createOrReplaceTempView("mails")
    assert [r[0] for r in spark.sql("SELECT veil_email(t) FROM mails").collect()] == [True, False, None]
    assert spark.sql("SELECT count(*) FROM mails WHERE veil_email(t)").first()[0] == 1
    with pytest.raises(MaskError):
        register_rules(spark, "bad name; ")


@pytest.mark.parametrize(("strategy", "values"), [("fake_email", ["ann@example.com", "bob@example.org"]), ("cn_mobile", ["13912345678", "+8613912345678"]), ("format_random", ["aZ 9", ""]), ("redact", ["x"]), ("null", ["x"]), ("cn_city", ["北京", "Hangzhou"])])
def test_masks_as_functions(spark, strategy, values):
    p = MaskPlan(strategy, "parquet/t/c", "k1", KEY)
    register_mask(spark, f"veil_{strategy}", p)
    d = spark.createDataFrame([*enumerate(values), (99, None)], "i int, c string")
    d.createOrReplaceTempView("texts")
    q = spark.sql(f"SELECT i, veil_{strategy}(c) AS m FROM texts")
    assert "Join" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert {r["i"]: r["m"] for r in q.collect()} == {r["i"]: r["c_masked"] for r in masking.mask_column(d, "c", p).collect()}


def test_refusals_stop_the_query(spark):
    register_mask(spark, "veil_mail", MaskPlan("fake_email", "parquet/t/c", "k1", KEY))
    with pytest.raises(Exception, match="refused: invalid"):
        spark.sql("SELECT veil_mail(t) FROM VALUES ('no address') AS x(t)").collect()
    for name, kind in (("a b", "text"), ("ok", "bytes")):
        with pytest.raises(MaskError):
            register_mask(spark, name, MaskPlan("format_random", "s", "k", KEY, kind))
